"""A corpus of documents on its way to training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
``run`` writes every stage's result and reads it again. All stages but the last return
the columns of ``documents``. SQL cannot state SimHash fingerprints or token ids, so
there is no SQL for the whole. Tests hold the operators of its stages against plain
versions on small rows; none compares the whole pipeline's result with one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import mixing, packing, pii, quality, simhash
from issuelens.llm.common import land
from issuelens.llm.queries import RANKS, VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule of the threshold table go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link (three-word shingles, 3 bits) the one of the smallest id stays."""
    return simhash.one_of_each(docs, shingle=3, bits=3)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced; n_chars follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by size ** 0.7: documents are repeated or left out, and shuffled."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return packing.pack(docs, VOCABULARY, RANKS).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("private_data", private_data),
          ("mixed_sources", mixed_sources), ("packed_sequences", packed_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
