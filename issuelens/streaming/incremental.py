"""Incremental index build (SRC-02, STR-01, STR-02, SNK-05).

A file-source stream over landed issue files, processed with
``trigger(availableNow=True)``: every run takes what arrived since the last
checkpoint, in batches bounded by ``maxFilesPerTrigger`` / ``maxBytesPerTrigger``.
Each micro-batch is one commit of the index store (``operators.search.add``): index rows,
rejects and the batch's row counts appear together or not at all. The ledger of the
store knows a batch by the checkpoint's id and its number, so a batch that is replayed after
a crash between commit and checkpoint is recognised without reading its data. A fresh
checkpoint has another id: its batches are read, and a ``left_anti`` join on tracker and
key keeps what is indexed from being added twice. An issue that a batch holds twice is
added once. Identity is tracker and key, not an offset (fixes the reference's
resume-by-count). Issues whose text the encoder fails on are rejects of the store, and
``retry_rejected`` encodes them again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import search
from ..sources import files


def index_batch(batch: DataFrame, index_path: str, encoder=None, name: str | None = None) -> None:
    """Commit the issues of ``batch`` that are not in the index yet; ``name`` is the batch's entry in the ledger."""
    search.add(batch.sparkSession, index_path, batch, encoder, name)


def rejected(spark: SparkSession, index_path: str) -> DataFrame:
    """Issues whose text the encoder failed on and that no later run has indexed, once each."""
    return search.rejected(spark, index_path)


def retry_rejected(spark: SparkSession, index_path: str, encoder=None) -> None:
    """Encode the rejects again and commit those that succeed now."""
    search.retry_rejected(spark, index_path, encoder)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave to the stream of this checkpoint folder."""
    return json.loads(files.read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def index_incrementally(spark: SparkSession, source_path: str, schema: T.StructType | str,
                        index_path: str, checkpoint: str, encoder=None, fmt: str = "parquet",
                        max_files_per_trigger: int | None = None, path_glob: str | None = None,
                        prepare=None, max_bytes_per_trigger: str | None = None):
    """Start the available-now stream; returns the StreamingQuery.

    ``prepare`` maps the raw stream to issue documents (repo, _id, key, fields);
    ``path_glob`` narrows the files read in ``source_path``.
    """
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:   # STR-02 by volume, for sources that support it
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    stream = r.load(source_path)
    if prepare is not None:
        stream = prepare(stream)

    def sink(batch: DataFrame, batch_id: int) -> None:
        index_batch(batch, index_path, encoder, f"{checkpoint_id(spark, checkpoint)}:{batch_id}")

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def documents_as_issues(stream: DataFrame) -> DataFrame:
    """Stream-side twin of ``fixtures.issues_doc`` (documents -> nested issues)."""
    pos = F.instr(F.col("text"), "\n")
    return stream.select(
        F.col("source").alias("repo"), F.col("doc_id").alias("_id"),
        F.col("doc_id").cast("string").alias("key"),
        F.struct(F.substring_index("text", "\n", 1).alias("summary"),
                 F.when(pos > 0, F.substr(F.col("text"), pos + F.lit(1))).alias("description"),
                 F.struct(F.col("lang").alias("name")).alias("issuetype")).alias("fields"))
