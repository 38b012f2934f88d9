"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked there; all rows are
ordered by their fractional rank (rank - phase) / rows of the source, and the order is
cut into shards of equal row counts. Any stretch of the order, and so any shard, holds
each source in proportion, to within two rows. A source's phase, a seeded number in
(0, 1), spreads sources of few rows, which would else all meet at the same rank.

Ranks need no task with a whole source in it: the hash's buckets are counted, the counts
are summed along the buckets, and rows are numbered within (source, bucket). Positions
in the overall order are found in the same way from buckets of the fractional rank, which
hold equally many rows by construction.

Defined results: a null source is a source of its own, a null text has no bytes; rows
equal in id, size and text checksum are interchangeable and are numbered among each
other; empty tables give empty results; columns to carry along may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land, tasks, text_of

SEED = 40


def _running(counts: DataFrame, by: list[str], along: str) -> DataFrame:
    """``before``: the rows of the buckets before, ``total``: those of all of ``by``."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return counts.withColumns({"before": F.sum("n").over(w.orderBy(along).rowsBetween(W.unboundedPreceding, -1)),
                               "total": F.sum("n").over(w)}).withColumn("before", F.coalesce("before", F.lit(0).cast("long"))).drop("n")


def interleave(docs: DataFrame, shards: int = 40, seed: int = SEED, id: str = "doc_id", source: str = "source",
               text: str = "text", carry: bool = False) -> DataFrame:
    """id, size, text_crc32, source, shard and slot of every row; with ``carry`` also ``row``, all its columns."""
    buckets = 4 * tasks(docs.sparkSession)
    t = text_of(F.col("row")[text])
    narrow = (keep_row(docs).withColumns({"id": F.col("row")[id], "source": F.col("row")[source],
                                         "size": F.octet_length(t).cast("long") + 16, "text_crc32": F.crc32(t.cast("binary"))})
              .withColumns({"sk": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")),
                            "h": F.xxhash64(F.lit(seed), "id", "size", "text_crc32")})
              .withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")))
    narrow = land(narrow if carry else narrow.drop("row"), "strata")
    w = W.partitionBy("sk", "bucket").orderBy("h", "id", "size", "text_crc32")
    in_source = _running(narrow.groupBy("sk", "bucket").agg(F.count("*").alias("n")), ["sk"], "bucket")
    phase = (F.pmod(F.xxhash64(F.lit(seed), "sk"), F.lit(1 << 20)) + 0.5) / F.lit(float(1 << 20))
    ranked = (narrow.withColumn("rank", F.row_number().over(w)).join(in_source, ["sk", "bucket"])
              .withColumn("f", (F.col("before") + F.col("rank") - phase) / F.col("total"))
              .withColumn("place", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)).cast("int"))
              .drop("bucket", "before", "total", "rank"))
    ranked = land(ranked, "ranked")
    overall = _running(ranked.groupBy("place").agg(F.count("*").alias("n")), [], "place")
    w = W.partitionBy("place").orderBy("f", "sk", "h", "id", "size", "text_crc32")
    at = F.col("before") + F.col("rank") - 1
    kept = ["id", "size", "text_crc32", "source"] + ["row"] * carry
    return (ranked.withColumn("rank", F.row_number().over(w)).join(overall, "place")
            .withColumn("at", at).withColumn("shard", F.expr(f"(at * {shards}L) div total"))
            .withColumn("slot", F.expr(f"at - (shard * total + {shards - 1}L) div {shards}L"))
            .select(*kept, F.col("shard").cast("int").alias("shard"), "slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, **settings) -> None:
    """Parquet folders shard=0, 1, ... whose rows have all columns of ``docs`` and stand in slot order."""
    placed = interleave(docs, shards, carry=True, **settings)
    (placed.select("row", "shard", "slot").repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
