"""Held-out evaluation slice (SRC-03, SORT-01, SORT-03, PRJ-07, FLT-01, JOB-06).

``slice_by_order`` returns rows ``skip .. skip+limit-1`` of a total order (null first):

* ``ranked`` (the default, at every offset) - only the order column is range-partitioned
  and checkpointed (so counts and rows come from the same layout); rows per partition
  are counted (one small row per partition) and turned into starting offsets, and only
  the partitions that the slice touches are numbered. That gives the order's values at
  both ends of the slice; the wide rows are then read by a range filter, which reaches
  the scan.
* ``take`` - ``orderBy().offset().limit()`` for callers that know the offset is small:
  Spark runs it as ``TakeOrderedAndProject`` keeping ``skip+limit`` rows per task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TESTSET_LIMIT, TESTSET_SKIP
from ..session import cut_lineage


def slice_by_order(df: DataFrame, order: str, skip: int, limit: int, strategy: str = "ranked",
                   partitions: int | None = None) -> DataFrame:
    if strategy == "take":
        return df.orderBy(F.col(order).asc()).offset(skip).limit(limit)
    if strategy != "ranked":
        raise ValueError(f"unknown strategy {strategy!r}")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col("_value")
    ranged = cut_lineage(df.select(F.col(order).alias("_value")).repartitionByRange(n, value.asc())
                         .withColumn("_pid", F.spark_partition_id()))
    counts = {r["_pid"]: r["n"] for r in ranged.groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    pids = sorted(counts)
    starts = dict(zip(pids, accumulate((counts[p] for p in pids), initial=0)))
    end = min(skip + limit, sum(counts.values())) - 1
    if end < skip:
        return df.limit(0)
    touched = [p for p in pids if starts[p] <= end and starts[p] + counts[p] > skip]
    start = F.element_at(F.create_map(*[x for p in touched for x in (F.lit(p), F.lit(starts[p]).cast("long"))]), F.col("_pid"))
    w = Window.partitionBy("_pid").orderBy(value.asc())
    placed = (ranged.where(F.col("_pid").isin(touched))
              .withColumn("_pos", (start + F.row_number().over(w) - 1).cast("long")))
    ends = placed.where(F.col("_pos").isin(skip, end)).orderBy("_pos").collect()   # one or two rows
    first, last = ends[0]["_value"], ends[-1]["_value"]
    col = F.col(order)
    after = F.lit(True) if first is None else col >= F.lit(first)
    before = col.isNull() if last is None else (col <= F.lit(last)) | (col.isNull() if first is None else F.lit(False))
    kept = df.where(after & before)
    # Equal values share a range partition, so all rows that tie with the slice's first are in ``placed``.
    ahead = placed.where(value.eqNullSafe(F.lit(first)) & (F.col("_pos") < skip)).count()
    return kept.orderBy(col.asc()).offset(ahead).limit(limit)


def testset_rows(issues: DataFrame) -> DataFrame:
    """PRJ-07: summary, description ('' when absent), expected_issuetype."""
    return issues.select(
        "key",
        F.col("summary"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.col("issuetype").alias("expected_issuetype"))


def usable(rows: DataFrame) -> DataFrame:
    """FLT-01: summary and issuetype present and non-empty."""
    return rows.where((F.coalesce(F.col("summary"), F.lit("")) != "")
                      & (F.coalesce(F.col("expected_issuetype"), F.lit("")) != ""))


def make_testset(issues: DataFrame, skip: int = TESTSET_SKIP, limit: int = TESTSET_LIMIT, order: str = "_id",
                 strategy: str = "ranked") -> DataFrame:
    """JOB-06: slice by landing order, then keep usable rows (at most ``limit``)."""
    s = slice_by_order(issues, order, skip, limit, strategy)
    return usable(testset_rows(s))
