"""Plan helpers: inspection and parallelism of Python stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """Physical plan as text (for tests and notes)."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def executed_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition of a scan that has fewer splits than the cluster has
    cores (e.g. one small file), so a CPU-heavy Python stage runs in parallel.

    A large input already has many splits and is left as is: no shuffle of the whole
    input just to feed a UDF. A plan with a shuffle is left to adaptive execution,
    which keeps the parallelism of small shuffles; asking such a plan for its number
    of partitions would run it."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in executed_plan(df) or df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
