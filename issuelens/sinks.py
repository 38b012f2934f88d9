"""File sinks and their readers (SNK-01..04, SNK-08, SNK-09, SRC-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str, skip_empty: bool = True, mode: str = "overwrite") -> bool:
    """JSON lines, nulls written as null, non-ASCII kept. Nothing is written for an
    empty frame (the check reads at most one row). Returns whether it wrote."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return True


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


CSV_OPTIONS = {"header": True, "quoteAll": True, "escape": '"'}


def write_csv(df: DataFrame, path: str, skip_empty: bool = True, mode: str = "overwrite") -> bool:
    """CSV with a header; every field quoted, quotes doubled, so text with commas,
    quotes and newlines survives. Skipped when empty. CSV has one spelling for
    null and '' (both read back as ''); evaluation results contain no nulls."""
    if skip_empty and df.isEmpty():
        return False
    w = df.write.mode(mode)
    for k, v in CSV_OPTIONS.items():
        w = w.option(k, v)
    w.csv(path)
    return True


# Unquoted empty fields are nulls; a quoted empty field ("") is an empty string.
# The reader compares every value with ``nullValue``, so it gets a marker that
# cannot occur in text, and the parser hands that marker back for unquoted empties.
_NULL_MARK = "\u0000null\u0000"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("nullValue", _NULL_MARK).option("emptyValue", "")
            .csv(path))


def write_prompts(prompts: DataFrame, path: str) -> bool:
    """SNK-04: prompts of successful queries only."""
    return write_jsonl(prompts.where(F.coalesce(F.col("prompt"), F.lit("")) != ""), path)


def append_partitioned(df: DataFrame, path: str, col: str = "repo") -> None:
    """SNK-08: append issues into one folder per source (partition pruning on read)."""
    df.write.mode("append").partitionBy(col).parquet(path)
