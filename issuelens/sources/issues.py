"""Issue scans and flattening (SRC-01, PRJ-01..03, PRJ-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TASK_DESCRIPTION
from ..schemas import ISSUE, narrow

# Leaves read by the retrieval jobs.
TEXT_PATHS = ["repo", "_id", "key", "fields.summary", "fields.description", "fields.issuetype.name"]


def read_issues(spark: SparkSession, path: str, paths: list[str] | None = None,
                fmt: str = "parquet") -> DataFrame:
    """Scan landed issue documents with an explicit (optionally narrowed) schema.

    With ``paths`` the read schema holds only those leaves, which is the one way to
    prune leaves below the second array level (``changelog.histories.items``).
    """
    schema = narrow(ISSUE, paths) if paths else ISSUE
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
    return reader.load(path)


def flatten_issues(docs: DataFrame, keep=()) -> DataFrame:
    """PRJ-01: key, summary, description, issuetype with '' for absent or null parts."""
    return docs.select(
        *keep,
        F.col("key"),
        F.coalesce(F.col("fields.summary"), F.lit("")).alias("summary"),
        F.coalesce(F.col("fields.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("fields.issuetype.name"), F.lit("")).alias("issuetype"),
    )


def same_issue(*frames: DataFrame) -> list[str]:
    """Columns that identify an issue in all ``frames``: tracker and key, the key alone
    where a frame holds no tracker column (tables of a single tracker)."""
    return ["repo", "key"] if all("repo" in df.columns for df in frames) else ["key"]


def index_text(df: DataFrame, out: str = "text") -> DataFrame:
    """PRJ-02: summary + one space + description, untrimmed (nulls read as '')."""
    return df.withColumn(out, F.concat(F.coalesce(F.col("summary"), F.lit("")), F.lit(" "),
                                       F.coalesce(F.col("description"), F.lit(""))))


def query_text(df: DataFrame, col: str = "summary", out: str = "query_text",
               task: str = TASK_DESCRIPTION) -> DataFrame:
    """PRJ-03: ``Instruct: {task}\\nQuery: {query}`` (only queries get the prefix)."""
    return df.withColumn(out, F.concat(F.lit(f"Instruct: {task}\nQuery: "),
                                       F.coalesce(F.col(col), F.lit(""))))
