"""The vector index as one table: (repo, issue_key, text, issuetype, embedding).

Vector and metadata share a row, so there is no positional join. ``search.py`` keeps
an index as commits (SNK-05, SET-04) and opens it behind a guard (SNK-06);
``check_index`` states the consistency of index rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import embed
from ..plans.inspect import spread
from ..sources.issues import flatten_issues, index_text, same_issue


def build_index(issue_docs: DataFrame, encoder=None) -> DataFrame:
    """JOB-01 (batch form): flatten -> text -> unit vector. Texts that the encoder fails on
    (null vector) are left out; ``encode_issues`` keeps them."""
    return encode_issues(issue_docs, encoder).where(F.col("embedding").isNotNull())


def encode_issues(issue_docs: DataFrame, encoder=None) -> DataFrame:
    """Index rows of all issues, a null vector where the encoder failed on the text."""
    keep = ["repo"] if "repo" in issue_docs.columns else []
    t = spread(index_text(flatten_issues(issue_docs, keep)))
    return embed(t, "text", encoder=encoder).select(*keep, F.col("key").alias("issue_key"), "text", "issuetype", "embedding")


def metadata(index: DataFrame) -> DataFrame:
    """PRJ-04: the index without its vectors (Parquet prunes the vector column)."""
    return index.select("issue_key", "issuetype", "text")


def pending(issues: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """SRC-02 / JOIN-07: issues not in the index yet (identity by tracker and key, not by offset)."""
    have = index.withColumnRenamed("issue_key", key)
    on = [key if c == "key" else c for c in same_issue(issues, have)]
    return issues.join(have.select(*on), on, "left_anti")


def check_index(index: DataFrame) -> DataFrame:
    """SNK-06: one row of counts; ``consistent`` is false when the index must be rebuilt."""
    s = index.agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.struct(*[c for c in ("repo", "issue_key") if c in index.columns])).alias("keys"),
        F.count_if(F.col("embedding").isNull()).alias("null_vectors"),
        F.min(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("min_dim"),
        F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("max_dim"),
    )
    return s.withColumn("consistent", (F.col("rows") > 0) & (F.col("rows") == F.col("keys"))
                        & (F.col("null_vectors") == 0) & (F.col("min_dim") == F.col("max_dim")))
