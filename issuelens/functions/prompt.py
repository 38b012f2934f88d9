"""Classification prompt assembly (SCL-14..16, AGG-23), JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .text import filled


def class_line(name, description) -> Column:
    """SCL-14: ``- name: desc`` or ``- name`` when the description is empty."""
    return F.when(F.coalesce(description, F.lit("")) != "",
                  F.concat(F.lit("- "), name, F.lit(": "), description, F.lit("\n"))
                  ).otherwise(F.concat(F.lit("- "), name, F.lit("\n")))


def class_list_text(classes=K.ISSUE_TYPES) -> str:
    """The class-list block as one constant (47 fixed lines; no data involved)."""
    return "".join(f"- {n}: {d}\n" if d else f"- {n}\n" for n, d in classes)


def neighbour_block(rank, key, similarity, text, issuetype) -> Column:
    """SCL-15: header with rank, key and similarity; text; type line only when non-empty."""
    head = filled(K.PROMPT_SIMILAR_HEADER, rank=rank.cast("string"), key=key, similarity=F.format_string("%.4f", similarity))
    body = filled(K.PROMPT_SIMILAR_TEXT, text=F.coalesce(text, F.lit("")))
    typ = F.when(F.coalesce(issuetype, F.lit("")) != "", filled(K.PROMPT_SIMILAR_TYPE, issuetype=issuetype)).otherwise(F.lit(""))
    return F.concat(head, body, typ)


def neighbour_text(neighbours: DataFrame) -> DataFrame:
    """AGG-23: ordered neighbour blocks -> one text per query.

    Groups hold at most k rows (the neighbour cut), so the collect is bounded;
    ``array_sort`` on a struct led by ``rank`` restores the order lost by
    ``collect_list``.
    """
    key = "issue_key" if "issue_key" in neighbours.columns else "key"
    b = neighbours.select("query_id", F.struct(
        F.col("rank"), neighbour_block(F.col("rank"), F.col(key), F.col("similarity"),
                                       F.col("text"), F.col("issuetype")).alias("block")).alias("nb"))
    return b.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("nb")), lambda x: x["block"]), "")
        .alias("blocks"))


def prompt_column(summary, blocks, classes=K.ISSUE_TYPES) -> Column:
    """SCL-16: the full prompt for one query."""
    context = F.when(blocks.isNotNull() & (blocks != ""),
                     F.concat(F.lit(K.PROMPT_SIMILAR_INTRO), blocks, F.lit(K.PROMPT_SIMILAR_END))
                     ).otherwise(F.lit(K.PROMPT_NO_SIMILAR))
    return F.concat(
        F.lit(K.PROMPT_HEAD),
        filled(K.PROMPT_SUMMARY, summary=F.coalesce(summary, F.lit(""))),
        F.lit(K.PROMPT_CONTEXT),
        context,
        F.lit(K.PROMPT_CLASSES_HEAD + class_list_text(classes)),
        F.lit(K.PROMPT_TAIL),
    )


def rag_prompts(neighbours: DataFrame, queries: DataFrame, classes=K.ISSUE_TYPES) -> DataFrame:
    """JOB-03: (query_id, summary) + neighbours -> (query_id, prompt).

    A query without neighbours gets the "No similar ..." line (left join)."""
    nt = neighbour_text(neighbours)
    j = queries.join(nt, "query_id", "left")
    return j.select("query_id", prompt_column(F.col("summary"), F.col("blocks"), classes).alias("prompt"))
