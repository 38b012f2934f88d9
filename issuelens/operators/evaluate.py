"""Evaluation of predictions (JOIN-03, SCL-02/03, AGG-18..22, SET-03, PRJ-06).

``run`` is the whole job: test items -> neighbours -> prompts -> completions -> one table of
results, from which every metric and every file is derived. Every metric is a ``groupBy``
with map-side partial aggregation; the only value that reaches the driver is the label
list of the wide confusion matrix, whose columns it names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..constants import TOP_K
from ..functions import prompt as pr
from ..functions.text import cell, percent, same_label
from ..session import materialize
from . import completions, generate, search


class Evaluation(NamedTuple):
    """``results``: a row for each test item; ``prompts``: (query_id, prompt, llm_output); both written once."""

    results: DataFrame
    prompts: DataFrame


def run(spark: SparkSession, testset: DataFrame, index: str, store: str, generator, encoder=None, k: int = TOP_K,
        model: str | None = None) -> Evaluation:
    """JOB-04: ``testset`` (query_id, summary, description, expected) against the stored index at ``index``.

    A query is the summary alone; an item that is in the index itself (its ``query_id`` is a
    key there) is not its own neighbour. Completions come from the store at ``store``.
    """
    items = materialize(testset.select("query_id", "summary", "description", "expected"), "testset")
    queries = items.select("query_id", F.col("summary").alias("query"))
    neighbours = search.search(spark, index, queries, k, encoder, exclude_self=True)
    prompts = materialize(pr.rag_prompts(neighbours, items.select("query_id", "summary")), "prompts")
    scored = materialize(completions.complete(prompts, store, generator, model), "scored")
    done = materialize(results(generate.predict(scored), items), "results")
    return Evaluation(done, prompts.join(scored.select("query_id", "llm_output"), "query_id"))


def write_files(e: Evaluation, path: str) -> list[str]:
    """SNK-02..04: results as JSON lines and CSV, prompts of the queries that were answered; returns what was written."""
    rows = e.results.select("summary", "description", "expected", "predicted", "is_correct", "llm_output")
    answered = e.prompts.where(F.col("llm_output").isNotNull()).select("query_id", "prompt")
    written = {"results.jsonl": sinks.write_jsonl(rows, f"{path}/results.jsonl"), "results.csv": sinks.write_csv(rows, f"{path}/results.csv"),
               "prompts.jsonl": sinks.write_prompts(answered, f"{path}/prompts.jsonl")}
    return [name for name, done in written.items() if done]


def results(predicted: DataFrame, testset: DataFrame) -> DataFrame:
    """JOIN-03 + PRJ-06: align predictions with items by ``query_id``.

    ``testset``: (query_id, summary, description, expected); ``predicted``:
    (query_id, predicted, llm_output, failed). An item without a prediction row
    counts as a failed query.
    """
    j = testset.join(predicted, "query_id", "left")
    failed = F.coalesce(F.col("failed"), F.lit(True))
    return j.select(
        "query_id", "summary", F.coalesce("description", F.lit("")).alias("description"),
        "expected",
        F.coalesce("predicted", F.lit("ERROR_QUERY_FAILED")).alias("predicted"),
        F.coalesce(~failed & same_label(F.col("predicted"), F.col("expected")), F.lit(False)).alias("is_correct"),
        F.coalesce("llm_output", F.lit("ERROR: Query command failed or returned None")).alias("llm_output"),
    )


def accuracy(res: DataFrame) -> DataFrame:
    """AGG-18: correct, total, accuracy (0.0 for an empty set)."""
    return res.agg(
        F.count_if("is_correct").alias("correct"),
        F.count("*").alias("total"),
        F.coalesce(F.avg(F.col("is_correct").cast("double")), F.lit(0.0)).alias("accuracy"))


def by_class(res: DataFrame) -> DataFrame:
    """AGG-19: per expected class."""
    return res.groupBy("expected").agg(
        F.count_if("is_correct").alias("correct"),
        F.count("*").alias("count"),
        F.avg(F.col("is_correct").cast("double")).alias("accuracy"))


def predictions_per_class(res: DataFrame) -> DataFrame:
    """AGG-20."""
    return res.groupBy("predicted").agg(F.count("*").alias("count"))


def confusion_long(res: DataFrame) -> DataFrame:
    """AGG-21."""
    return res.groupBy("expected", "predicted").agg(F.count("*").alias("count"))


def labels(res: DataFrame) -> DataFrame:
    """SET-03: expected union predicted, distinct, sorted."""
    return (res.select(F.col("expected").alias("label"))
            .union(res.select(F.col("predicted").alias("label"))).distinct().orderBy("label"))


def confusion_wide(res: DataFrame) -> DataFrame:
    """AGG-22: rows = expected classes, columns = sorted expected union predicted, 0 when no pair.

    Its width is the number of labels, so the labels reach the driver: they are the
    classes of one evaluation. ``confusion_long`` has the same counts whatever their number.
    """
    counts = materialize(confusion_long(res), "confusion")   # pairs of classes, used twice
    values = [r["label"] for r in labels(counts).collect()]
    wide = counts.groupBy("expected").pivot("predicted", values).agg(F.first("count"))
    # zeros are filled by position, not by name: labels that differ only by case
    # ("Task", "task") are distinct classes but ambiguous names for Spark's
    # case-insensitive resolution
    names = wide.columns
    tmp = [f"_c{i}" for i in range(len(names))]
    w = wide.toDF(*tmp)
    w = w.select(tmp[0], *[F.coalesce(F.col(t), F.lit(0).cast("long")).alias(t) for t in tmp[1:]])
    # rows in sorted order of the expected class (one row per class: a tiny sort)
    return w.orderBy(tmp[0]).toDF(*names)


def class_report(res: DataFrame) -> DataFrame:
    """Per-class report lines (SCL-11, SCL-12): ``  type: 50.00% (1/2)``."""
    b = by_class(res)
    return b.select("expected", F.format_string("  %s: %s (%d/%d)", F.col("expected"),
                                                  percent(F.col("accuracy")), F.col("correct"),
                                                  F.col("count")).alias("line"),
                    cell(F.col("expected"), 18).alias("row_label"))


def ordered_report(res: DataFrame) -> DataFrame:
    """SORT-05: per-class lines in alphabetical order of the class, with their position.

    The window has no partition key on purpose: its input is one row per class
    (the classes), not the data.
    """
    b = by_class(res)
    return b.withColumn("position", F.row_number().over(Window.orderBy("expected")))
