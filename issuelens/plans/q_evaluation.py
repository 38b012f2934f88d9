"""Registered evaluation queries: predictions from the generator, then metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import prompt as pr
from ..operators import evaluate as ev
from ..operators import generate as gn
from ..operators import search
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import testset as ts
from . import oracle_views as ov
from .q_retrieval import ENCODER, stored_index
from .q_text import FIRST_TYPED, completion_store
from .registry import register

W = ov.with_


TESTSET_ROW = "key string, summary string, description string, expected_issuetype string"


def written_testset(spark, sf):
    """The test set as JOB-06 makes it: a slice in order, usable rows, written as JSON lines and read again (SRC-14)."""
    path = scratch_path(spark, "testset")
    rows = ts.make_testset(fx.issues_text(spark, sf), skip=ov.TESTSET_SKIP, limit=ov.TESTSET_LIMIT)
    sinks.write_jsonl(rows.select("key", "summary", "description", "expected_issuetype"), path, skip_empty=False)
    return sinks.read_jsonl(spark, path, TESTSET_ROW).select(
        F.col("key").alias("query_id"), "summary", "description", F.col("expected_issuetype").alias("expected"))


def evaluation(spark, sf) -> ev.Evaluation:
    """JOB-04 over the stored index; completions that an earlier run has are not asked for again."""
    return ev.run(spark, written_testset(spark, sf), stored_index(spark, sf), completion_store(spark, sf),
                  gn.make_generator("nearest"), ENCODER)


def eval_results(spark, sf):
    return evaluation(spark, sf).results


# prediction of the nearest-label generator = first neighbour (by rank) with a type
NN = ov.text_neighbours(ov.TESTSET)
RES_SQL = W(NN, FIRST_TYPED, """res AS (
  SELECT v.query_id, v.summary, v.description, v.expected,
         coalesce(f.label, 'Unknown') AS predicted,
         lower(coalesce(f.label, 'Unknown')) = lower(v.expected) AS is_correct,
         CASE WHEN f.label IS NULL THEN 'Reasoning: no similar tickets were given.'
              ELSE 'Issuetype: ' || f.label || chr(10) || 'Reasoning: most similar historical ticket.' END AS llm_output
  FROM testset v LEFT JOIN first_typed f ON f.query_id = v.query_id)""")


@register("job_04", RES_SQL + "\nSELECT query_id, expected, predicted, is_correct FROM res")
def job_04(spark, sf):
    return eval_results(spark, sf).select("query_id", "expected", "predicted", "is_correct")


@register("prj_06", RES_SQL + "\nSELECT summary, description, expected, predicted, is_correct, llm_output FROM res")
def prj_06(spark, sf):
    return eval_results(spark, sf).select("summary", "description", "expected", "predicted",
                                          "is_correct", "llm_output")


@register("join_03", RES_SQL + "\nSELECT query_id, expected, predicted FROM res")
def join_03(spark, sf):
    return eval_results(spark, sf).select("query_id", "expected", "predicted")


@register("scl_02", RES_SQL + "\nSELECT query_id, is_correct FROM res")
def scl_02(spark, sf):
    return eval_results(spark, sf).select("query_id", "is_correct")


@register("agg_18", RES_SQL + """
SELECT CAST(count(*) FILTER (WHERE is_correct) AS BIGINT) AS correct, count(*) AS total,
       round(coalesce(avg(CAST(is_correct AS INTEGER)), 0.0), 4) AS accuracy FROM res""")
def agg_18(spark, sf):
    a = ev.accuracy(eval_results(spark, sf))
    return a.select("correct", "total", F.round("accuracy", 4).alias("accuracy"))


@register("agg_19", RES_SQL + """
SELECT expected, CAST(count(*) FILTER (WHERE is_correct) AS BIGINT) AS correct, count(*) AS count,
       round(avg(CAST(is_correct AS INTEGER)), 4) AS accuracy FROM res GROUP BY expected""")
def agg_19(spark, sf):
    b = ev.by_class(eval_results(spark, sf))
    return b.select("expected", "correct", "count", F.round("accuracy", 4).alias("accuracy"))


@register("agg_20", RES_SQL + "\nSELECT predicted, count(*) AS count FROM res GROUP BY predicted")
def agg_20(spark, sf):
    return ev.predictions_per_class(eval_results(spark, sf))


@register("agg_21", RES_SQL + """
SELECT expected, predicted, count(*) AS count FROM res GROUP BY expected, predicted""")
def agg_21(spark, sf):
    return ev.confusion_long(eval_results(spark, sf))


@register("set_03", RES_SQL + """
SELECT label FROM (SELECT expected AS label FROM res UNION SELECT predicted FROM res)""")
def set_03(spark, sf):
    return ev.labels(eval_results(spark, sf))


# the labels of the fixture are its four languages: the wide matrix has one column for each
LANGUAGES = ("de", "en", "es", "fr")


@register("agg_22", RES_SQL + "\nSELECT expected, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE predicted = '{x}') AS BIGINT) AS {x}" for x in LANGUAGES) + " FROM res GROUP BY expected")
def agg_22(spark, sf):
    return ev.confusion_wide(eval_results(spark, sf))


class ContextOnlyGenerator(gn.NearestLabelGenerator):
    """Fails on prompts without neighbours (stands for a back end that errors)."""

    def generate(self, prompt, max_new_tokens=512, system_prompt=None):
        if "Original Issue Type: " not in prompt:
            raise RuntimeError("no context to answer from")
        return super().generate(prompt, max_new_tokens, system_prompt)


@register("scl_03", W(NN, FIRST_TYPED) + """
SELECT t.key AS query_id, coalesce(f.label, 'ERROR_QUERY_FAILED') AS predicted,
       CASE WHEN f.label IS NULL THEN 'ERROR: Query command failed or returned None'
            ELSE 'Issuetype: ' || f.label || chr(10) || 'Reasoning: most similar historical ticket.' END AS llm_output,
       f.label IS NOT NULL AND lower(f.label) = lower(t.issuetype) AS is_correct
FROM issues_text t LEFT JOIN first_typed f ON f.query_id = t.key""")
def scl_03(spark, sf):
    """Every document is an item; only those of the test set were searched for, so the generator fails on the others."""
    q = fx.issues_text(spark, sf).select(F.col("key").alias("query_id"), "summary", "description",
                                         F.col("issuetype").alias("expected"))
    neighbours = search.search(spark, stored_index(spark, sf), written_testset(spark, sf).select("query_id", "summary"),
                               3, ENCODER, exclude_self=True, text="summary")
    prompts = pr.rag_prompts(neighbours, q.select("query_id", "summary"))
    pred = gn.predict(gn.score(prompts, ContextOnlyGenerator()))
    r = ev.results(pred, q)
    return r.select("query_id", "predicted", "llm_output", "is_correct")


# ----------------------------------------------------------- held-out slice

SLICE_SQL = W(ov.ISSUES_TEXT) + """,
sl AS (SELECT * FROM issues_text ORDER BY _id OFFSET {skip} LIMIT {limit})"""


@register("job_06", SLICE_SQL.format(skip=900, limit=10) + """
SELECT key, summary, coalesce(description, '') AS description, issuetype AS expected_issuetype FROM sl
WHERE coalesce(summary, '') <> '' AND coalesce(issuetype, '') <> ''""")
def job_06(spark, sf):
    return ts.make_testset(fx.issues_text(spark, sf), skip=900, limit=10).select(
        "key", "summary", "description", "expected_issuetype")


@register("src_03", SLICE_SQL.format(skip=900, limit=10) + "\nSELECT _id, key FROM sl")
def src_03(spark, sf):
    return ts.slice_by_order(fx.issues_text(spark, sf), "_id", 900, 10).select("_id", "key")


@register("sort_01", SLICE_SQL.format(skip=100, limit=50) + "\nSELECT _id, key FROM sl")
def sort_01(spark, sf):
    """Deep-offset path: range partitions, per-partition counts, numbering inside partitions."""
    return ts.slice_by_order(fx.issues_text(spark, sf), "_id", 100, 50, strategy="ranked").select(
        "_id", "key")


@register("sort_03", SLICE_SQL.format(skip=250, limit=100) + "\nSELECT _id, key, repo FROM sl")
def sort_03(spark, sf):
    return ts.slice_by_order(fx.issues_text(spark, sf), "_id", 250, 100, strategy="take").select(
        "_id", "key", "repo")


@register("prj_07", W(ov.ISSUES_TEXT) + """
SELECT key, summary, coalesce(description, '') AS description, issuetype AS expected_issuetype FROM issues_text""")
def prj_07(spark, sf):
    return ts.testset_rows(fx.issues_text(spark, sf)).select(
        "key", "summary", "description", "expected_issuetype")


@register("flt_01", W(ov.ISSUES_TEXT) + """
SELECT key FROM issues_text WHERE coalesce(summary, '') <> '' AND coalesce(issuetype, '') <> ''""")
def flt_01(spark, sf):
    return ts.usable(ts.testset_rows(fx.issues_text(spark, sf))).select("key")


@register("sort_05", RES_SQL + """
SELECT expected, CAST(count(*) FILTER (WHERE is_correct) AS BIGINT) AS correct, count(*) AS count,
       CAST(row_number() OVER (ORDER BY expected) AS INTEGER) AS position FROM res GROUP BY expected""")
def sort_05(spark, sf):
    return ev.ordered_report(eval_results(spark, sf)).select("expected", "correct", "count", "position")
