"""Registered prompt, generator and label-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import prompt as pr
from ..functions import text as tx
from ..operators import completions as cp
from ..operators import generate as gn
from ..sources import catalogs as cg
from ..sources import fixtures as fx
from . import oracle_views as ov
from .q_retrieval import benchmark_queries, stored_index, text_neighbours
from .registry import register

W = ov.with_


def sql_str(s: str) -> str:
    """A Python string as a DuckDB string expression (quotes doubled, newlines as chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


BLOCK_SQL = """'--- Similar Ticket ' || CAST(rank AS VARCHAR) || ' (Key: ' || key || ', Similarity: '
  || printf('%.4f', similarity) || ') ---' || chr(10) || 'Text: ' || coalesce(text, '') || chr(10)
  || CASE WHEN coalesce(issuetype, '') <> '' THEN 'Original Issue Type: ' || issuetype || chr(10) ELSE '' END"""

BLOCKS_CTE = f"""blocks AS (
  SELECT query_id, string_agg({BLOCK_SQL}, '' ORDER BY rank) AS blocks FROM nn GROUP BY query_id)"""


def prompt_sql(summary_expr: str, blocks_expr: str) -> str:
    return (f"{sql_str(K.PROMPT_HEAD)} || 'Summary: ''' || coalesce({summary_expr}, '') || '''' || chr(10) || chr(10) || "
            f"{sql_str(K.PROMPT_CONTEXT)} || CASE WHEN {blocks_expr} IS NOT NULL AND {blocks_expr} <> '' THEN "
            f"{sql_str(K.PROMPT_SIMILAR_INTRO)} || {blocks_expr} || {sql_str(K.PROMPT_SIMILAR_END)} "
            f"ELSE {sql_str(K.PROMPT_NO_SIMILAR)} END || "
            f"{sql_str(K.PROMPT_CLASSES_HEAD + pr.class_list_text())} || {sql_str(K.PROMPT_TAIL)}")


NN = ov.text_neighbours(ov.BENCHMARK)


def completion_store(spark, sf) -> str:
    """Path of the completions, beside the index of the same table."""
    return stored_index(spark, sf) + "-completions"


def text_prompts(spark, sf):
    return pr.rag_prompts(text_neighbours(spark, sf), benchmark_queries(spark, sf))


@register("job_03", W(NN, BLOCKS_CTE) + f"""
SELECT t.query_id, {prompt_sql('t.summary', 'b.blocks')} AS prompt
FROM testset t LEFT JOIN blocks b ON b.query_id = t.query_id""")
def job_03(spark, sf):
    return text_prompts(spark, sf)


@register("agg_23", W(NN, BLOCKS_CTE) + "\nSELECT query_id, blocks FROM blocks")
def agg_23(spark, sf):
    return pr.neighbour_text(text_neighbours(spark, sf))


@register("scl_15", W(NN) + f"\nSELECT query_id, rank, {BLOCK_SQL} AS block FROM nn")
def scl_15(spark, sf):
    n = text_neighbours(spark, sf)
    return n.select("query_id", "rank", pr.neighbour_block(
        F.col("rank"), F.col("key"), F.col("similarity"), F.col("text"), F.col("issuetype")).alias("block"))


@register("scl_16", W(NN, BLOCKS_CTE) + f"""
SELECT t.query_id, {prompt_sql('t.summary', 'b.blocks')} AS prompt
FROM (SELECT query_id, summary FROM testset UNION ALL SELECT key, summary FROM issues_text) t
     LEFT JOIN blocks b ON b.query_id = t.query_id""")
def scl_16(spark, sf):
    """Prompts for every benchmark text and every document; nothing was searched for the
    documents, so they get the "No similar historical tickets" branch."""
    q = fx.issues_text(spark, sf).select(F.col("key").alias("query_id"), "summary")
    return pr.rag_prompts(text_neighbours(spark, sf), benchmark_queries(spark, sf).unionByName(q))


@register("scl_14", """
SELECT r.r_name AS repo, n.n_name AS name, '- ' || n.n_name || ': is ' || lower(n.n_name) || chr(10) AS line
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE strpos(r.r_name, 'A') > 0""")
def scl_14(spark, sf):
    """Class-list lines over a catalog (link types: name + inward text as description)."""
    c = cg.catalog(spark, sf, "linktype").where(F.col("name").isNotNull())
    return c.select("repo", "name", pr.class_line(F.col("name"), F.col("inward")).alias("line"))


# the nearest-label generator answers with the type of the first neighbour that has one
FIRST_TYPED = """first_typed AS (
  SELECT query_id, arg_min(issuetype, rank) AS label FROM nn WHERE coalesce(issuetype, '') <> '' GROUP BY query_id)"""
_ANSWER = "'Issuetype: ' || label || chr(10) || 'Reasoning: most similar historical ticket.'"


@register("udf_02", W(NN, FIRST_TYPED) + f"""
SELECT query_id, {_ANSWER} AS llm_output, CAST(NULL AS VARCHAR) AS error FROM first_typed""")
def udf_02(spark, sf):
    """Each prompt is sent once: answers come from the store of completions."""
    return cp.complete(text_prompts(spark, sf), completion_store(spark, sf), gn.make_generator("nearest"))


@register("scl_19", W(NN, FIRST_TYPED) + f"""
SELECT query_id, {_ANSWER} AS completion FROM first_typed""")
def scl_19(spark, sf):
    """A local model echoes the prompt before its answer; keep what follows it."""
    p = text_prompts(spark, sf)
    s = gn.score(p, gn.make_generator("nearest"))
    echoed = p.join(s, "query_id").select(
        "query_id", "prompt", F.concat(F.col("prompt"), F.lit("\n  "), F.col("llm_output")).alias("gen"))
    return echoed.select("query_id", tx.completion_after_prompt(F.col("gen"), F.col("prompt")).alias("completion"))


@register("scl_17", W(ov.VECTORS) + """
SELECT key AS query_id, 2 AS n_messages, 'system' AS first_role, 'user' AS last_role FROM vectors""")
def scl_17(spark, sf):
    p = fx.vectors(spark, sf).select(F.col("key").alias("query_id"), "summary")
    m = tx.chat_messages(F.col("summary"), "You classify tickets.")
    return p.select("query_id", m.alias("m")).select(
        "query_id", F.size("m").alias("n_messages"), F.col("m")[0]["role"].alias("first_role"),
        F.element_at("m", -1)["role"].alias("last_role"))


# SCL-01 over generator-style outputs derived from every document: the output
# format varies with the document (a formatting choice, every row is kept).
OUTPUT_VARIANTS_SPARK = [
    lambda lang, first: F.concat(F.lit("Issuetype: "), lang),
    lambda lang, first: F.concat(F.lit("**Issuetype:** "), lang, F.lit(".")),
    lambda lang, first: F.concat(F.lit("Reasoning first\nISSUETYPE: "), lang, F.lit(" -")),
    lambda lang, first: F.concat(F.lit("issuetype: issuetype\nIssuetype: "), lang),
    lambda lang, first: first,
    lambda lang, first: F.concat(F.lit("Label Issuetype:\r\nIssuetype:   "), lang, F.lit(" :")),
]
EXPECTED_VARIANTS_SQL = [
    "lang", "'** ' || lang", "lang", "lang",
    "'Unknown'", "lang",
]


def _variant_outputs(spark, sf):
    docs = fx.issues_text(spark, sf)
    v = F.pmod(F.col("_id"), F.lit(len(OUTPUT_VARIANTS_SPARK)))
    out = F.lit(None).cast("string")
    for i, f in enumerate(OUTPUT_VARIANTS_SPARK):
        out = F.when(v == i, f(F.col("issuetype"), F.col("summary"))).otherwise(out)
    return docs.select("key", out.alias("llm_output"))


@register("scl_01", W(ov.ISSUES_TEXT) + """
SELECT key, CASE (_id % 6) """ + " ".join(
    f"WHEN {i} THEN {e}" for i, e in enumerate(EXPECTED_VARIANTS_SQL)) + """ END AS predicted
FROM (SELECT _id, key, issuetype AS lang, summary AS first FROM issues_text)""")
def scl_01(spark, sf):
    o = _variant_outputs(spark, sf)
    return o.select("key", tx.extract_issuetype("llm_output").alias("predicted"))


@register("scl_11", W(NN) + """
SELECT query_id, rank, printf('%.4f', similarity) AS sim_text,
       printf('%.2f', round(similarity * 100, 2)) || '%' AS sim_percent FROM nn""")
def scl_11(spark, sf):
    n = text_neighbours(spark, sf)
    return n.select("query_id", "rank", tx.fixed(F.col("similarity"), 4).alias("sim_text"),
                    tx.percent(F.round(F.col("similarity") * 100, 2) / 100).alias("sim_percent"))


@register("scl_12", W(ov.VECTORS) + """
SELECT DISTINCT issuetype AS label, rpad(issuetype, 10, ' ') AS header_cell, rpad(issuetype, 18, ' ') AS row_cell
FROM vectors""")
def scl_12(spark, sf):
    v = fx.vectors(spark, sf).select(F.col("issuetype").alias("label")).distinct()
    return v.select("label", tx.cell(F.col("label"), 10).alias("header_cell"),
                    tx.cell(F.col("label"), 18).alias("row_cell"))


@register("scl_13", W(ov.ISSUES_TEXT) + """
SELECT key, TRUE AS roundtrip_ok FROM issues_text""")
def scl_13(spark, sf):
    """JSON encode each test-set row (nulls kept) and decode it back."""
    t = fx.issues_text(spark, sf)
    j = t.select("key", "summary", "description", "issuetype",
                 tx.to_json_line(F.col("summary"), F.col("description"),
                                 F.col("issuetype").alias("expected_issuetype")).alias("line"))
    back = F.from_json("line", "summary string, description string, expected_issuetype string")
    same = (back["summary"].eqNullSafe(F.col("summary"))
            & back["description"].eqNullSafe(F.col("description"))
            & back["expected_issuetype"].eqNullSafe(F.col("issuetype"))
            & F.col("line").contains('"description":'))
    return j.select("key", same.alias("roundtrip_ok"))
