"""Registered retrieval queries: index text, embeddings, exact top-k neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import TASK_DESCRIPTION
from ..functions.embedding import DigestEncoder, embed
from ..functions.vectors import inner_product, l2_norm, normalize
from ..operators import cells as cl
from ..operators import index as ix
from ..operators import neighbours as nb
from ..operators import search
from ..session import scratch_path, scratch_root
from ..sources import files, tables
from ..sources import fixtures as fx
from ..sources.issues import TEXT_PATHS, flatten_issues, index_text, query_text, read_issues
from . import oracle_views as ov
from .registry import register


def _vq(spark, sf):
    v = fx.vectors(spark, sf)
    return v, v.select(F.col("key").alias("query_id"), "embedding")


ENCODER = DigestEncoder(ov.DIM)


def stored_index(spark, sf) -> str:
    """Path of this application's index of all documents, built where the store's ledger does not have the table yet.

    The store's name and the batch's name follow the table's files: another or a changed table is another batch.
    """
    mark = files.fingerprint(spark, f"{sf}/documents.parquet")
    root = f"{scratch_root(spark)}/index-{mark}"
    search.add(spark, root, fx.issues_doc(spark, sf), ENCODER, batch=mark)
    return root


def benchmark_queries(spark, sf):
    """(query_id, summary): texts of the benchmark."""
    b = tables.table(spark, sf, "benchmark")
    return b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"),
                    F.coalesce("text", F.lit("")).alias("summary"))


def text_neighbours(spark, sf, k=3):
    """Every benchmark text against the stored index of all documents."""
    return search.search(spark, stored_index(spark, sf), benchmark_queries(spark, sf), k, ENCODER, text="summary")


_NN_SQL = ov.with_(ov.text_neighbours(ov.BENCHMARK)) + """
SELECT query_id, rank, key, round(similarity, 4) AS similarity, issuetype FROM nn"""


@register("job_02", _NN_SQL)
def job_02(spark, sf):
    """Text queries over a stored, checked index."""
    n = text_neighbours(spark, sf)
    return n.select("query_id", "rank", "key", F.round("similarity", 4).alias("similarity"),
                    "issuetype")


@register("join_01", ov.with_(ov.neighbours(3)) + """
SELECT query_id, rank, key, round(similarity, 4) AS similarity, issuetype FROM nn""")
def join_01(spark, sf):
    """Exact top 3 of every vector against all others, cells that cannot matter skipped."""
    v, q = _vq(spark, sf)
    rows, found = cl.cell_index(v.where("key IS NOT NULL"))
    n, _ = cl.search(q.where("query_id IS NOT NULL"), rows, found, k=3, exclude_self=True)
    n = n.dropDuplicates(["query_id", "rank"])   # a key that comes again has its metadata as often
    return n.select("query_id", "rank", "key", F.round("similarity", 4).alias("similarity"),
                    "issuetype")


@register("win_01", ov.with_(ov.text_neighbours(ov.BENCHMARK)) + """
SELECT query_id, key, rank FROM nn""")
def win_01(spark, sf):
    return text_neighbours(spark, sf).select("query_id", "key", "rank")


@register("sort_04", ov.with_(ov.text_neighbours(ov.BENCHMARK, 5)) + """
SELECT query_id, rank, key, round(similarity, 4) AS similarity FROM nn""")
def sort_04(spark, sf):
    n = text_neighbours(spark, sf, k=5)
    return n.select("query_id", "rank", "key", F.round("similarity", 4).alias("similarity"))


@register("prj_05", ov.with_(ov.text_neighbours(ov.BENCHMARK)) + """
SELECT query_id, rank, key AS issue_key, round(similarity, 4) AS similarity,
       coalesce(text, '') AS text, coalesce(issuetype, '') AS issuetype FROM nn""")
def prj_05(spark, sf):
    n = nb.neighbour_rows(text_neighbours(spark, sf))
    return n.withColumn("similarity", F.round("similarity", 4))


@register("join_02", ov.with_(ov.text_neighbours(ov.BENCHMARK)) + """
SELECT query_id, key, issuetype, CAST(length(text) AS INTEGER) AS text_chars FROM nn""")
def join_02(spark, sf):
    n = text_neighbours(spark, sf)
    return n.select("query_id", "key", "issuetype", F.length("text").alias("text_chars"))


def centroids(v):
    """Per-class mean vector, unit length (dimension-wise average, no collect of rows)."""
    e = v.select("issuetype", F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy("issuetype", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = m.groupBy("issuetype").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))),
                    lambda s: s["x"].cast("float")).alias("embedding"))
    return c.select(F.col("issuetype").alias("key"), normalize("embedding").alias("embedding"),
                    "issuetype")


@register("flt_08", ov.with_(ov.VECTORS) + """
SELECT key AS query_id, CAST((SELECT count(DISTINCT issuetype) FROM vectors) AS BIGINT) AS n_neighbours
FROM vectors""")
def flt_08(spark, sf):
    """k larger than the corpus (class centroids): every query gets all of them, no padding."""
    v, q = _vq(spark, sf)
    n = nb.similar(q, centroids(v), k=20)
    return n.groupBy("query_id").agg(F.count("*").alias("n_neighbours"))


@register("scl_09", ov.with_(ov.VECTORS) + """
SELECT key, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm_in,
       CAST(CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS norm_out
FROM vectors""")
def scl_09(spark, sf):
    v = fx.vectors(spark, sf)
    u = v.select("key", "embedding", normalize("embedding").alias("unit"))
    return u.select("key", F.round(l2_norm("embedding"), 6).alias("norm_in"),
                    F.round(l2_norm("unit"), 6).alias("norm_out"))


@register("scl_10", ov.with_(ov.VECTORS, """el AS (
  SELECT issuetype, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM vectors)""", """cm AS (
  SELECT issuetype, pos, avg(CAST(x AS DOUBLE)) AS x FROM el GROUP BY issuetype, pos)""", """cv AS (
  SELECT issuetype, list(x ORDER BY pos) AS m FROM cm GROUP BY issuetype)""") + """
SELECT v.key, round(list_inner_product(CAST(v.embedding AS DOUBLE[]), cv.m), 4) AS to_centroid
FROM vectors v JOIN cv ON v.issuetype = cv.issuetype""")
def scl_10(spark, sf):
    """Inner product of every vector with the (unnormalised) mean of its class."""
    v = fx.vectors(spark, sf)
    e = v.select("issuetype", F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy("issuetype", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = m.groupBy("issuetype").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m"))
    j = v.join(c, "issuetype")   # one row per class, size-checked
    return j.select("key", F.round(inner_product("embedding", "m"), 4).alias("to_centroid"))


@register("prj_03", ov.with_(ov.VECTORS) + f"""
SELECT key AS query_id, 'Instruct: {TASK_DESCRIPTION}' || chr(10) || 'Query: ' || summary AS query_text
FROM vectors""")
def prj_03(spark, sf):
    v = fx.vectors(spark, sf)
    return query_text(v.select(F.col("key").alias("query_id"), "summary"), "summary").select(
        "query_id", "query_text")


@register("prj_02", ov.with_(ov.ISSUES_TEXT) + """
SELECT key, coalesce(summary, '') || ' ' || coalesce(description, '') AS text FROM issues_text""")
def prj_02(spark, sf):
    return index_text(flatten_issues(fx.issues_doc(spark, sf))).select("key", "text")


@register("prj_01", ov.with_(ov.ISSUES_TEXT) + """
SELECT key, coalesce(summary, '') AS summary, coalesce(description, '') AS description,
       coalesce(issuetype, '') AS issuetype FROM issues_text""")
def prj_01(spark, sf):
    return flatten_issues(fx.issues_doc(spark, sf)).select(
        "key", "summary", "description", "issuetype")


@register("src_01", ov.with_(ov.ISSUES_TEXT) + """
SELECT repo, key, coalesce(summary, '') AS summary, coalesce(issuetype, '') AS issuetype FROM issues_text""")
def src_01(spark, sf):
    """Issue documents as they are stored, scanned with the narrow schema of the text columns."""
    path = scratch_path(spark, "documents")
    fx.issues_doc(spark, sf).withColumn("_id", F.col("_id").cast("string")).write.parquet(path)
    return flatten_issues(read_issues(spark, path, TEXT_PATHS), keep=("repo",)).select(
        "repo", "key", "summary", "issuetype")


@register("prj_04", ov.with_(ov.VECTORS) + """
SELECT key AS issue_key, issuetype, text FROM vectors""")
def prj_04(spark, sf):
    return ix.metadata(fx.vectors(spark, sf).withColumnRenamed("key", "issue_key"))


# the vector itself: its number of dimensions, its length, and its product with 1, 2, 3, ...
_VECTOR_SQL = (f"CAST(len(v) AS INTEGER) AS dim, round(sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 4) AS norm, "
               f"round(list_inner_product(CAST(v AS DOUBLE[]), CAST(range(1, {ov.DIM + 1}) AS DOUBLE[])), 3) AS weighted")
_VECTORS = ov.with_(ov.text_neighbours(ov.BENCHMARK))


def vector_columns(embedding="embedding"):
    ramp = F.transform(F.sequence(F.lit(1), F.lit(ov.DIM)), lambda i: i.cast("double"))
    return [F.size(embedding).alias("dim"), F.round(l2_norm(embedding), 4).alias("norm"),
            F.round(inner_product(F.col(embedding), ramp), 3).alias("weighted")]


@register("job_01", _VECTORS + f"""
SELECT key AS issue_key, issuetype, text, {_VECTOR_SQL} FROM nn_vectors JOIN index_rows ON key = id AND side = 'c'""")
def job_01(spark, sf):
    idx = ix.build_index(fx.issues_doc(spark, sf), ENCODER)
    return idx.select("issue_key", "issuetype", "text", *vector_columns())


@register("udf_01", _VECTORS + f"""
SELECT id AS key, {_VECTOR_SQL} FROM nn_vectors WHERE side = 'c'""")
def udf_01(spark, sf):
    t = index_text(flatten_issues(fx.issues_doc(spark, sf)))
    return embed(t, "text", encoder=ENCODER).select("key", *vector_columns())
