"""Registered landing, comment, definition-file and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from .. import sinks
from ..operators import comments as cm
from ..operators import evaluate as ev
from ..operators import index as ix
from ..operators import landed as dl
from ..operators import requests as rq
from ..operators import search
from ..operators import snapshot as sn
from ..operators.profile import size0
from ..session import scratch_path
from ..sources import catalogs as cg
from ..sources import fixtures as fx
from ..sources import landed_fixtures as lf
from ..sources import landing as ld
from ..sources import testset as ts
from ..sources.tables import table
from . import oracle_views as ov
from .q_evaluation import NN, evaluation
from .q_retrieval import _VECTOR_SQL, ENCODER, vector_columns
from .q_text import BLOCKS_CTE, prompt_sql
from .q_text import NN as NN_BENCHMARK
from .registry import register

W = ov.with_

URL_SQL = "'https://tracker.' || lower(replace({c}, ' ', '-')) || '.invalid'"
TOTALS_SQL = f"""totals AS (
  SELECT repo AS source, {URL_SQL.format(c='repo')} AS jira_url, count(*) AS total FROM tracker GROUP BY repo)"""
PLAN_SQL = """plan AS (
  SELECT source, jira_url, total, start_at, least(250, total - start_at) AS max_results
  FROM (SELECT source, jira_url, total, unnest(range(0, total, 250)) AS start_at FROM totals))"""


# ------------------------------------------------------------------ landing

def landing_store(spark, sf, extra=None) -> str:
    """Path of a store into which all search pages and the faulty ones were landed."""
    root = scratch_path(spark, "landing")
    pages = lf.search_pages(spark, sf)
    pages = pages if extra is None else pages.unionByName(extra(pages))
    dl.land_pages(spark, root, pages.select("repo", "body").unionByName(lf.faulty_pages(spark, sf)), batch="pages")
    return root


@register("src_04", W(ov.TRACKER, ov.LINKS_ONLY) + """
SELECT t.repo, t.key, t.created, t.issuetype, t.project,
       CAST(coalesce(l.n, 0) AS INTEGER) AS n_links,
       CASE WHEN t.o_orderstatus = 'P' THEN 'EPIC-' || CAST(t.o_custkey AS VARCHAR) END AS epic
FROM tracker t LEFT JOIN (SELECT key, count(*) AS n FROM links GROUP BY key) l ON l.key = t.key""")
def src_04(spark, sf):
    i = dl.landed_issues(spark, landing_store(spark, sf))
    r = fx.repos(spark, sf).select("repo", "epic_field")
    j = i.join(r, "repo", "left")
    return j.select("repo", "key", F.col("fields.created").alias("created"),
                    F.col("fields.issuetype.name").alias("issuetype"),
                    F.col("fields.project.name").alias("project"),
                    size0("fields.issuelinks").alias("n_links"),
                    F.try_element_at("fields.custom_fields", F.col("epic_field")).alias("epic"))


@register("src_04_rejects", """
SELECT r_name AS repo, 'Rate limit exceeded' AS reason, CAST(1 AS BIGINT) AS n FROM region""")
def src_04_rejects(spark, sf):
    """Rejects that are left open after those that were no JSON came again as an empty page."""
    root = landing_store(spark, sf)
    mended = dl.open_rejects(spark, root).where("reason = 'no JSON'").select(
        "page_id", F.lit('{"total":0,"startAt":0,"issues":[]}').alias("body"))
    dl.replay(spark, root, mended, batch="mended")
    return dl.open_rejects(spark, root).groupBy("repo", "reason").agg(F.count("*").alias("n"))


@register("src_05", W(ov.TRACKER, TOTALS_SQL, PLAN_SQL) + """
SELECT source, start_at, max_results,
       jira_url || '/rest/api/2/search?jql=&ORDER%20BY%20created%20ASC&startAt=' || CAST(start_at AS VARCHAR)
       || '&maxResults=' || CAST(max_results AS VARCHAR) || '&expand=changelog' AS url FROM plan""")
def src_05(spark, sf):
    return ld.plan_pages(lf.source_totals(spark, sf))


INVALID = ["MIDDLE EAST"]


@register("flt_06", W(ov.TRACKER, TOTALS_SQL, PLAN_SQL) + f"""
SELECT source, start_at FROM plan WHERE source NOT IN ({', '.join(repr(s) for s in INVALID)})""")
def flt_06(spark, sf):
    invalid = spark.createDataFrame([(s,) for s in INVALID], "source string")
    p = ld.plan_pages(ld.exclude_invalid(lf.source_totals(spark, sf), invalid))
    return p.select("source", "start_at")


@register("src_06", W(ov.ISSUES_TEXT) + """
SELECT t.repo, count(*) AS total, count(l.doc_id) AS landed, count(*) - count(l.doc_id) AS missing
FROM issues_text t LEFT JOIN labels l ON l.doc_id = t._id GROUP BY t.repo""")
def src_06(spark, sf):
    """Documents announced per source vs those landed (labelled)."""
    lab = fx.labelled(spark, sf).where(F.col("quality").isNotNull())
    totals = fx.issues_text(spark, sf).groupBy(F.col("repo").alias("source")).agg(
        F.count("*").alias("total"))
    return ld.audit_landing(lab, totals)


@register("src_06_ranges", W(ov.TRACKER) + """,
pages AS (SELECT repo, o_orderkey // 250 * 250 AS s, o_orderkey // 250 * 250 + count(*) AS e FROM tracker GROUP BY repo, o_orderkey // 250),
totals AS (SELECT repo, count(*) AS total FROM tracker GROUP BY repo),
seen AS (SELECT p.*, total, coalesce(max(e) OVER (PARTITION BY p.repo ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
         FROM pages p JOIN totals t ON t.repo = p.repo),
ranges AS (
  SELECT repo, 'missing' AS kind, reached AS s, least(s, total) AS e FROM seen
  UNION ALL SELECT repo, 'missing', max(e), any_value(total) FROM seen GROUP BY repo
  UNION ALL SELECT repo, 'double', s, e FROM pages WHERE s % 1250 = 0)
SELECT repo, kind, CAST(s AS BIGINT) AS start, CAST(e - s AS BIGINT) AS length FROM ranges WHERE e > s""")
def src_06_ranges(spark, sf):
    """Ranges of issues missing against the announced totals, and ranges landed twice (every fifth page came again)."""
    return dl.page_coverage(spark, landing_store(spark, sf, lambda pages: pages.where("page_no % 5 = 0")))


_COMMENT_STATUS_SQL = W(ov.TRACKER) + """,
cv AS (SELECT DISTINCT conv_id FROM conversations),
st AS (SELECT t.key, CASE WHEN cv.conv_id IS NOT NULL THEN 'ok' WHEN t.o_orderstatus = 'F' THEN 'skip'
                          WHEN t.o_orderstatus = 'P' THEN 'fail' ELSE 'ok' END AS status
       FROM tracker t LEFT JOIN cv ON cv.conv_id = t.o_orderkey)"""


@register("flt_07", _COMMENT_STATUS_SQL + "\nSELECT key, status FROM st")
def flt_07(spark, sf):
    return ld.triage_comment_pages(lf.comment_pages(spark, sf)).select("key", "status")


@register("flt_09", W(ov.TRACKER, TOTALS_SQL, PLAN_SQL) + """
SELECT source, start_at, 503 AS status FROM plan WHERE max_results < 250""")
def flt_09(spark, sf):
    """Fetch log of the page plan (a cut last page was answered 503): pages to fetch again."""
    p = ld.plan_pages(lf.source_totals(spark, sf))
    log = p.select("source", "start_at",
                   F.when(F.col("max_results") < 250, F.lit(503)).otherwise(F.lit(200)).alias("status"))
    return ld.retry_requests(log)


@register("scl_18", W(ov.TRACKER) + f"""
SELECT key, {URL_SQL.format(c='repo')} || '/rest/api/2/issue/' || key
       || '/comment?orderBy=created&startAt=0&maxResults=50' AS url FROM tracker""")
def scl_18(spark, sf):
    t = fx.tracker(spark, sf, ())
    return t.select("key", ld.comment_url(lf.jira_url(F.col("repo")), F.col("key")).alias("url"))


BY_ISSUE = ["repo", "key"]

ROUNDS_SQL = W(ov.TRACKER) + """,
cn AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
st AS (SELECT t.repo, t.key,
              CASE WHEN n IS NULL THEN CASE o_orderstatus WHEN 'F' THEN 'refused' WHEN 'P' THEN 'incomplete' ELSE 'complete' END
                   WHEN o_orderkey % 11 = 7 OR (o_orderkey % 7 = 5 AND n > 3) THEN 'incomplete' ELSE 'complete' END AS state,
              CAST(CASE WHEN n IS NULL OR o_orderkey % 11 = 7 THEN 0 WHEN o_orderkey % 7 = 5 THEN least(n, 3) ELSE n END AS BIGINT) AS landed
       FROM tracker t LEFT JOIN cn ON cn.conv_id = t.o_orderkey)"""


def comment_store(spark, sf) -> str:
    """Path of the outcomes and comments of all rounds: asked until nothing is left to ask."""
    root = scratch_path(spark, "comments")
    rq.fetch_rounds(spark, root, lf.comment_requests(spark, sf), lf.comment_server(spark, sf), BY_ISSUE, ld.comment_page(), "comments",
                    lf.ROUND_SIZE, lf.ROUND_ATTEMPTS)
    return root


@register("scl_18_rounds", ROUNDS_SQL + "\nSELECT repo, key, state, landed FROM st")
def scl_18_rounds(spark, sf):
    """Comment pages asked for over several rounds: further pages, retries, totals that grew."""
    return rq.state(sn.read(spark, comment_store(spark, sf)), BY_ISSUE).select("repo", "key", "state", "landed")


@register("job_07", ROUNDS_SQL + """
SELECT repo, count(*) AS issues, count(*) FILTER (WHERE state <> 'incomplete') AS with_comments,
       CAST(sum(CASE WHEN state = 'complete' THEN landed ELSE 0 END) AS BIGINT) AS comments FROM st GROUP BY repo""")
def job_07(spark, sf):
    """Land: search pages -> issues (newest copy of each) -> stored by tracker; comments fetched in rounds and merged into
    the stored table where their ranges cover the total or the request was refused (others stay pending)."""
    issues = scratch_path(spark, "issues")
    dl.store_issues(spark, issues, dl.landed_issues(spark, landing_store(spark, sf)))
    fetched = comment_store(spark, sf)
    done = rq.state(sn.read(spark, fetched), BY_ISSUE).where("state <> 'incomplete'").select(*BY_ISSUE)
    comments = rq.landed_items(spark, fetched, BY_ISSUE).select(*BY_ISSUE, "item.id", "item.created", "item.body")
    dl.merge_comments(spark, issues, comments.join(done, BY_ISSUE), done)
    landed = sn.read(spark, issues)
    return landed.groupBy("repo").agg(
        F.count("*").alias("issues"),
        F.count_if(F.col("fields.comments").isNotNull()).alias("with_comments"),
        F.sum(size0("fields.comments")).cast("long").alias("comments"))


# ------------------------------------------------------------------ comments

@register("flt_05", W(ov.TRACKER) + """
SELECT repo, key, created FROM tracker WHERE o_orderkey NOT IN (SELECT conv_id FROM conversations)
AND created >= '0'""")
def flt_05(spark, sf):
    return cm.pending_comments(fx.tracker(spark, sf, ("comments",))).select("repo", "key", "created")


@register("sort_06", W(ov.TRACKER) + """
SELECT key, created FROM tracker WHERE o_orderkey NOT IN (SELECT conv_id FROM conversations)
AND created >= '1997-01-01'""")
def sort_06(spark, sf):
    return cm.pending_comments(fx.tracker(spark, sf, ("comments",)), resume="1997-01-01").select(
        "key", "created")


@register("sort_07", W(ov.COMMENTS) + """
SELECT key, string_agg(id, ',' ORDER BY created, id) AS ids FROM comments GROUP BY key""")
def sort_07(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("string").alias("id"),
        F.lpad(F.col("turn").cast("string"), 4, "0").alias("created"), F.col("text").alias("body"))
    g = cm.collect_comments(c)
    return g.select("key", F.array_join(F.transform("comments", lambda x: x["id"]), ",").alias("ids"))


_ATTACH_SQL = W(ov.TRACKER) + """,
cc AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT t.key, CAST(coalesce(cc.n, 0) AS INTEGER) AS n_comments FROM tracker t LEFT JOIN cc ON cc.conv_id = t.o_orderkey"""


def _conversation_comments(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("string").alias("id"),
        F.lpad(F.col("turn").cast("string"), 4, "0").alias("created"), F.col("text").alias("body"))


def _attached(spark, sf):
    base = fx.tracker(spark, sf, ())
    work = cm.pending_comments(base)
    return cm.attach_comments(base, _conversation_comments(spark, sf), processed=work)


@register("snk_07", W(ov.TRACKER) + """,
cc AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT t.repo, t.key, CAST(cc.n AS INTEGER) AS n_comments FROM tracker t LEFT JOIN cc ON cc.conv_id = t.o_orderkey""")
def snk_07(spark, sf):
    """Comments merged into the stored issues; issues without a response keep what they have (nothing)."""
    root = scratch_path(spark, "issues")
    dl.store_issues(spark, root, fx.tracker(spark, sf, ()))
    t = fx.tracker(spark, sf, ()).select("repo", "key")
    c = _conversation_comments(spark, sf).join(t, "key")
    dl.merge_comments(spark, root, c, c.select("repo", "key").distinct())
    return sn.read(spark, root).select("repo", "key", F.size("fields.comments").alias("n_comments"))


@register("join_08", _ATTACH_SQL)
def join_08(spark, sf):
    a = _attached(spark, sf)
    return a.select("key", F.size("fields.comments").alias("n_comments"))


# ------------------------------------------------------- incremental / index

@register("join_07", W(ov.ISSUES_TEXT) + """
SELECT key FROM issues_text WHERE _id NOT IN (SELECT doc_id FROM labels)""")
def join_07(spark, sf):
    idx = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("issue_key"))
    return ix.pending(fx.issues_text(spark, sf), idx).select("key")


@register("src_02", W(ov.ISSUES_TEXT) + """
SELECT repo, key, coalesce(summary, '') || ' ' || coalesce(description, '') AS text
FROM issues_text WHERE _id NOT IN (SELECT doc_id FROM labels)""")
def src_02(spark, sf):
    """Resume: only what the index (here: the labelled documents) does not hold yet."""
    idx = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("issue_key"))
    p = ix.pending(fx.issues_text(spark, sf), idx)
    return p.select("repo", "key", F.concat(F.coalesce("summary", F.lit("")), F.lit(" "),
                                            F.coalesce("description", F.lit(""))).alias("text"))


def _two_step_index(spark, sf) -> str:
    """Index the labelled documents first, then all: the second commit adds what is still missing."""
    path = scratch_path(spark, "index")
    docs = fx.issues_doc(spark, sf)
    lab = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"))
    search.add(spark, path, docs.join(lab, "key", "left_semi"), ENCODER, batch="labelled")
    search.add(spark, path, docs, ENCODER, batch="all")
    return path


@register("snk_05", W(NN_BENCHMARK) + f"""
SELECT key AS issue_key, issuetype, {_VECTOR_SQL} FROM nn_vectors JOIN index_rows ON key = id AND side = 'c'""")
def snk_05(spark, sf):
    _, idx, _ = search.open_index(spark, _two_step_index(spark, sf))
    return idx.select("issue_key", "issuetype", *vector_columns())


@register("set_04", W(ov.ISSUES_TEXT) + """
SELECT key AS issue_key, issuetype, coalesce(summary, '') || ' ' || coalesce(description, '') AS text FROM issues_text""")
def set_04(spark, sf):
    return sn.read(spark, _two_step_index(spark, sf)).select("issue_key", "issuetype", "text")


@register("snk_06", W(ov.ISSUES_TEXT) + """
SELECT count(*) AS rows, count(DISTINCT key) AS keys, CAST(0 AS BIGINT) AS null_vectors,
       64 AS min_dim, 64 AS max_dim, TRUE AS consistent FROM issues_text""")
def snk_06(spark, sf):
    """Opened through the guard, which compares the store with its manifest and its ledger."""
    _, idx, _ = search.open_index(spark, _two_step_index(spark, sf))
    return ix.check_index(idx)


# ------------------------------------------------------------- definitions

@register("src_10", W(ov.TRACKER, TOTALS_SQL) + """
SELECT source, source AS name, jira_url, format('{:,}', total) AS rough_issue_count,
       jira_url || '/about' AS company_url FROM totals""")
def src_10(spark, sf):
    return cg.read_sources(lf.source_definitions(spark, sf)).select(
        "source", "name", "jira_url", "rough_issue_count", "company_url")


THEMES_SQL = W(ov.TRACKER) + """,
th AS (SELECT DISTINCT repo, issuetype, split_part(issuetype, '-', 2) AS theme, substr(issuetype, 1, 1) AS code
       FROM tracker)"""


@register("src_11", THEMES_SQL + "\nSELECT repo, issuetype, theme, code FROM th")
def src_11(spark, sf):
    return cg.read_themes(lf.theme_definitions(spark, sf))


@register("join_05", THEMES_SQL + """
SELECT t.key, h.theme, h.code FROM tracker t LEFT JOIN th h ON h.repo = t.repo AND h.issuetype = t.issuetype""")
def join_05(spark, sf):
    t = fx.tracker(spark, sf, ()).select("repo", "key", F.col("fields.issuetype.name").alias("issuetype"))
    return cg.with_theme(t, cg.read_themes(lf.theme_definitions(spark, sf))).select("key", "theme", "code")


@register("src_12", """
SELECT DISTINCT l_returnflag AS raw, 'type-' || lower(l_returnflag) AS canonical FROM lineitem WHERE l_returnflag <> 'N'""")
def src_12(spark, sf):
    return cg.read_linktype_map(lf.linktype_definitions(spark, sf))


@register("join_06", W(ov.LINKS) + """
SELECT key, link_id, link_type, CASE WHEN link_type <> 'N' THEN 'type-' || lower(link_type) ELSE link_type END AS canonical
FROM links""")
def join_06(spark, sf):
    t = fx.tracker(spark, sf, ("links",))
    links = t.select("key", F.explode("fields.issuelinks").alias("l")).select(
        "key", F.col("l.id").alias("link_id"), F.col("l.type.name").alias("link_type"))
    return cg.with_link_type(links, cg.read_linktype_map(lf.linktype_definitions(spark, sf))).select(
        "key", "link_id", "link_type", "canonical")


# ------------------------------------------------------------------- sinks

@register("snk_01", W(ov.ISSUES_TEXT) + """
SELECT summary, coalesce(description, '') AS description, issuetype AS expected_issuetype FROM issues_text
WHERE coalesce(summary, '') <> '' AND coalesce(issuetype, '') <> ''""")
def snk_01(spark, sf):
    rows = ts.usable(ts.testset_rows(fx.issues_text(spark, sf))).select(
        "summary", "description", "expected_issuetype")
    path = scratch_path(spark, "testset")
    sinks.write_jsonl(rows, path)
    return sinks.read_jsonl(spark, path, S.EVAL_ITEM)


@register("src_14", W(ov.ISSUES_TEXT) + """
SELECT issuetype AS expected_issuetype, count(*) AS n FROM issues_text
WHERE coalesce(summary, '') <> '' AND coalesce(issuetype, '') <> '' GROUP BY issuetype""")
def src_14(spark, sf):
    rows = ts.usable(ts.testset_rows(fx.issues_text(spark, sf))).select(
        "summary", "description", "expected_issuetype")
    path = scratch_path(spark, "testset")
    sinks.write_jsonl(rows, path)
    back = sinks.read_jsonl(spark, path, S.EVAL_ITEM)
    return back.groupBy("expected_issuetype").agg(F.count("*").alias("n"))


_RESULT_COLS = ["summary", "description", "expected", "predicted", "is_correct", "llm_output"]


def _written(spark, sf) -> str:
    """Folder with the files of one evaluation."""
    path = scratch_path(spark, "evaluation")
    ev.write_files(evaluation(spark, sf), path)
    return path


def _res_sql():
    from .q_evaluation import RES_SQL
    return RES_SQL + "\nSELECT " + ", ".join(_RESULT_COLS) + " FROM res"


@register("snk_02", _res_sql())
def snk_02(spark, sf):
    return sinks.read_jsonl(spark, f"{_written(spark, sf)}/results.jsonl", S.EVAL_RESULT)


@register("snk_03", _res_sql())
def snk_03(spark, sf):
    return sinks.read_csv(spark, f"{_written(spark, sf)}/results.csv", S.EVAL_RESULT)


@register("snk_04", W(NN, BLOCKS_CTE) + f"""
SELECT t.query_id, {prompt_sql('t.summary', 'b.blocks')} AS prompt
FROM testset t LEFT JOIN blocks b ON b.query_id = t.query_id""")
def snk_04(spark, sf):
    return sinks.read_jsonl(spark, f"{_written(spark, sf)}/prompts.jsonl", "query_id string, prompt string")


@register("snk_08", W(ov.TRACKER) + "\nSELECT repo, key, issuetype FROM tracker")
def snk_08(spark, sf):
    path = scratch_path(spark, "issues")
    flat = fx.tracker(spark, sf, ()).select(
        "repo", "key", F.col("fields.issuetype.name").alias("issuetype"))
    sinks.append_partitioned(flat, path)
    return spark.read.parquet(path).select("repo", "key", "issuetype")


@register("snk_09", """
SELECT r.r_name AS repo, 'customfield_' || CAST(n.n_nationkey + 10000 AS VARCHAR) AS id, n.n_name AS name
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def snk_09(spark, sf):
    path = scratch_path(spark, "fields")
    sinks.write_jsonl(cg.catalog(spark, sf, "field").select("repo", "id", "name"), path)
    return sinks.read_jsonl(spark, path, "repo string, id string, name string")
