"""Registered profile queries over the nested tracker fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import profile as pf
from ..operators import profile_store as ps
from ..session import scratch_path
from ..sources import catalogs as cg
from ..sources import fixtures as fx
from . import oracle_views as ov
from .registry import register

W = ov.with_

CAT_SQL = """cat_types AS (
  SELECT repo, name FROM (
    SELECT r.r_name AS repo, substr(n.n_name, 1, 1) AS name,
           row_number() OVER (PARTITION BY r.r_name, substr(n.n_name, 1, 1) ORDER BY n.n_nationkey DESC) AS rn
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) WHERE rn = 1),
cat_links AS (
  SELECT r.r_name AS repo, n.n_name AS name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE strpos(r.r_name, 'A') > 0)"""

METRICS_SQL = """iss AS (SELECT repo, count(*) AS issues FROM tracker GROUP BY repo),
uit AS (SELECT repo, count(DISTINCT name) AS uit FROM (
          SELECT repo, issuetype AS name FROM tracker
          UNION ALL SELECT repo, fromString FROM changes WHERE field = 'issuetype') GROUP BY repo),
up AS (SELECT repo, count(DISTINCT name) AS up FROM (
          SELECT repo, project AS name FROM tracker
          UNION ALL SELECT repo, fromString FROM changes WHERE field = 'project') GROUP BY repo),
dl AS (SELECT repo, count(DISTINCT link_id) AS distinct_links, count(DISTINCT link_type) AS ult FROM links GROUP BY repo),
st AS (SELECT repo, count(*) AS subtasks FROM links WHERE l_linestatus = 'F' GROUP BY repo),
ep AS (SELECT repo, count(*) AS epics FROM tracker WHERE o_orderstatus = 'P' GROUP BY repo),
ch AS (SELECT repo, count(*) AS changes FROM changes GROUP BY repo),
cm AS (SELECT repo, count(*) AS comments FROM comments GROUP BY repo),
bn AS (SELECT e.repo, substr(e.created, 1, 4) AS born, e.created AS born_created FROM (
          SELECT repo, created, row_number() OVER (PARTITION BY repo ORDER BY created, key) AS rn FROM tracker) e
        JOIN repos r ON r.repo = e.repo WHERE e.rn <= 500 AND e.rn = r.born_skip + 1),
dit AS (SELECT repo, count(DISTINCT name) AS dit FROM cat_types GROUP BY repo),
dlt AS (SELECT repo, count(DISTINCT name) AS dlt FROM cat_links GROUP BY repo),
prof AS (
  SELECT r.repo, bn.born,
         coalesce(iss.issues, 0) AS issues, coalesce(dit.dit, 0) AS dit, coalesce(uit.uit, 0) AS uit,
         CAST(coalesce(dl.distinct_links, 0) + coalesce(st.subtasks, 0) + coalesce(ep.epics, 0) AS BIGINT) AS links,
         coalesce(dlt.dlt, 0) AS dlt, coalesce(dl.ult, 0) AS ult, coalesce(ch.changes, 0) AS changes,
         CAST(round_even(coalesce(ch.changes, 0) / coalesce(iss.issues, 0), 0) AS BIGINT) AS changes_per_issue,
         coalesce(up.up, 0) AS up, coalesce(cm.comments, 0) AS comments,
         CAST(round_even(coalesce(cm.comments, 0) / coalesce(iss.issues, 0), 0) AS BIGINT) AS comments_per_issue,
         coalesce(dl.distinct_links, 0) AS distinct_links, coalesce(st.subtasks, 0) AS subtasks,
         coalesce(ep.epics, 0) AS epics, bn.born_created
  FROM repos r LEFT JOIN iss USING (repo) LEFT JOIN uit USING (repo) LEFT JOIN up USING (repo)
       LEFT JOIN dl USING (repo) LEFT JOIN st USING (repo) LEFT JOIN ep USING (repo)
       LEFT JOIN ch USING (repo) LEFT JOIN cm USING (repo) LEFT JOIN bn USING (repo)
       LEFT JOIN dit USING (repo) LEFT JOIN dlt USING (repo))"""

PROFILE_BASE = W(ov.TRACKER, ov.CHANGES_ONLY, ov.LINKS_ONLY, ov.COMMENTS_ONLY, ov.REPOS, CAT_SQL,
                 METRICS_SQL)


def _t(spark, sf, parts=fx.ALL_PARTS):
    return fx.tracker(spark, sf, parts)


def _repos(spark, sf):
    return fx.repos(spark, sf)


def _full_profile(spark, sf, catalogs=True):
    """Profile from the tracker's child tables (normalized path: explodes, joins on
    the issue key and per-source partial aggregates; no per-issue collect)."""
    tc = cg.catalog(spark, sf, "issuetype") if catalogs else None
    lc = cg.catalog(spark, sf, "linktype") if catalogs else None
    return pf.profile_tables(fx.tracker_tables(spark, sf), _repos(spark, sf), tc, lc)


_PROFILE_COLS = ", ".join(pf.PROFILE_COLUMNS)


@register("job_05", PROFILE_BASE + f"\nSELECT {_PROFILE_COLS} FROM prof")
def job_05(spark, sf):
    return _full_profile(spark, sf)


@register("agg_16", PROFILE_BASE + f"\nSELECT {_PROFILE_COLS} FROM prof")
def agg_16(spark, sf):
    return _full_profile(spark, sf)


@register("agg_16_landed", PROFILE_BASE + f"\nSELECT {_PROFILE_COLS} FROM prof")
def agg_16_landed(spark, sf):
    """The profile kept up to date over three landings; the last replaces issues that landed before without their links."""
    root, r, t = scratch_path(spark, "profile"), _repos(spark, sf), _t(spark, sf)
    third = F.pmod(F.col("_id").cast("long"), F.lit(3))
    bare = t.withColumn("fields", F.col("fields").dropFields("issuelinks", "comments"))
    bare = bare.withColumn("fields", F.col("fields").withField("issuelinks", F.lit(None).cast(S.FIELDS["issuelinks"].dataType))
                           .withField("comments", F.lit(None).cast(S.FIELDS["comments"].dataType)))
    ps.land(spark, root, t.where(third == 0), r, batch="first")
    ps.land(spark, root, bare.where(third == 1), r, batch="second")
    ps.land(spark, root, t.where(third != 0), r, replaced=bare.where(third == 1), batch="third")
    return ps.stored_profile(spark, root, r, cg.catalog(spark, sf, "issuetype"), cg.catalog(spark, sf, "linktype"))


_SUM_SQL = PROFILE_BASE + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{label}' AS stat, " + ", ".join(
        f"round(CAST({fn}(CAST({c} AS DOUBLE)) AS DOUBLE), 4) AS {c}" for c in pf.SUMMARY_COLUMNS)
    + " FROM prof"
    for label, fn in (("Sum", "sum"), ("Median", "median"), ("Std Dev", "stddev_pop")))


@register("agg_17", _SUM_SQL)
def agg_17(spark, sf):
    return pf.profile_summary(_full_profile(spark, sf))


@register("join_09", PROFILE_BASE + """
SELECT repo, issues, links, changes, comments, CAST(0 AS BIGINT) AS dit, CAST(0 AS BIGINT) AS dlt FROM prof""")
def join_09(spark, sf):
    """Assembly with no catalogs: documented counts default to 0 for every source."""
    p = _full_profile(spark, sf, catalogs=False)
    return p.select("repo", "issues", "links", "changes", "comments", "dit", "dlt")


def _metric(name, cols, parts, fn):
    sql = PROFILE_BASE + f"\nSELECT repo, {', '.join(cols)} FROM prof"

    @register(name, sql)
    def q(spark, sf):
        return fn(spark, sf, _t(spark, sf, parts)).select("repo", *cols)
    return q


def _tables(spark, sf):
    return fx.tracker_tables(spark, sf)


def _members(name, kind, members):
    """A metric of one kind of member, from the child tables that have it."""
    sql = PROFILE_BASE + f"\nSELECT repo, {kind} FROM prof"

    @register(name, sql)
    def q(spark, sf):
        rows = members(_tables(spark, sf), _repos(spark, sf)).where(F.col("kind") == kind)
        return pf.metrics(pf.member_counts(rows), [kind])
    return q


def _issues(t, r):
    return pf.issue_members(pf.flat_issues(t, r))


def _changes(t, r):
    return pf.change_members(t["changes"])


def _used(t, r):
    """Current and previous values: the issues and their changes."""
    return _issues(t, r).unionByName(_changes(t, r))


_members("agg_01", "issues", _issues)
_members("agg_06", "epics", _issues)
_members("agg_11", "changes", _changes)
_members("agg_14", "comments", lambda t, r: pf.comment_members(t["comments"]))
_members("agg_03", "uit", _used)
_members("agg_13", "up", _used)
_members("agg_09", "ult", lambda t, r: pf.link_members(t["links"]))
# nested-document forms of the same metrics (links and sub-task arrays per issue)
_metric("agg_05", ["subtasks"], ("links",), lambda s, sf, t: pf.size_metrics(t, _repos(s, sf)))
_metric("agg_04", ["distinct_links"], ("links",), lambda s, sf, t: pf.distinct_links(t))
_metric("agg_10", ["born", "born_created"], (), lambda s, sf, t: pf.born(t, _repos(s, sf)))


@register("agg_07", PROFILE_BASE + "\nSELECT repo, links FROM prof")
def agg_07(spark, sf):
    t, r = _tables(spark, sf), _repos(spark, sf)
    m = pf.metrics(pf.member_counts(_issues(t, r).unionByName(pf.link_members(t["links"]))), ["distinct_links", "subtasks", "epics"])
    return m.select("repo", (F.col("distinct_links") + F.col("subtasks") + F.col("epics")).alias("links"))


@register("agg_12", PROFILE_BASE + "\nSELECT repo, changes_per_issue FROM prof")
def agg_12(spark, sf):
    t, r = _tables(spark, sf), _repos(spark, sf)
    m = pf.metrics(pf.member_counts(_used(t, r)), ["issues", "changes"])
    return m.select("repo", pf.ratio("changes", "issues").alias("changes_per_issue"))


@register("agg_15", PROFILE_BASE + "\nSELECT repo, comments_per_issue FROM prof")
def agg_15(spark, sf):
    t = _t(spark, sf, ("comments",))
    m = pf.size_metrics(t, _repos(spark, sf))
    return m.select("repo", pf.ratio("comments", "issues").alias("comments_per_issue"))


@register("agg_02", W(CAT_SQL) + "\nSELECT repo, count(DISTINCT name) AS dit FROM cat_types GROUP BY repo")
def agg_02(spark, sf):
    return pf.documented_counts(cg.catalog(spark, sf, "issuetype"), "dit")


@register("agg_08", W(CAT_SQL) + """
SELECT r.r_name AS repo, coalesce(d.dlt, 0) AS dlt FROM region r
LEFT JOIN (SELECT repo, count(DISTINCT name) AS dlt FROM cat_links GROUP BY repo) d ON d.repo = r.r_name""")
def agg_08(spark, sf):
    return pf.documented_counts(cg.catalog(spark, sf, "linktype"), "dlt")


@register("set_01", W(ov.CHANGES) + """
SELECT DISTINCT repo, name FROM (
  SELECT repo, issuetype AS name FROM tracker
  UNION ALL SELECT repo, fromString FROM changes WHERE field = 'issuetype') WHERE name IS NOT NULL""")
def set_01(spark, sf):
    t, r = _tables(spark, sf), _repos(spark, sf)
    m = _used(t, r)
    return m.where((F.col("kind") == "uit") & F.col("name").isNotNull()).select("repo", "name").distinct()


@register("set_02", W(ov.CHANGES) + """
SELECT DISTINCT repo, name FROM (
  SELECT repo, project AS name FROM tracker
  UNION ALL SELECT repo, fromString FROM changes WHERE field = 'project') WHERE name IS NOT NULL""")
def set_02(spark, sf):
    t, r = _tables(spark, sf), _repos(spark, sf)
    m = _used(t, r)
    return m.where((F.col("kind") == "up") & F.col("name").isNotNull()).select("repo", "name").distinct()


@register("join_04", W(ov.TRACKER, ov.REPOS) + """
SELECT t.repo, t.key, r.epic_field,
       CASE WHEN t.o_orderstatus = 'P' THEN 'EPIC-' || CAST(t.o_custkey AS VARCHAR) END AS epic
FROM tracker t JOIN repos r ON r.repo = t.repo""")
def join_04(spark, sf):
    e = pf.with_epic(_t(spark, sf, ()), _repos(spark, sf))
    return e.select("repo", "key", "epic_field", "epic")


@register("prj_08", W(ov.TRACKER) + """
SELECT key, 'EPIC-' || CAST(o_custkey AS VARCHAR) AS epic FROM tracker WHERE o_orderstatus = 'P'""")
def prj_08(spark, sf):
    e = pf.with_epic(_t(spark, sf, ()), _repos(spark, sf))
    return e.where(F.col("epic").isNotNull()).select("key", "epic")


@register("prj_09", W(ov.TRACKER) + """
SELECT repo, key, issuetype, project, created FROM tracker""")
def prj_09(spark, sf):
    t = _t(spark, sf, ())
    return t.select("repo", "key", F.col("fields.issuetype.name").alias("issuetype"),
                    F.col("fields.project.name").alias("project"),
                    F.col("fields.created").alias("created"))


@register("prj_10", W(ov.LINKS) + "\nSELECT repo, key, link_id, link_type FROM links")
def prj_10(spark, sf):
    t = _t(spark, sf, ("links",))
    return t.select("repo", "key", F.explode("fields.issuelinks").alias("l")).select(
        "repo", "key", F.col("l.id").alias("link_id"), F.col("l.type.name").alias("link_type"))


@register("prj_11", W(ov.CHANGES) + "\nSELECT repo, key, field, fromString, toString FROM changes")
def prj_11(spark, sf):
    t = _t(spark, sf, ("changelog",))
    return pf.change_items(t, keep=("repo", "key")).select(
        "repo", "key", "field", "fromString", "toString")


@register("flt_04", W(ov.CHANGES) + "\nSELECT repo, key, fromString FROM changes WHERE field = 'issuetype'")
def flt_04(spark, sf):
    t = _t(spark, sf, ("changelog",))
    return pf.change_items(t, "issuetype", keep=("repo", "key")).select("repo", "key", "fromString")


@register("flt_02", W(ov.LINKS) + """
SELECT repo, key, count(*) AS n_links FROM links GROUP BY repo, key""")
def flt_02(spark, sf):
    t = _t(spark, sf, ("links",))
    return t.where(F.size("fields.issuelinks") > 0).select(
        "repo", "key", F.size("fields.issuelinks").cast("long").alias("n_links"))


@register("flt_03", W(ov.COMMENTS) + """
SELECT DISTINCT repo, key FROM comments""")
def flt_03(spark, sf):
    t = _t(spark, sf, ("comments",))
    return t.where(F.col("fields.comments").isNotNull()).select("repo", "key")


FLT10_SOURCES = ["AFRICA", "EUROPE"]


@register("flt_10", PROFILE_BASE + f"""
SELECT repo, issues, uit, links, changes, comments FROM prof
WHERE repo IN ({', '.join(repr(s) for s in FLT10_SOURCES)})""")
def flt_10(spark, sf):
    """Profile of chosen sources only (the reference's ``jiras=[...]`` argument)."""
    chosen = F.col("repo").isin(FLT10_SOURCES)
    t = {k: v.where(chosen) for k, v in _tables(spark, sf).items()}
    r = _repos(spark, sf).where(chosen)
    p = pf.profile_tables(t, r)
    return p.select("repo", "issues", "uit", "links", "changes", "comments")


@register("sort_02", W(ov.TRACKER) + """
SELECT repo, key, created, rn FROM (
  SELECT repo, key, created, CAST(row_number() OVER (PARTITION BY repo ORDER BY created, key) AS INTEGER) AS rn
  FROM tracker) WHERE rn <= 500""")
def sort_02(spark, sf):
    return pf.earliest(_t(spark, sf, ())).select("repo", "key", "created", "rn")


@register("scl_04", W(ov.TRACKER) + "\nSELECT key, substr(created, 1, 4) AS year FROM tracker")
def scl_04(spark, sf):
    t = _t(spark, sf, ())
    return t.select("key", F.substring("fields.created", 1, 4).alias("year"))


@register("scl_05", W(ov.TRACKER) + "\nSELECT key, created >= '1996-07-01' AS after FROM tracker")
def scl_05(spark, sf):
    t = _t(spark, sf, ())
    return t.select("key", (F.col("fields.created") >= F.lit("1996-07-01")).alias("after"))


@register("scl_06", W(ov.TRACKER, ov.LINKS_ONLY, ov.COMMENTS_ONLY) + """
SELECT t.key, CAST(coalesce(l.n, 0) AS INTEGER) AS n_links, CAST(coalesce(l.f, 0) AS INTEGER) AS n_subtasks,
       CAST(coalesce(c.n, 0) AS INTEGER) AS n_comments
FROM tracker t
LEFT JOIN (SELECT key, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM links GROUP BY key) l ON l.key = t.key
LEFT JOIN (SELECT key, count(*) AS n FROM comments GROUP BY key) c ON c.key = t.key""")
def scl_06(spark, sf):
    t = _t(spark, sf, ("links", "comments"))
    return t.select("key", pf.size0("fields.issuelinks").alias("n_links"),
                    pf.size0("fields.subtasks").alias("n_subtasks"),
                    pf.size0("fields.comments").alias("n_comments"))


@register("scl_07", W(ov.LINKS) + """
SELECT key, CAST(round_even(count(*) / 2.0, 0) AS BIGINT) AS half_links FROM links GROUP BY key""")
def scl_07(spark, sf):
    """Half-even rounding of n/2 (0.5 -> 0, 1.5 -> 2, 2.5 -> 2)."""
    t = _t(spark, sf, ("links",)).where(F.size("fields.issuelinks") > 0)
    return t.select("key", F.bround(F.size("fields.issuelinks") / F.lit(2.0), 0).cast("long")
                    .alias("half_links"))


@register("scl_08", W(ov.ISSUES_TEXT) + """
SELECT key, coalesce(description, '') <> '' AS has_description,
       CAST(length(coalesce(description, '')) AS INTEGER) AS description_chars FROM issues_text""")
def scl_08(spark, sf):
    t = fx.issues_text(spark, sf)
    d = F.coalesce(F.col("description"), F.lit(""))
    return t.select("key", (d != "").alias("has_description"), F.length(d).alias("description_chars"))


# ------------------------------------------------------------------ catalogs

@register("src_07", W(CAT_SQL) + """
SELECT r.r_name AS repo, CAST(n.n_nationkey AS VARCHAR) AS id, substr(n.n_name, 1, 1) AS name, n.n_name AS description
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN (SELECT r2.r_name AS repo, substr(n2.n_name, 1, 1) AS name, max(n2.n_nationkey) AS k
      FROM nation n2 JOIN region r2 ON n2.n_regionkey = r2.r_regionkey GROUP BY 1, 2) m
  ON m.repo = r.r_name AND m.k = n.n_nationkey""")
def src_07(spark, sf):
    return cg.catalog(spark, sf, "issuetype").select("repo", "id", "name", "description")


@register("win_02", W(CAT_SQL) + "\nSELECT repo, name FROM cat_types")
def win_02(spark, sf):
    return cg.catalog(spark, sf, "issuetype").select("repo", "name")


@register("src_08", """
SELECT r.r_name AS repo, CASE WHEN strpos(r.r_name, 'A') > 0 THEN CAST(n.n_nationkey AS VARCHAR) END AS id,
       CASE WHEN strpos(r.r_name, 'A') > 0 THEN n.n_name END AS name
FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey AND strpos(r.r_name, 'A') > 0
""")
def src_08(spark, sf):
    return cg.catalog(spark, sf, "linktype").select("repo", "id", "name")


@register("src_09", """
SELECT r.r_name AS repo, 'customfield_' || CAST(n.n_nationkey + 10000 AS VARCHAR) AS id, n.n_name AS name, TRUE AS custom
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def src_09(spark, sf):
    return cg.catalog(spark, sf, "field").select("repo", "id", "name", "custom")


def _classes_sql() -> str:
    from ..constants import ISSUE_TYPES
    vals = ", ".join("({}, '{}')".format(i + 1, n.replace("'", "''")) for i, (n, _) in enumerate(ISSUE_TYPES))
    return f"classes AS (SELECT * FROM (VALUES {vals}) AS c(position, name))"


@register("src_13", W(ov.TRACKER, ov.CHANGES_ONLY, _classes_sql()) + """
SELECT u.name AS issuetype, c.position IS NOT NULL AS allowed, c.position FROM (
  SELECT DISTINCT issuetype AS name FROM tracker
  UNION SELECT fromString FROM changes WHERE field = 'issuetype' AND fromString IS NOT NULL) u
LEFT JOIN classes c ON c.name = u.name""")
def src_13(spark, sf):
    """Used issue types checked against the allowed class list (and its order)."""
    t, r = _tables(spark, sf), _repos(spark, sf)
    m = _used(t, r)
    used = m.where((F.col("kind") == "uit") & F.col("name").isNotNull()).select("name").distinct()
    cls = cg.allowed_classes(spark).select("name", "position")
    j = used.join(cls, "name", "left")
    return j.select(F.col("name").alias("issuetype"), F.col("position").isNotNull().alias("allowed"),
                    "position")
