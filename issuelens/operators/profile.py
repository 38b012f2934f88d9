"""Per-tracker profile (AGG-01..17, SET-01/02, JOIN-04, JOIN-09, PRJ-08..11, FLT-02..04).

Input is the nested issue table (``schemas.ISSUE``) or flat child tables, with ``repo`` as
the source column. The whole profile is one table of members (below) and one top-N
window for the birth year, which Spark runs as ``WindowGroupLimit`` before the
shuffle, so at most N rows per source and map task move. The functions of single
metrics read only what their metric needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BORN_SKIP, BORN_WINDOW, EPIC_FIELDS, INVALID_SOURCES

PROFILE_COLUMNS = ["repo", "born", "issues", "dit", "uit", "links", "dlt", "ult", "changes",
                   "changes_per_issue", "up", "comments", "comments_per_issue"]
SUMMARY_COLUMNS = ["issues", "dit", "uit", "links", "dlt", "ult", "changes",
                   "changes_per_issue", "up", "comments", "comments_per_issue"]


def known_repos(spark) -> DataFrame:
    """(repo, epic_field, born_skip) of the trackers that have fixed rules: the rows of a profile of real data."""
    return spark.createDataFrame([(r, field, BORN_SKIP.get(r, 0)) for r, field in EPIC_FIELDS.items() if r not in INVALID_SOURCES],
                                 "repo string, epic_field string, born_skip int")


def size0(arr) -> Column:
    """Array size with 0 for a missing or null array (independent of sizeOfNull)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.when(arr.isNull(), F.lit(0)).otherwise(F.size(arr))


def change_items(issues: DataFrame, field: str | None = None, keep=("repo",)) -> DataFrame:
    """PRJ-11 + FLT-04: unnest histories -> items (two levels), optionally only
    the items of one field. The filter runs on the array before the explode, so
    unrelated items are never turned into rows."""
    hs = F.filter(F.col("changelog.histories"), lambda h: h["items"].isNotNull())
    items = F.flatten(F.transform(hs, lambda h: h["items"]))
    if field is not None:
        items = F.filter(items, lambda i: i["field"] == F.lit(field))
    return issues.select(*keep, F.explode(items).alias("item")).select(*keep, "item.*")


def history_values(issues: DataFrame, field: str) -> DataFrame:
    """Previous values (``fromString``) of one field over the change log."""
    return change_items(issues, field).select("repo", F.col("fromString").alias("name"))


def current_and_past(issues: DataFrame, path: str, field: str) -> DataFrame:
    """SET-01 / SET-02: final value union previous values, distinct, nulls dropped (Q1)."""
    cur = issues.select("repo", F.col(path).alias("name"))
    return (cur.unionByName(history_values(issues, field))
               .where(F.col("name").isNotNull()).distinct())


def count_distinct_by_repo(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.groupBy("repo").agg(F.count_distinct(col).alias(out))


def used_types(issues: DataFrame) -> DataFrame:
    """AGG-03 (UIT)."""
    cur = issues.select("repo", F.col("fields.issuetype.name").alias("name"))
    s = cur.unionByName(history_values(issues, "issuetype"))
    return count_distinct_by_repo(s, "name", "uit")


def unique_projects(issues: DataFrame) -> DataFrame:
    """AGG-13 (UP)."""
    cur = issues.select("repo", F.col("fields.project.name").alias("name"))
    s = cur.unionByName(history_values(issues, "project"))
    return count_distinct_by_repo(s, "name", "up")


def link_ids(issues: DataFrame) -> DataFrame:
    """PRJ-10: one row per link id; missing, null and empty arrays give none."""
    return issues.select("repo", F.explode("fields.issuelinks").alias("l")).select(
        "repo", F.col("l.id").alias("link_id"), F.col("l.type.name").alias("link_type"))


def distinct_links(issues: DataFrame) -> DataFrame:
    """AGG-04: each link id once per source (FLT-02 is implied by explode)."""
    return count_distinct_by_repo(link_ids(issues), "link_id", "distinct_links")


def used_link_types(issues: DataFrame) -> DataFrame:
    """AGG-09 (ULT)."""
    return count_distinct_by_repo(link_ids(issues), "link_type", "ult")


SET_KINDS = ["uit", "up", "distinct_links", "ult"]


def _arr(c):
    """An array column with [] for null (so ``concat`` keeps the other parts)."""
    return F.coalesce(c, F.array().cast("array<struct<kind:string,name:string>>"))


def distinct_sets(issues: DataFrame) -> DataFrame:
    """AGG-03, -04, -09, -13 (and SET-01/02) in one scan and one distinct aggregate.

    Every issue yields (kind, name) members: its current type and project, the
    previous types and projects of its change log, its link ids and link types.
    One explode, one two-phase ``count(distinct)`` keyed by (repo, kind, name),
    then a pivot of the four counts (one row per source)."""
    def m(kind, col):
        return F.struct(F.lit(kind).alias("kind"), col.cast("string").alias("name"))

    cur = F.array(m("uit", F.col("fields.issuetype.name")), m("up", F.col("fields.project.name")))
    hs = F.filter(F.col("changelog.histories"), lambda h: h["items"].isNotNull())
    items = F.filter(F.flatten(F.transform(hs, lambda h: h["items"])),
                     lambda i: i["field"].isin("issuetype", "project"))
    hist = F.transform(items, lambda i: m("", i["fromString"]).withField(
        "kind", F.when(i["field"] == "issuetype", F.lit("uit")).otherwise(F.lit("up"))))
    links = F.flatten(F.transform(F.col("fields.issuelinks"), lambda l: F.array(
        m("distinct_links", l["id"]), m("ult", l["type"]["name"]))))
    members = F.concat(_arr(cur), _arr(hist), _arr(links))
    x = issues.select("repo", F.explode(members).alias("x")).select("repo", "x.kind", "x.name")
    per = x.groupBy("repo", "kind").agg(F.count_distinct("name").alias("n"))
    return per.groupBy("repo").pivot("kind", SET_KINDS).agg(F.first("n"))


def with_epic(issues: DataFrame, repos: DataFrame) -> DataFrame:
    """JOIN-04 + PRJ-08: the epic link value read through the source's own field name."""
    ef = repos.select("repo", "epic_field")
    return issues.join(ef, "repo", "left").withColumn(
        "epic", F.try_element_at(F.col("fields.custom_fields"), F.col("epic_field")))


def size_metrics(issues: DataFrame, repos: DataFrame) -> DataFrame:
    """AGG-01, -05, -06, -11, -14 in one scan with map-side partial aggregation."""
    e = with_epic(issues, repos)
    n_items = F.aggregate(F.col("changelog.histories"), F.lit(0).cast("long"),
                          lambda acc, h: acc + size0(h["items"]))
    return e.groupBy("repo").agg(
        F.count("*").alias("issues"),
        F.sum(size0("fields.subtasks")).cast("long").alias("subtasks"),
        F.count_if(F.col("epic").isNotNull()).alias("epics"),
        F.sum(F.coalesce(n_items, F.lit(0).cast("long"))).cast("long").alias("changes"),
        F.sum(size0("fields.comments")).cast("long").alias("comments"),
    )


# First-level buckets of the two-level top-n (see ``first_n``).
TOP_N_BUCKETS = 512


def first_n(rows: DataFrame, n: int, buckets: int = TOP_N_BUCKETS) -> DataFrame:
    """The first ``n`` rows of every source by (created, key), with ``rn``.

    Two levels, so no task sorts more than a bounded number of rows however large
    a source is: each map task keeps n rows per (source, bucket) where the bucket
    is its partition id modulo ``buckets`` (``WindowGroupLimit`` before the
    shuffle), each (source, bucket) group keeps n, and the final per-source window
    sees at most ``buckets * n`` rows.
    """
    order = [F.col("created").asc(), F.col("key").asc()]
    b = rows.withColumn("_b", F.pmod(F.spark_partition_id(), F.lit(buckets)))
    lvl1 = (b.withColumn("_r", F.row_number().over(Window.partitionBy("repo", "_b").orderBy(*order)))
            .where(F.col("_r") <= n).drop("_r", "_b"))
    return (lvl1.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
            .where(F.col("rn") <= n))


def earliest(issues: DataFrame, n: int = BORN_WINDOW) -> DataFrame:
    """SORT-02: the first ``n`` issues of every source by (created, key)."""
    return first_n(issues.select("repo", "key", F.col("fields.created").alias("created")), n)


def born(issues: DataFrame, repos: DataFrame, n: int = BORN_WINDOW) -> DataFrame:
    """AGG-10: created of the first issue after skipping the source's junk rows."""
    first = earliest(issues, n)
    skip = repos.select("repo", "born_skip")
    j = first.join(skip, "repo", "left").where(
        F.col("rn") == F.coalesce(F.col("born_skip"), F.lit(0)) + 1)
    return j.select("repo", F.substring("created", 1, 4).alias("born"),
                    F.col("created").alias("born_created"))


def ratio(num: str, den: str) -> Column:
    """AGG-12 / AGG-15: half-even rounded ratio; null when there are no issues."""
    return F.bround(F.try_divide(F.col(num), F.col(den)), 0).cast("long")


def documented_counts(catalog: DataFrame | None, out: str) -> DataFrame | None:
    """AGG-02 / AGG-08: names per source in a catalog (after last-wins)."""
    if catalog is None:
        return None
    return catalog.groupBy("repo").agg(F.count_distinct("name").alias(out))


def profile(issues: DataFrame, repos: DataFrame, type_catalog: DataFrame | None = None,
            link_catalog: DataFrame | None = None) -> DataFrame:
    """AGG-16 / JOB-05 on nested issue documents: one row per source in ``repos``
    (JOIN-09); a source with no rows gets 0 in every count."""
    return profile_of(member_counts(document_members(issues, repos)), issues.select("repo", "key", F.col("fields.created").alias("created")),
                      repos, type_catalog, link_catalog)


def profile_summary(prof: DataFrame, columns=SUMMARY_COLUMNS, digits: int = 4) -> DataFrame:
    """AGG-17: Sum, Median and population Std Dev over sources, as three rows."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.sum(x).alias(f"sum__{c}"), F.median(x).alias(f"median__{c}"),
                 F.stddev_pop(x).alias(f"std__{c}")]
    one = prof.agg(*aggs)
    rows = []
    for label, prefix in (("Sum", "sum"), ("Median", "median"), ("Std Dev", "std")):
        rows.append(F.struct(F.lit(label).alias("stat"),
                             *[F.round(F.col(f"{prefix}__{c}"), digits).alias(c) for c in columns]))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ----------------------------------------------------------------------------
# Members: every metric but the birth year comes from one table (repo, kind, name, n), n
# saying how often a member occurs. Counts are the sum of n of their kind, distinct sets the
# number of names of theirs. Each child table is read once and gives all its members by
# one explode; one aggregate keyed by (repo, kind, name) follows, partial before its
# shuffle, so no per-issue or per-source collect exists and a large source is spread by its names.

COUNT_KINDS = ["issues", "epics", "subtasks", "changes", "comments"]
_MEMBER = "struct<kind:string,name:string>"


def _member(kind, name=None):
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), (F.lit(None) if name is None else name).cast("string").alias("name"))


def _members(rows: DataFrame, *members: Column) -> DataFrame:
    """(repo, kind, name) of each row's members; a null member is none."""
    return rows.select("repo", F.explode(F.array_compact(F.array(*members))).alias("x")).select("repo", "x.kind", "x.name")


def issue_members(issues: DataFrame) -> DataFrame:
    """``issues``: (repo, issuetype, project, epic)."""
    return _members(issues, _member("issues"), _member("uit", F.col("issuetype")), _member("up", F.col("project")),
                    F.when(F.col("epic").isNotNull(), _member("epics")))


def link_members(links: DataFrame) -> DataFrame:
    """``links``: (repo, link_id, link_type, subtask), a row for each link; ``subtask`` tells the links that also are one."""
    return _members(links, _member("distinct_links", F.col("link_id")), _member("ult", F.col("link_type")),
                    F.when(F.col("subtask"), _member("subtasks")))


def change_members(changes: DataFrame) -> DataFrame:
    """``changes``: (repo, field, fromString), a row for each change item."""
    kind = F.when(F.col("field") == "issuetype", "uit").when(F.col("field") == "project", "up")
    return _members(changes, _member("changes"), F.when(kind.isNotNull(), _member(kind, F.col("fromString"))))


def comment_members(comments: DataFrame) -> DataFrame:
    """``comments``: (repo), a row for each comment."""
    return _members(comments, _member("comments"))


def document_members(issues: DataFrame, repos: DataFrame) -> DataFrame:
    """The members of nested issue documents, all from one explode."""
    none = F.array().cast(f"array<{_MEMBER}>")
    array = lambda c: F.coalesce(c, none)
    items = F.flatten(F.transform(F.filter("changelog.histories", lambda h: h["items"].isNotNull()), lambda h: h["items"]))
    kind = lambda i: F.when(i["field"] == "issuetype", "uit").when(i["field"] == "project", "up")
    own = F.array(_member("issues"), _member("uit", F.col("fields.issuetype.name")), _member("up", F.col("fields.project.name")))
    epic = F.when(F.col("epic").isNotNull(), F.array(_member("epics")))
    links = F.flatten(F.transform("fields.issuelinks", lambda l: F.array(
        _member("distinct_links", l["id"]), _member("ult", l["type"]["name"]))))
    subtasks = F.transform("fields.subtasks", lambda s: _member("subtasks"))
    changes = F.flatten(F.transform(items, lambda i: F.array(_member("changes"), _member(kind(i), i["fromString"]))))
    comments = F.transform("fields.comments", lambda c: _member("comments"))
    every = F.concat(own, *[array(c) for c in (epic, links, subtasks, changes, comments)])
    rows = with_epic(issues, repos).select("repo", F.explode(every).alias("x")).select("repo", "x.kind", "x.name")
    return rows.where(F.col("kind").isNotNull())


def member_counts(members: DataFrame) -> DataFrame:
    """(repo, kind, name, n); ``members`` may carry an ``n`` of their own (also a negative one)."""
    n = F.sum("n") if "n" in members.columns else F.count("*")
    return members.groupBy("repo", "kind", "name").agg(n.cast("long").alias("n"))


def metrics(counts: DataFrame, kinds=(*COUNT_KINDS, *SET_KINDS)) -> DataFrame:
    """(repo, a column for each kind) of ``member_counts``: AGG-01, -03..06, -09, -11, -13, -14."""
    here = lambda k: (F.col("kind") == k) & (F.col("n") > 0)
    size = lambda k: F.sum(F.when(here(k), F.col("n"))) if k in COUNT_KINDS else F.count_if(here(k) & F.col("name").isNotNull())
    return counts.groupBy("repo").agg(*[F.coalesce(size(k), F.lit(0)).cast("long").alias(k) for k in kinds])


def flat_born(issues: DataFrame, repos: DataFrame, n: int = BORN_WINDOW) -> DataFrame:
    """AGG-10 over flat issues (created, key): top-n window, then the skip."""
    first = first_n(issues.select("repo", "key", "created"), n)
    skip = repos.select("repo", "born_skip")
    return first.join(skip, "repo", "left").where(
        F.col("rn") == F.coalesce(F.col("born_skip"), F.lit(0)) + 1).select(
        "repo", F.substring("created", 1, 4).alias("born"), F.col("created").alias("born_created"))


def profile_of(counts: DataFrame, created: DataFrame, repos: DataFrame, type_catalog: DataFrame | None = None,
               link_catalog: DataFrame | None = None) -> DataFrame:
    """AGG-16 from ``member_counts`` and (repo, key, created) of the issues."""
    return _assemble(repos, [metrics(counts), flat_born(created, repos).drop("born_created")], type_catalog, link_catalog)


def _assemble(repos, parts, type_catalog, link_catalog):
    for cat, name in ((type_catalog, "dit"), (link_catalog, "dlt")):
        c = documented_counts(cat, name)
        parts.append(c if c is not None else repos.select("repo", F.lit(0).cast("long").alias(name)))
    out = repos.select("repo")
    for p in parts:
        out = out.join(p, "repo", "left")
    zero = ["issues", "subtasks", "epics", "changes", "comments", "distinct_links", "uit",
            "ult", "up", "dit", "dlt"]
    out = out.fillna(0, subset=zero)
    out = out.withColumn("links", F.col("distinct_links") + F.col("subtasks") + F.col("epics"))
    out = out.withColumn("changes_per_issue", ratio("changes", "issues"))
    out = out.withColumn("comments_per_issue", ratio("comments", "issues"))
    return out.select(*PROFILE_COLUMNS)


def flat_issues(tables: dict, repos: DataFrame) -> DataFrame:
    """Issue rows of the child tables with the epic value resolved (JOIN-04, PRJ-08)."""
    e = with_epic(tables["issues"], repos)
    return e.select("repo", "key", F.col("fields.created").alias("created"),
                    F.col("fields.issuetype.name").alias("issuetype"),
                    F.col("fields.project.name").alias("project"), "epic")


def table_members(tables: dict, repos: DataFrame) -> DataFrame:
    """The members of child tables (issues, links, changes, comments), each read once."""
    out = issue_members(flat_issues(tables, repos))
    for members in (link_members(tables["links"]), change_members(tables["changes"]), comment_members(tables["comments"])):
        out = out.unionByName(members)
    return out


def profile_tables(tables: dict, repos: DataFrame, type_catalog: DataFrame | None = None,
                   link_catalog: DataFrame | None = None) -> DataFrame:
    """AGG-16 from child tables whose ``issues`` still carry the nested ``fields``
    (for the epic lookup through the source's own custom field)."""
    created = tables["issues"].select("repo", "key", F.col("fields.created").alias("created"))
    return profile_of(member_counts(table_members(tables, repos)), created, repos, type_catalog, link_catalog)
