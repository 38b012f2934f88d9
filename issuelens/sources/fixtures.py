"""Views that map the driver's tables onto the issue-tracker data model.

* ``issues_text``  - documents as flat issues (repo, key, summary, description, issuetype)
* ``issues_doc``   - the same as nested issue documents
* ``labelled``     - documents left-joined to labels
* ``vectors``      - embeddings as index rows (key, embedding, issuetype, text, summary)
* ``tracker``      - orders as nested issue documents with links, sub-tasks, custom
                     fields, a change log and comments

Every mapping rule here is mirrored by the DuckDB oracle SQL of the registered
queries, so both sides derive the same rows independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ISSUE
from .tables import table

# Rules of the tracker fixture (mirrored in oracle SQL).
EPIC_FIELD_BASE = 10000          # epic field of a region: customfield_<base + regionkey>
CHANGE_FIELD_MAP = {"error": "issuetype", "purchase": "project"}  # event_type -> change field


def _first_line(text):
    return F.substring_index(text, "\n", 1)


def _after_first_line(text):
    pos = F.instr(text, "\n")
    return F.when(pos > 0, F.substr(text, pos + F.lit(1)))


def issues_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> flat issues. summary = first line, description = the rest (null if none)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("_id"),
        F.col("source").alias("repo"),
        F.col("doc_id").cast("string").alias("key"),
        _first_line(F.col("text")).alias("summary"),
        _after_first_line(F.col("text")).alias("description"),
        F.col("lang").alias("issuetype"),
    )


def issues_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> nested issue documents (only the text part of ``fields``)."""
    t = issues_text(spark, sf_dir)
    return t.select(
        "repo", "_id", "key",
        F.struct(
            F.col("summary").alias("summary"),
            F.col("description").alias("description"),
            F.struct(F.col("issuetype").alias("name")).alias("issuetype"),
        ).alias("fields"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = issues_text(spark, sf_dir)
    lab = table(spark, sf_dir, "labels")
    return d.join(lab.withColumnRenamed("doc_id", "_id"), "_id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as index rows; text/summary come from the document with the same id."""
    e = table(spark, sf_dir, "embeddings")
    t = issues_text(spark, sf_dir).select(
        F.col("_id").alias("vec_id"), "summary", "description")
    j = e.join(t, "vec_id", "left")
    return j.select(
        F.col("vec_id").cast("string").alias("key"),
        F.col("embedding"),
        F.col("label").cast("string").alias("issuetype"),
        F.concat(F.coalesce("summary", F.lit("")), F.lit(" "),
                 F.coalesce("description", F.lit(""))).alias("text"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )


def epic_field_col(regionkey):
    return F.concat(F.lit("customfield_"), (F.lit(EPIC_FIELD_BASE) + regionkey).cast("string"))


def tracker_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their region (repo) and segment (project); one row per issue."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(r, F.col("n_regionkey") == F.col("r_regionkey")))


def _links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct(
            F.col("l_partkey").cast("string").alias("id"),
            F.struct(F.col("l_returnflag").alias("name")).alias("type"))).alias("issuelinks"),
        F.collect_list(F.when(F.col("l_linestatus") == "F", F.struct(
            F.col("l_linenumber").cast("string").alias("id"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("key")))).alias("subtasks"),
    )


def _changelog(spark, sf_dir):
    """Nested change log per issue (document model: one issue document carries its
    whole change log, as a search page with ``expand=changelog`` returns it).

    Only the queries whose operator is defined on nested documents use it
    (PRJ-11, FLT-04, SRC-04/JOB-07 pages); the profile reads the flat change
    items of ``tracker_tables`` and never assembles this array.
    """
    ev = table(spark, sf_dir, "events")
    field = F.col("event_type")
    for src, dst in CHANGE_FIELD_MAP.items():
        field = F.when(F.col("event_type") == src, F.lit(dst)).otherwise(field)
    items = ev.select(
        F.col("user_id").alias("o_orderkey"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.struct(
            F.col("ts"), F.col("event_id"),
            field.alias("field"),
            F.get_json_object("props", "$.k").alias("fromString"),
            F.col("event_type").alias("toString")).alias("it"))
    # one history per (issue, day); items in time order
    hist = items.groupBy("o_orderkey", "day").agg(
        F.array_sort(F.collect_list("it")).alias("its"))
    hist = hist.select("o_orderkey", F.struct(
        F.col("day").alias("created"),
        F.transform("its", lambda x: F.struct(
            x["field"].alias("field"), x["fromString"].alias("fromString"),
            x["toString"].alias("toString"))).alias("items")).alias("h"))
    return hist.groupBy("o_orderkey").agg(
        F.struct(F.array_sort(F.collect_list("h")).alias("histories")).alias("changelog"))


def _comments(spark, sf_dir):
    cv = table(spark, sf_dir, "conversations")
    return cv.groupBy(F.col("conv_id").alias("o_orderkey")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                    lambda x: F.struct(
                        x["turn"].cast("string").alias("id"),
                        F.lpad(x["turn"].cast("string"), 4, "0").alias("created"),
                        x["text"].alias("body"))).alias("comments"))


ALL_PARTS = ("links", "changelog", "comments")


def tracker(spark: SparkSession, sf_dir: str, parts=ALL_PARTS) -> DataFrame:
    """orders -> nested issue documents (schema ``schemas.ISSUE``).

    ``parts`` selects which nested branches are built, so a query that needs no
    change log does not shuffle ``events``. Absent parts are null columns.
    """
    b = tracker_base(spark, sf_dir)
    if "links" in parts:
        b = b.join(_links(spark, sf_dir), "o_orderkey", "left")
    if "changelog" in parts:
        b = b.join(_changelog(spark, sf_dir), "o_orderkey", "left")
    if "comments" in parts:
        b = b.join(_comments(spark, sf_dir), "o_orderkey", "left")
    f = ISSUE["fields"].dataType

    def part(name, dtype):
        return F.col(name) if name in b.columns else F.lit(None).cast(dtype)

    fields = F.struct(
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
        F.struct(F.col("o_orderpriority").alias("name")).alias("issuetype"),
        F.struct(F.col("c_mktsegment").alias("name")).alias("project"),
        part("issuelinks", f["issuelinks"].dataType).alias("issuelinks"),
        part("subtasks", f["subtasks"].dataType).alias("subtasks"),
        part("comments", f["comments"].dataType).alias("comments"),
        F.when(F.col("o_orderstatus") == "P",
               F.create_map(epic_field_col(F.col("r_regionkey")),
                            F.concat(F.lit("EPIC-"), F.col("o_custkey").cast("string"))))
         .alias("custom_fields"),
    )
    return b.select(
        F.col("r_name").alias("repo"),
        F.col("o_orderkey").cast("string").alias("_id"),
        F.col("o_orderkey").cast("string").alias("key"),
        fields.alias("fields"),
        part("changelog", ISSUE["changelog"].dataType).alias("changelog"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's sources: one row per region, with per-source rule columns."""
    r = table(spark, sf_dir, "region")
    return r.select(
        F.col("r_name").alias("repo"),
        epic_field_col(F.col("r_regionkey")).alias("epic_field"),
        F.col("r_regionkey").cast("int").alias("born_skip"),
    )


def tracker_tables(spark: SparkSession, sf_dir: str) -> dict:
    """The tracker as flat child tables (the normalized profile input), built with
    joins on the issue key only: no per-issue or per-source grouping.

    issues (repo, key, fields), links (repo, link_id, link_type, subtask), changes
    (repo, field, fromString), comments (repo); a row for each child row. A query reads the
    tables that it names: nothing is written or counted ahead, and where several children
    meet the issues in one plan Spark shuffles or broadcasts (issue key, source) once.
    """
    owner = tracker_base(spark, sf_dir).select(F.col("o_orderkey").alias("_k"), F.col("r_name").alias("repo"))
    li = table(spark, sf_dir, "lineitem").join(owner, F.col("l_orderkey") == F.col("_k"))
    links = li.select("repo", F.col("l_partkey").cast("string").alias("link_id"), F.col("l_returnflag").alias("link_type"),
                      (F.col("l_linestatus") == "F").alias("subtask"))
    field = F.col("event_type")
    for src, dst in CHANGE_FIELD_MAP.items():
        field = F.when(F.col("event_type") == src, F.lit(dst)).otherwise(field)
    changes = (table(spark, sf_dir, "events").join(owner, F.col("user_id") == F.col("_k"))
               .select("repo", field.alias("field"), F.get_json_object("props", "$.k").alias("fromString")))
    comments = table(spark, sf_dir, "conversations").join(owner, F.col("conv_id") == F.col("_k")).select("repo")
    return {"issues": tracker(spark, sf_dir, ()).select("repo", "key", "fields"), "links": links, "changes": changes, "comments": comments}
