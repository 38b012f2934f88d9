"""Catalogs and definition files (SRC-07..13, WIN-02, JOIN-05, JOIN-06).

Raw catalogs arrive as one JSON text per source: ``(repo, payload)``.

* issue types: a JSON array of objects; keyed by ``name``, the last one wins;
* link types: an object whose ``issueLinkTypes`` array may be missing, in which
  case the source is kept with an empty catalog;
* fields: a JSON array stored as is.

Definition files are JSON maps read with ``from_json`` and exploded into small
dimension tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

TYPE_ITEM = "struct<id:string,name:string,description:string>"
LINK_ITEM = "struct<id:string,name:string,inward:string,outward:string>"
FIELD_ITEM = "struct<id:string,name:string,custom:boolean>"

SOURCE_DEF = "struct<company_url:string,jira_url:string,name:string,rough_issue_count:string>"


def last_wins(df: DataFrame, keys=("repo", "name"), order="pos") -> DataFrame:
    """WIN-02: keep the last object per (source, name)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_catalog(raw: DataFrame, kind: str) -> DataFrame:
    """(repo, payload) -> one row per catalog entry.

    issuetype -> repo, pos, id, name, description (last wins per name)
    linktype  -> repo, pos, id, name, inward, outward (last wins; null name row
                 for a source whose payload has no ``issueLinkTypes``)
    field     -> repo, pos, id, name, custom (as is)
    """
    if kind == "issuetype":
        arr = F.from_json("payload", f"array<{TYPE_ITEM}>")
        e = raw.select("repo", F.posexplode(arr).alias("pos", "o")).select("repo", "pos", "o.*")
        return last_wins(e)
    if kind == "linktype":
        obj = F.from_json("payload", f"struct<issueLinkTypes:array<{LINK_ITEM}>>")
        e = raw.select("repo", F.posexplode_outer(obj["issueLinkTypes"]).alias("pos", "o"))
        e = e.select("repo", "pos", "o.*")
        named = last_wins(e.where(F.col("name").isNotNull()))
        empty = e.where(F.col("name").isNull())
        return named.unionByName(empty)
    if kind == "field":
        arr = F.from_json("payload", f"array<{FIELD_ITEM}>")
        return raw.select("repo", F.posexplode(arr).alias("pos", "o")).select("repo", "pos", "o.*")
    raise ValueError(f"unknown catalog kind {kind!r}")


def read_sources(raw: DataFrame) -> DataFrame:
    """SRC-10: a JSON map name -> source object, one text per row."""
    m = F.from_json("payload", f"map<string,{SOURCE_DEF}>")
    return raw.select(F.explode(m).alias("source", "d")).select("source", "d.*")


def read_themes(raw: DataFrame) -> DataFrame:
    """SRC-11: repo -> issuetype -> {theme, code}."""
    m = F.from_json("payload", "map<string,map<string,struct<theme:string,code:string>>>")
    a = raw.select(F.explode(m).alias("repo", "types"))
    return a.select("repo", F.explode("types").alias("issuetype", "t")).select(
        "repo", "issuetype", "t.theme", "t.code")


def read_linktype_map(raw: DataFrame) -> DataFrame:
    """SRC-12: ``{"link types": {raw: canonical}}``."""
    m = F.from_json("payload", "struct<`link types`:map<string,string>>")
    return raw.select(F.explode(m["link types"]).alias("raw", "canonical"))


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """A whole JSON file as one ``payload`` row (definition files are small, fixed maps)."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def with_theme(issues: DataFrame, themes: DataFrame) -> DataFrame:
    """JOIN-05: (repo, issuetype) -> theme, code; unmatched -> null."""
    return issues.join(themes, ["repo", "issuetype"], "left")


def with_link_type(links: DataFrame, mapping: DataFrame, col: str = "link_type") -> DataFrame:
    """JOIN-06: canonical link type, case-sensitive, raw name when unmapped."""
    m = mapping.withColumnRenamed("raw", col)
    return links.join(m, col, "left").withColumn(
        "canonical", F.coalesce(F.col("canonical"), F.col(col)))


# --------------------------------------------------------------------------
# Catalog payloads derived from the driver's tables (a source = a region; its
# catalog entries = its nations). Mirrored by the oracle SQL.

def catalog_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, kind, payload) for kinds issuetype, linktype, field."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    g = j.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct(
        "n_nationkey", "n_name"))).alias("ns"))
    types = F.transform("ns", lambda x: F.struct(
        x["n_nationkey"].cast("string").alias("id"),
        F.substring(x["n_name"], 1, 1).alias("name"),
        x["n_name"].alias("description")))
    links = F.transform("ns", lambda x: F.struct(
        x["n_nationkey"].cast("string").alias("id"),
        x["n_name"].alias("name"),
        F.concat(F.lit("is "), F.lower(x["n_name"])).alias("inward"),
        F.lower(x["n_name"]).alias("outward")))
    fields = F.transform("ns", lambda x: F.struct(
        F.concat(F.lit("customfield_"), (x["n_nationkey"] + 10000).cast("string")).alias("id"),
        x["n_name"].alias("name"),
        F.lit(True).alias("custom")))
    link_payload = F.when(F.col("r_name").contains("A"),
                          F.to_json(F.struct(links.alias("issueLinkTypes")))).otherwise(F.lit("{}"))
    out = g.select(F.col("r_name").alias("repo"), F.array(
        F.struct(F.lit("issuetype").alias("kind"), F.to_json(types).alias("payload")),
        F.struct(F.lit("linktype").alias("kind"), link_payload.alias("payload")),
        F.struct(F.lit("field").alias("kind"), F.to_json(fields).alias("payload"))).alias("p"))
    return out.select("repo", F.explode("p").alias("p")).select("repo", "p.kind", "p.payload")


def catalog(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    raw = catalog_payloads(spark, sf_dir).where(F.col("kind") == kind).select("repo", "payload")
    return read_catalog(raw, kind)


def allowed_classes(spark: SparkSession, classes=None) -> DataFrame:
    """SRC-13: the fixed list of classes offered to the generator, with its order."""
    from ..constants import ISSUE_TYPES

    rows = [(i + 1, n, d) for i, (n, d) in enumerate(classes or ISSUE_TYPES)]
    return spark.createDataFrame(rows, "position int, name string, description string")
