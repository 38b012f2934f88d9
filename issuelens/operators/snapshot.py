"""Tables that are written in commits and read as snapshots (SNK-05, SNK-06, STR-01).

A store is a folder ``root`` with one main table and any number of side tables beside it.
A commit writes the rows of each table into a new folder (``commit=<id>``), then publishes
one manifest, ``root/_manifests/<version>.json``, by a rename that never overwrites:

* nothing is part of the store until its manifest is there, so all tables of a commit
  appear together or not at all, and a crash leaves folders that no reader looks at;
* a reader pins a version: it reads the folders of that manifest and no others, whatever
  is written meanwhile;
* two writers cannot publish the same version: the second raises ``Conflict``;
* the manifest holds, for every folder, files, bytes and rows, and the name of the batch
  that wrote it with its row counts. ``verify`` compares a store with them (torn and short
  tables raise), ``done`` tells whether a batch is in without reading any row.

The manifest has one entry for each commit; ``compact`` puts the rows of many commits
into one folder and keeps the ledger of batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settings
from ..sources import files

MAIN = "main"
OPEN_FILES = 4   # that a task writes beside each other; rows of further values are sorted


class Conflict(RuntimeError):
    """Another writer has published this version."""


class Torn(ValueError):
    """The store's files are not those of its manifest."""


class Part(NamedTuple):
    folder: str
    files: int
    bytes: int
    rows: int


class Snapshot(NamedTuple):
    """``parts``: folders of each table; ``batches``: row counts of every batch by name; ``schemas`` as JSON."""

    version: int
    schemas: dict[str, str]
    parts: dict[str, list[Part]]
    batches: dict[str, dict[str, int]]

    def rows(self, table: str = MAIN) -> int:
        return sum(p.rows for p in self.parts.get(table, []))


EMPTY = Snapshot(0, {}, {}, {})


def table_path(root: str, table: str = MAIN) -> str:
    root = root.rstrip("/")
    return root if table == MAIN else f"{root}-{table}"


def part_path(root: str, table: str, part: Part) -> str:
    """A folder that starts with / lies below the root whatever its table (``write_split``)."""
    return root.rstrip("/") + part.folder if part.folder.startswith("/") else f"{table_path(root, table)}/{part.folder}"


def _manifests(root: str) -> str:
    return f"{root.rstrip('/')}/_manifests"


def latest(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or the one of ``version``; ``EMPTY`` if nothing was ever committed."""
    have = [n for n in files.names(spark, _manifests(root)) if n.endswith(".json") and not n.startswith("_")]
    if version is not None:
        have = [n for n in have if n == f"{version:010d}.json"]
        if not have:
            raise ValueError(f"no version {version} of {root}")
    if not have:
        return EMPTY
    held = json.loads(files.read_text(spark, f"{_manifests(root)}/{have[-1]}"))
    parts = {t: [Part(*p) for p in ps] for t, ps in held["parts"].items()}
    return Snapshot(held["version"], held["schemas"], parts, held["batches"])


def done(snapshot: Snapshot, batch: str) -> bool:
    return batch in snapshot.batches


def read(spark: SparkSession, root: str, table: str = MAIN, snapshot: Snapshot | None = None) -> DataFrame:
    """The rows of a table in a snapshot (the newest by default)."""
    held = snapshot or latest(spark, root)
    if table not in held.schemas:
        raise ValueError(f"{table_path(root, table)} has no committed rows; build it first")
    schema = T.StructType.fromJson(json.loads(held.schemas[table]))
    folders = [part_path(root, table, p) for p in held.parts[table]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_part(spark: SparkSession, root: str, part: Part, schema: T.StructType, table: str = MAIN) -> DataFrame:
    """The rows of one folder, committed or not."""
    return spark.read.schema(schema).parquet(part_path(root, table, part))


def verify(spark: SparkSession, root: str, snapshot: Snapshot | None = None) -> Snapshot:
    """Raise ``Torn`` unless every folder has the files, bytes and rows of the manifest.

    Sizes are one call for each folder; rows are counted from the Parquet footers.
    """
    held = snapshot or latest(spark, root)
    for table, parts in held.parts.items():
        for p in parts:
            at = part_path(root, table, p)
            found = files.size(spark, at)
            if found != (p.files, p.bytes):
                raise Torn(f"{at} holds {found}, its manifest says {(p.files, p.bytes)}; build it again")
        if parts and (n := read(spark, root, table, held).count()) != held.rows(table):
            raise Torn(f"{table_path(root, table)} holds {n} rows, its manifest says {held.rows(table)}; build it again")
    return held


def write_part(df: DataFrame, root: str, table: str = MAIN) -> Part:
    """The rows as a new folder of the table, part of no snapshot yet."""
    spark, folder = df.sparkSession, f"commit={uuid.uuid4().hex}"
    at = f"{table_path(root, table)}/{folder}"
    df.write.parquet(at)
    found = files.size(spark, at)
    return Part(folder, found.files, found.bytes, spark.read.schema(df.schema).parquet(at).count())


def write_split(df: DataFrame, root: str, by: list[str], table: str | None = None) -> dict[tuple[str, ...], Part]:
    """The rows in one pass as a new folder, split by the values of ``by`` (text without / or =); a part for each value.

    The split columns are not in the files. The parts may go to different tables, or all to ``table``,
    below whose path the folder then lies. They are of no snapshot yet.
    """
    spark, commit = df.sparkSession, f"commit={uuid.uuid4().hex}"
    base, lead = (table_path(root, table), "") if table else (root.rstrip("/"), "/")
    with settings(spark, spark_sql_maxConcurrentOutputFileWriters=OPEN_FILES):   # few values in a task: no sort of whole rows
        df.write.partitionBy(*by).parquet(f"{base}/{commit}")
    schema = T.StructType([f for f in df.schema if f.name not in by])
    folders = [(commit, ())]
    for column in by:
        folders = [(f"{at}/{name}", (*values, name.split("=", 1)[1])) for at, values in folders
                   for name in files.names(spark, f"{base}/{at}") if name.startswith(f"{column}=")]
    # rows of all folders in one job, from the footers
    place = F.regexp_extract("_metadata.file_path", f"({commit}/.*)/[^/]*$", 1)
    written = spark.read.schema(schema).parquet(*[f"{base}/{at}" for at, _ in folders]) if folders else None
    rows = {r.at: r.n for r in written.groupBy(place.alias("at")).agg(F.count("*").alias("n")).collect()} if folders else {}
    out = {}
    for at, values in folders:
        found = files.size(spark, f"{base}/{at}")
        out[values] = Part(lead + at, found.files, found.bytes, rows[at])
    return out


def publish(spark: SparkSession, root: str, snapshot: Snapshot) -> Snapshot:
    path = f"{_manifests(root)}/{snapshot.version:010d}.json"
    text = json.dumps({"version": snapshot.version, "schemas": snapshot.schemas, "batches": snapshot.batches,
                       "parts": {t: [list(p) for p in ps] for t, ps in snapshot.parts.items()}})
    if not files.publish(spark, text, path):
        raise Conflict(f"{path} was published by another writer")
    return snapshot


def _plain(schema: T.StructType) -> str:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]).json()


def commit(spark: SparkSession, root: str, rows: Mapping[str, DataFrame], batch: str | None = None,
           counts: Mapping[str, int] | None = None, base: Snapshot | None = None,
           written: Mapping[str, tuple[T.StructType, list[Part], list[Part]]] | None = None) -> Snapshot:
    """Append rows to tables, all in one step, and note the batch with its counts.

    A table gets the columns of its first commit. ``written``: tables whose new parts are written
    already, as (schema, new parts, parts that they replace). ``base`` is the snapshot that the rows
    were worked out from: if another was published since, ``Conflict`` is raised.
    """
    held = base if base is not None else latest(spark, root)
    parts = {t: list(ps) for t, ps in held.parts.items()}
    schemas = dict(held.schemas)
    for table, (schema, new, gone) in (written or {}).items():
        schemas.setdefault(table, _plain(schema))
        parts[table] = [p for p in parts.get(table, []) if p not in gone] + [p for p in new if p.rows]
    for table, df in rows.items():
        schemas.setdefault(table, _plain(df.schema))
        df = df.select(*[f"`{f.name}`" for f in T.StructType.fromJson(json.loads(schemas[table]))])
        parts.setdefault(table, [])
        if (part := write_part(df, root, table)).rows:
            parts[table].append(part)
    return record(spark, root, held, parts, schemas, batch, counts)


def record(spark: SparkSession, root: str, base: Snapshot, parts: dict[str, list[Part]], schemas: dict[str, str],
           batch: str | None, counts: Mapping[str, int] | None) -> Snapshot:
    """Publish folders that are written already as the version after ``base``."""
    name = batch if batch is not None else uuid.uuid4().hex
    batches = {**base.batches, name: dict(counts or {})}
    return publish(spark, root, Snapshot(base.version + 1, schemas, parts, batches))


def compact(spark: SparkSession, root: str, table: str = MAIN) -> Snapshot:
    """All folders of a table as one; older snapshots stay readable until ``vacuum``."""
    held = latest(spark, root)
    if len(held.parts.get(table, [])) < 2:
        return held
    parts = {**held.parts, table: [write_part(read(spark, root, table, held), root, table)]}
    return publish(spark, root, held._replace(version=held.version + 1, parts=parts))


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete folders that the newest snapshot does not name (of crashed writers and older versions); returns them.

    Only for a store that no one is writing to, and no one reads an older version of.
    """
    held = latest(spark, root)
    commits = lambda path: path[:path.index("/", path.rindex("commit="))] if "/" in path[path.rindex("commit="):] else path
    keep = {commits(part_path(root, t, p)) for t, parts in held.parts.items() for p in parts}
    gone = []
    for at in {root.rstrip("/"), *(table_path(root, t) for t in held.parts)}:
        for name in files.names(spark, at):
            if name.startswith("commit=") and f"{at}/{name}" not in keep:
                files.remove(spark, f"{at}/{name}")
                gone.append(f"{at}/{name}")
    return gone
