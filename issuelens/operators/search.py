"""A stored vector index and text search over it (JOB-01, JOB-02, SNK-05, SNK-06, SRC-02, JOIN-07).

The store keeps an index as commits of ``snapshot.py``: index rows (repo, issue_key,
text, issuetype, embedding, cell, distance) in the main table, issues whose text the encoder failed on in
``rejected``, the cells of ``cells.py`` in ``centres`` and ``cells``, and the keys alone in ``keys``, split by
key hash, so that a batch finds out what is indexed from the buckets it hits. All appear together.

``search`` opens one snapshot, checks it, encodes the query texts with the instruction that
only queries get, and finds their exact neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TOP_K
from ..functions.embedding import embed
from ..session import materialize, settings
from ..sources.issues import flatten_issues, index_text, query_text, same_issue
from . import cells as cl
from . import neighbours as nb
from . import snapshot as sn
from .index import encode_issues, pending

REJECTED, CENTRES, CELLS, KEYS = "rejected", "centres", "cells", "keys"
KEY_BUCKETS = 32
BATCH_ROWS = 1024   # texts that reach a Python worker at once


def _identity(df: DataFrame) -> list[str]:
    """Columns that tell index rows apart."""
    return [c for c in ("repo", "issue_key") if c in df.columns]


def _bucketed(keys: DataFrame) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64(*_identity(keys)), F.lit(KEY_BUCKETS)).cast("string"))


def _bucket(part: sn.Part) -> str:
    return part.folder.rsplit("bucket=", 1)[1]


def known_keys(spark: SparkSession, root: str, held: sn.Snapshot, keys: DataFrame) -> tuple[DataFrame, list[sn.Part]]:
    """The stored keys of the buckets that ``keys`` (repo, issue_key) fall in, and the parts that are read for them.

    At most ``KEY_BUCKETS`` bucket numbers reach the driver. No other part of the index is opened.
    """
    hit = {r.bucket for r in _bucketed(keys).select("bucket").distinct().collect()}
    parts = [p for p in held.parts.get(KEYS, []) if _bucket(p) in hit]
    return sn.read(spark, root, KEYS, held._replace(parts={KEYS: parts})), parts


def _key_parts(spark: SparkSession, root: str, held: sn.Snapshot, keys: DataFrame) -> tuple[list[sn.Part], list[sn.Part]]:
    """New parts of the key table, and the older parts merged into them.

    In every bucket the new keys take in the parts that are no larger than what is gathered so far,
    smallest first, so a bucket of N keys has about log N parts and a key is rewritten about log N times.
    """
    fresh = {r.bucket: r.n for r in _bucketed(keys).groupBy("bucket").agg(F.count("*").alias("n")).collect()}   # KEY_BUCKETS rows at most
    gone = []
    for bucket, n in fresh.items():
        for p in sorted((p for p in held.parts.get(KEYS, []) if _bucket(p) == bucket), key=lambda p: p.rows):
            if p.rows > n:
                break
            gone.append(p)
            n += p.rows
    rows = keys
    if gone:
        rows = rows.unionByName(sn.read(spark, root, KEYS, held._replace(parts={KEYS: gone})))
    if not fresh:
        return [], []
    return list(sn.write_split(_bucketed(rows).repartition("bucket"), root, ["bucket"], KEYS).values()), gone


def add(spark: SparkSession, root: str, issues: DataFrame, encoder=None, batch: str | None = None) -> sn.Snapshot:
    """Encode the issues that the index does not hold, and commit them.

    ``issues``: (repo, _id, key, fields). Every issue ends in exactly one count of the
    batch: ``read`` = ``repeated`` (again in this batch) + ``known`` (in the index) +
    ``indexed`` + ``rejected``. A batch whose name is in the ledger is not read at all. A
    crash before the commit leaves the store as it was.
    """
    held = sn.latest(spark, root)
    if batch is not None and sn.done(held, batch):
        return held
    on = same_issue(issues)
    read = issues.count()
    keys = issues.select(*on).distinct()
    distinct = keys.count()
    fresh, new = issues, distinct
    if KEYS in held.schemas:
        # before encoding: issues indexed already are never embedded again
        known = known_keys(spark, root, held, keys.withColumnRenamed("key", "issue_key"))[0]
        fresh, new = pending(issues, known), pending(keys, known).count()
    fresh = _once(fresh, on) if distinct < read else fresh
    lost: dict[str, DataFrame] = {}

    def rejects(indexed: DataFrame, n: int) -> dict[str, DataFrame]:
        if n < new:   # texts without a vector: known once all others are written
            lost[REJECTED] = _texts(_except(fresh, indexed.withColumnRenamed("issue_key", "key"), on))
        return lost

    counts = {"read": read, "repeated": read - distinct}
    return _commit(spark, root, held, lambda rows: encode_issues(rows, encoder), fresh, new, rejects, batch,
                   lambda indexed: counts | {"rejected": new - indexed, "indexed": indexed, "known": distinct - new})


def _texts(issues: DataFrame) -> DataFrame:
    """The index rows of issues without their vectors."""
    keep = ["repo"] if "repo" in issues.columns else []
    return index_text(flatten_issues(issues, keep)).select(*keep, F.col("key").alias("issue_key"), "text", "issuetype")


def _matched(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join in which a null equals a null."""
    other = keys.withColumnsRenamed({c: f"_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, same, how)


def _except(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return _matched(rows, keys, on, "left_anti")


def _once(issues: DataFrame, on: list[str]) -> DataFrame:
    """Every issue once. Only those that come again are dealt by key; the others' texts stay where they are read."""
    again = materialize(issues.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").select(*on), "again")
    return _except(issues, again, on).unionByName(_matched(issues, again, on, "left_semi").dropDuplicates(on))


def _commit(spark: SparkSession, root: str, held: sn.Snapshot, encode: Callable[[DataFrame], DataFrame], issues: DataFrame, n: int,
            rejects: Callable[[DataFrame, int], dict[str, DataFrame]], batch: str | None, counts) -> sn.Snapshot:
    """Encode ``n`` issues and commit those with a vector, laid out by cell, with their cells and keys, and the ``rejects``.

    The first commit that has rows chooses the centres; later rows join its cells. A text is read, encoded, placed
    and written in one pass: each task sorts what it reads by cell, so that a scan skips the pages of other cells,
    and no text is dealt anew. Without rows only the batch is noted.
    """
    if not n and held.version:
        return sn.commit(spark, root, {}, batch, counts(0), held)
    tables: dict[str, DataFrame] = {}
    with settings(spark, spark_sql_execution_arrow_maxRecordsPerBatch=BATCH_ROWS):
        if held.rows(CENTRES):
            centres = sn.read(spark, root, CENTRES, held)
        else:
            centres = tables[CENTRES] = materialize(_first_centres(encode, issues, n), "centres")
        good = encode(issues)
        good = good.where(F.col("embedding").isNotNull())
        placed = cl.assign(good, centres).sortWithinPartitions("cell")
        part = sn.write_part(placed, root)
    rows = sn.read_part(spark, root, part, placed.schema)
    tables |= rejects(rows.select(*_identity(rows)), part.rows)
    if not part.rows and held.version:
        return sn.commit(spark, root, {t: df for t, df in tables.items() if t != CENTRES}, batch, counts(0), held)
    keys = rows.select(*_identity(rows))
    new, gone = _key_parts(spark, root, held, keys)
    return sn.commit(spark, root, {**tables, CELLS: cl.cell_table(rows)}, batch, counts(part.rows), held,
                     written={sn.MAIN: (placed.schema, [part], []), KEYS: (keys.schema, new, gone)})


def _first_centres(encode: Callable[[DataFrame], DataFrame], issues: DataFrame, n: int) -> DataFrame:
    """Centres of a new index of ``n`` rows: only the texts drawn for them are encoded; all of them, where none of those has a vector."""
    key = "key" if "key" in issues.columns else "issue_key"
    on = [c for c in ("repo", key) if c in issues.columns]
    drawn = materialize(issues.select(*on).orderBy(F.xxhash64(key), *on[::-1]).limit(cl.centre_count(n)), "drawn")   # keys alone meet in one task
    for rows in (_matched(issues, F.broadcast(drawn), on, "left_semi"), issues):
        centres = cl.choose_centres(encode(rows).where(F.col("embedding").isNotNull()).withColumnRenamed("issue_key", "key"), n)
        if not centres.isEmpty():
            break
    return centres


def retry_rejected(spark: SparkSession, root: str, encoder=None) -> sn.Snapshot:
    """Encode the rejects again and commit those that succeed now."""
    held = sn.latest(spark, root)
    again = materialize(rejected(spark, root, held), "retried")
    read = again.count()
    return _commit(spark, root, held, lambda rows: embed(rows, "text", encoder=encoder), again, read, lambda indexed, n: {}, None,
                   lambda indexed: {"read": read, "repeated": 0, "known": 0, "indexed": indexed, "rejected": read - indexed})


def rejected(spark: SparkSession, root: str, snapshot: sn.Snapshot | None = None) -> DataFrame:
    """Issues whose text the encoder failed on and that no later batch has indexed, once each."""
    held = snapshot or sn.latest(spark, root)
    if not held.rows(REJECTED):
        return sn.read(spark, root, snapshot=held).limit(0).select("repo", "issue_key", "text", "issuetype")
    lost = sn.read(spark, root, REJECTED, held)
    lost = lost.dropDuplicates(_identity(lost))
    return pending(lost, sn.read(spark, root, KEYS, held), key="issue_key")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """A row for each batch: batch, read, repeated, known, indexed, rejected."""
    held = sn.latest(spark, root)
    names = ("read", "repeated", "known", "indexed", "rejected")
    rows = [(b, *[c.get(n, 0) for n in names]) for b, c in held.batches.items()]
    return spark.createDataFrame(rows, "batch string, " + ", ".join(f"{n} long" for n in names))


def open_index(spark: SparkSession, root: str, version: int | None = None) -> tuple[sn.Snapshot, DataFrame, cl.Cells]:
    """SNK-06: a checked snapshot of the index with its rows and cells.

    Raises if nothing is there, if files, bytes or rows differ from the manifest, or if
    the ledger's counts are not the rows: an index is whole or is built again.
    """
    held = sn.latest(spark, root, version)
    if not held.rows():
        raise ValueError(f"{root} holds no index; build it first")
    sn.verify(spark, root, held)
    indexed = sum(c.get("indexed", 0) for c in held.batches.values())
    if held.rows(KEYS) != held.rows():
        raise sn.Torn(f"{root}: {held.rows()} rows, {held.rows(KEYS)} keys; build it again")
    cells = cl.load_cells(sn.read(spark, root, CENTRES, held), sn.read(spark, root, CELLS, held))
    if indexed != held.rows() or int(cells.rows.sum()) != held.rows():
        raise sn.Torn(f"{root}: {held.rows()} rows, {indexed} in the ledger, {int(cells.rows.sum())} in cells; build it again")
    return held, sn.read(spark, root, snapshot=held), cells


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = TOP_K, encoder=None, exclude_self: bool = False,
           text: str = "query", version: int | None = None) -> DataFrame:
    """JOB-02: (query_id, rank, key, similarity, text, issuetype) for texts (query_id, ``text``) against the stored index."""
    _, index, cells = open_index(spark, root, version)
    encoded = embed(query_text(queries, text), "query_text", encoder=encoder).select("query_id", "embedding")
    found, _ = cl.search(encoded, index.withColumnRenamed("issue_key", "key"), cells, k, exclude_self)
    return found


def search_one(spark: SparkSession, root: str, text: str, k: int = TOP_K, encoder=None) -> DataFrame:
    """The neighbours of one text, best first: issue_key, similarity, text, issuetype."""
    query = spark.createDataFrame([("0", text)], "query_id string, query string")
    return nb.neighbour_rows(search(spark, root, query, k, encoder)).orderBy("rank").drop("query_id", "rank")
