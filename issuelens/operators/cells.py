"""Exact top-k over an index whose rows are grouped in cells, skipping the cells that cannot matter (JOIN-01).

An index row belongs to the cell of its nearest centre. Centres are at most ``MAX_CELLS``
rows of the index (those whose keys hash lowest), so they fit the driver and a broadcast
whatever the size of the index; for every cell its radius (largest distance of a row to the
centre) and its number of rows are kept. No row of cell c has an inner product with q
above ``q . centre + |q| * radius``, which gives an exact search in two passes:

1. each query looks into the cells of highest product with their centres, as few as hold k
   rows; the k-th similarity found there is its bound;
2. it looks into those other cells whose upper limit reaches the bound, ties included.

A cell that no query needs is not read: index rows lie sorted by cell, and the cells
needed reach the scan as ranges. A row meets only the queries that need its cell. Where
the queries are proven few their matrix is broadcast; else queries and rows meet in groups
of (bin, part, block): small cells share a bin, to which a query goes once with the list of its
cells there, a large cell is split into parts and many queries of one bin into
blocks, so that no group is larger than ``BLOCK_ROWS`` rows on either side. A query is copied once for each
``BLOCK_ROWS`` rows of the index, not for each cell: without any clusters it needs nearly all cells. Both ways give
the same rows and the same similarities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TOP_K
from ..session import materialize
from . import neighbours as nb

MAX_CELLS = 1024
ROWS_A_CELL = 64   # aimed at while an index is small


class Cells(NamedTuple):
    """Centres (a row for each cell), radius and number of rows of each."""

    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


def centre_count(rows: int) -> int:
    return max(1, min(MAX_CELLS, rows // ROWS_A_CELL))


def choose_centres(vectors: DataFrame, rows: int) -> DataFrame:
    """(cell, centre): rows of the index itself, ``MAX_CELLS`` at most, the same ones in every run."""
    n = centre_count(rows)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("embedding").isNotNull() & ~bad).select("key", "embedding")
    drawn = usable.orderBy(F.xxhash64("key"), "key").limit(n).toPandas()   # n rows, not the index
    schema = "cell int, centre array<double>"
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(drawn["embedding"])], schema)


def _centre_matrix(centres: DataFrame) -> np.ndarray:
    rows = sorted(centres.collect(), key=lambda r: r.cell)   # MAX_CELLS rows at most
    return np.array([r.centre for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))


def assign(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``cell`` and ``distance`` to its centre beside every row; null without a vector of finite numbers."""
    M = _centre_matrix(centres)
    half = (M * M).sum(axis=1) / 2

    @F.pandas_udf("cell int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": pd.array([pd.NA] * len(vectors), dtype="Int32"), "distance": np.full(len(vectors), np.nan)})
        there = np.flatnonzero(vectors.notna().to_numpy())
        if len(there) and len(M):
            V = nb.matrix(vectors.iloc[there])
            finite = np.isfinite(V).all(axis=1)
            V, there = V[finite], there[finite]
        if len(there) and len(M):
            cell = np.concatenate([(V[k:k + 4096] @ M.T - half).argmax(axis=1) for k in range(0, len(V), 4096)])
            out.iloc[there, 0] = cell
            out.iloc[there, 1] = np.linalg.norm(V - M[cell], axis=1)
        return out

    placed = rows.withColumn("_p", nearest.asNondeterministic()("embedding"))
    return placed.select(*rows.columns, F.col("_p.cell").alias("cell"), F.col("_p.distance").alias("distance"))


def cell_table(placed: DataFrame) -> DataFrame:
    """(cell, rows, radius) of ``assign``: what a commit adds to the table of cells."""
    return (placed.where(F.col("cell").isNotNull()).groupBy("cell")
            .agg(F.count("*").alias("rows"), F.max("distance").alias("radius")))


def load_cells(centres: DataFrame, cells: DataFrame) -> Cells:
    """Centres with the sums of all commits; ``MAX_CELLS`` rows at most reach the driver."""
    M = _centre_matrix(centres)
    radius, rows = np.zeros(len(M)), np.zeros(len(M), np.int64)
    for r in cells.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius")).collect():
        radius[r.cell], rows[r.cell] = r.radius, r.rows
    return Cells(M, radius, rows)


def limits(Q: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """For queries x cells: product with the centre, and what no row's product exceeds (-inf for empty cells)."""
    centre = Q @ cells.centres.T
    norms = np.linalg.norm(Q, axis=1)[:, None]
    rounding = 1e-13 * norms * (np.linalg.norm(cells.centres, axis=1) + cells.radius)
    upper = centre + norms * cells.radius + rounding
    upper[:, cells.rows == 0] = centre[:, cells.rows == 0] = -np.inf
    return centre, upper


def first_cells(centre: np.ndarray, cells: Cells, need: int) -> np.ndarray:
    """Mask: for each query the cells of highest product with their centres that together hold ``need`` rows."""
    order = np.argsort(-centre, axis=1, kind="stable")
    before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
    mask = np.zeros(centre.shape, bool)
    np.put_along_axis(mask, order, before < need, axis=1)
    return mask & (cells.rows > 0)


def bins(cells: Cells, block_rows: int) -> np.ndarray:
    """Bin of each cell: successive cells of up to ``block_rows`` rows together, a larger one alone."""
    out, number, held = np.zeros(len(cells.rows), np.int32), 0, 0
    for c, n in enumerate(cells.rows.tolist()):
        if held and held + n > block_rows:
            number, held = number + 1, 0
        out[c], held = number, held + n
    return out


WANTS = "array<struct<bin:int,cells:array<int>>>"


def _plan_cells(cells: Cells, of: np.ndarray, need: int, second: bool):
    """Function of batches (query_id, embedding, bound): (query_id, embedding, wants), the cells to look into by bin (``of``), in the first or second pass."""
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["embedding"].notna()]
            if not len(pdf) or not len(cells.rows):
                continue
            for k in range(0, len(pdf), 1024):
                part = pdf.iloc[k:k + 1024]
                centre, upper = limits(nb.matrix(part["embedding"]), cells)
                mask = first_cells(centre, cells, need)
                if second:
                    mask = ~mask & (upper >= part["bound"].to_numpy()[:, None]) & (cells.rows > 0)
                wants = [[{"bin": int(of[c[0]]), "cells": c.astype(np.int32)} for c in np.split(row, np.searchsorted(row, starts[1:])) if len(c)]
                         for row in map(np.flatnonzero, mask)]
                yield part[["query_id", "embedding"]].assign(wants=wants)

    return plan


def cell_ranges(cells: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as ranges."""
    out: list[tuple[int, int]] = []
    for c in sorted(cells):
        if out and c == out[-1][1] + 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def _needed(rows: DataFrame, cells: list[int]) -> DataFrame:
    """Rows of these cells, as ranges that reach the scan."""
    keep = F.lit(False)
    for low, high in cell_ranges(cells):
        keep = keep | F.col("cell").between(low, high)
    return rows.where(keep)


def _match_small(small: tuple[np.ndarray, np.ndarray], wanted: dict[int, np.ndarray], rows: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Rows against the broadcast queries that want their cell (``wanted``: places in the matrix by cell)."""
    shared = rows.sparkSession.sparkContext.broadcast((small, wanted))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (qids, Q), by_cell = shared.value
        best = nb.Best(Q, qids, k, exclude_self)
        for pdf in batches:
            C, keys, cell = nb.matrix(pdf["embedding"]), pdf["key"].astype(object).to_numpy(), pdf["cell"].to_numpy()
            for c in np.unique(cell):
                if (queries := by_cell.get(int(c))) is not None:
                    here = cell == c
                    best.add(C[here], keys[here], queries)
        yield best.rows()

    return nb.spread(rows.select("key", "embedding", "cell")).mapInPandas(scan, nb.PAIR_SCHEMA)


def _bin_pair(k: int, exclude_self: bool):
    """Function of one group of queries (query_id, qvec, cells) and one of rows (key, cvec, cell): each row meets the queries that want its cell."""

    def pair(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        best = nb.Best(nb.matrix(qpdf["qvec"]), qpdf["query_id"].astype(object).to_numpy(), k, exclude_self)
        if len(qpdf) and len(cpdf):
            wanted = np.concatenate(qpdf["cells"].to_list())
            queries = np.repeat(np.arange(len(qpdf)), qpdf["cells"].map(len))
            C, keys, cell = nb.matrix(cpdf["cvec"]), cpdf["key"].astype(object).to_numpy(), cpdf["cell"].to_numpy()
            for c in np.unique(cell):
                here, mine = cell == c, queries[wanted == c]
                best.add(C[here], keys[here], mine)
        return best.rows()

    return pair


def _match_large(pairs: DataFrame, rows: DataFrame, cells: Cells, of: np.ndarray, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """Queries and rows meet in groups of (bin, part of its rows, block of its queries)."""
    spark = rows.sparkSession
    flat = pairs.select("query_id", F.col("embedding").alias("qvec"), F.explode("wants").alias("w")).select("query_id", "qvec", "w.*")
    sizes = [(r.bin, int(-(-cells.rows[of == r.bin].sum() // block_rows)), int(-(-r.n // block_rows)))
             for r in flat.groupBy("bin").agg(F.count("*").alias("n")).collect()]   # MAX_CELLS rows at most
    known = lambda: F.broadcast(spark.createDataFrame(sizes, "bin int, parts int, blocks int"))
    bin_of = F.broadcast(spark.createDataFrame([(c, int(b)) for c, b in enumerate(of)], "cell int, bin int"))
    q = (flat.join(known(), "bin")
         .withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
         .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    c = (rows.select("key", F.col("embedding").alias("cvec"), "cell").join(bin_of, "cell").join(known(), "bin")
         .withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    by = ["bin", "part", "block"]
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(_bin_pair(k, exclude_self), nb.PAIR_SCHEMA)


class Visits(NamedTuple):
    """Pairs of query and cell looked into in each pass, and all that there are."""

    first: int
    second: int
    all: int


def search(queries: DataFrame, rows: DataFrame, cells: Cells, k: int = TOP_K, exclude_self: bool = False, metadata=("text", "issuetype"),
           max_broadcast_queries: int = nb.MAX_BROADCAST_QUERIES, block_rows: int = nb.BLOCK_ROWS) -> tuple[DataFrame, Visits]:
    """Top k rows for each query, and what was looked into.

    ``queries``: (query_id, embedding); ``rows``: (key, embedding, cell, *metadata). Returns
    (query_id, rank, key, similarity, *metadata), equal to a search of all rows.
    """
    need = k + 1 if exclude_self else k
    small = nb.small_queries(queries, max_broadcast_queries)
    usable = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    if small is not None:
        return _search_small(small, rows, cells, k, need, exclude_self, metadata)
    usable = materialize(usable, "queries")
    of, kind = bins(cells, block_rows), usable.schema["embedding"].dataType.simpleString()
    found, counts, bounds = None, [], usable.withColumn("bound", F.lit(float("-inf")))
    for second in (False, True):
        schema = f"query_id string, embedding {kind}, wants {WANTS}"
        pairs = materialize(bounds.mapInPandas(_plan_cells(cells, of, need, second), schema), "cells")
        looked = pairs.select(F.explode(F.flatten("wants.cells")).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()   # MAX_CELLS rows at most
        counts.append(sum(r.n for r in looked))
        part = _match_large(pairs, _needed(rows, [r.cell for r in looked]), cells, of, k, exclude_self, block_rows)
        part = materialize(nb.rank_top_k(part, k).drop("rank"), "found")
        found = part if found is None else found.unionByName(part)
        if not second:
            kth = part.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("kth"))
            bounds = usable.join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce("kth", F.lit(float("-inf"))).alias("bound"))
    visits = Visits(*counts, usable.count() * int((cells.rows > 0).sum()))
    return nb.with_metadata(nb.rank_top_k(found, k), rows, metadata, False), visits


def _search_small(small: tuple[np.ndarray, np.ndarray], rows: DataFrame, cells: Cells, k: int, need: int, exclude_self: bool, metadata):
    qids, Q = small
    spark = rows.sparkSession
    few = k * len(qids) <= nb.MAX_BROADCAST_SURVIVORS
    if not len(qids) or not len(cells.rows):
        return nb.with_metadata(spark.createDataFrame([], nb.PAIR_SCHEMA + ", rank int"), rows, metadata, few), Visits(0, 0, 0)
    centre, upper = limits(Q, cells)
    mask = first_cells(centre, cells, need)

    def look(mask: np.ndarray) -> DataFrame:
        wanted = {int(c): np.flatnonzero(mask[:, c]) for c in np.flatnonzero(mask.any(axis=0))}
        pairs = _match_small(small, wanted, _needed(rows, list(wanted)), k, exclude_self)
        return materialize(nb.rank_top_k(pairs, k).drop("rank"), "found")

    first = look(mask)
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("kth")).toPandas()   # a row for each broadcast query
    bound = pd.Series(qids).map(dict(zip(kth["query_id"], kth["kth"]))).astype(float).fillna(-np.inf).to_numpy()
    rest = ~mask & (upper >= bound[:, None]) & (cells.rows > 0)
    found = first.unionByName(look(rest)) if rest.any() else first
    visits = Visits(int(mask.sum()), int(rest.sum()), len(qids) * int((cells.rows > 0).sum()))
    return nb.with_metadata(nb.rank_top_k(found, k), rows, metadata, few), visits


def cell_index(rows: DataFrame) -> tuple[DataFrame, Cells]:
    """Rows (key, embedding, ...) laid out by cell as a table in the shared folder, and their cells."""
    held = materialize(rows, "rows")
    centres = choose_centres(held, held.count())
    placed = materialize(assign(held, centres).repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell"), "cells")
    return placed.drop("distance"), load_cells(centres, cell_table(placed))
