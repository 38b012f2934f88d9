"""Packing documents into sequences by a linear grouping scheme.

1. Documents become pieces of at most ``capacity`` tokens (ids plus a separator); only
   longer ones are cut, and the first piece is the short one. Pieces are written out.
2. Their lengths, at most ``capacity`` different ones, are counted; everything planned on
   the driver comes from these counts, so its size does not depend on the input.
3. ``plan_with``: lengths over ``large`` are dealt, longest first, into groups of equally many
   pieces and rounded up to the longest of their group. A linear program over the ways to
   fill a sequence with the few rounded sizes (columns made by a knapsack) gives how often
   each way is used. The rounded sizes are then replaced by the actual lengths of their
   group, and what is left over, together with the small pieces, goes by decreasing
   length where it fits best.
4. The plan says, for each length, which sequences its first, second, ... piece goes to.
   Pieces are numbered within their length: counts of (length, bucket) are summed along
   the buckets, and rows are numbered within (length, bucket).

Defined results: a null text is empty (one separator); repeated rows are packed each; a
null id is kept; empty tables give empty results; other columns are ignored, whatever
their names. Texts of any length are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land, tasks
from issuelens.llm.tokens import encoder

CAPACITY = 2048
SEPARATOR = 0
GROUPS = 128  # rounded sizes of large pieces
SHARES = (2, 3)  # pieces over this part of the capacity are large; both plans are made, the shorter one counts


class Slots(NamedTuple):
    """Pieces ``first`` to ``first + n - 1`` of a length, ``each`` of them in every sequence from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    n: int
    sequence: int
    each: int
    offset: int


def _best_column(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of a sequence: how many pieces of each size."""
    most = capacity // int(sizes.min())
    best = [np.zeros(capacity + 1)]
    at = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits = at >= 0
    choice = []
    for _ in range(most):
        taken = np.where(fits, best[-1][np.maximum(at, 0)] + values[:, None], -1.0)
        pick = taken.argmax(axis=0)
        got = taken[pick, np.arange(capacity + 1)]
        better = got > best[-1] + 1e-12
        choice.append(np.where(better, pick, -1))
        best.append(np.where(better, got, best[-1]))
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for k in range(most - 1, -1, -1):
        pick = choice[k][room]
        if pick >= 0:
            counts[pick] += 1
            room -= int(sizes[pick])
    return float(best[-1][capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Fillings and how often to use each, so that every size's demand is met with the fewest sequences (fractional)."""
    s, n = np.array(sizes, np.int64), np.array(demand, float)
    columns = [np.eye(len(s), dtype=np.int64)[k] * (capacity // s[k]) for k in range(len(s))]
    inverse = np.diag(1.0 / np.array([c[k] for k, c in enumerate(columns)], float))
    used = inverse @ n
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, column = _best_column(s, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        used = used - ratio[out] * change
        used[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
        columns[out] = column
    return [(c, max(0.0, float(u))) for c, u in zip(columns, used, strict=True)]


def _groups(counts: dict[int, int], large: int, groups: int) -> list[list[list[int]]]:
    """Lists of [length, pieces], longest first, of equally many pieces each."""
    total = sum(n for length, n in counts.items() if length > large)
    each = -(-total // groups) if total else 1
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted((x for x in counts if x > large), reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = each
            take = min(left, room)
            out[-1].append([length, take])
            left, room = left - take, room - take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[Slots], int]:
    """Slots for every piece, and the number of sequences, from the pieces of each length."""
    return min((plan_with(counts, capacity, groups, capacity // share) for share in SHARES), key=lambda p: p[1])


def plan_with(counts: dict[int, int], capacity: int, groups: int, large: int) -> tuple[list[Slots], int]:
    """As ``plan``, with lengths over ``large`` as the large ones."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    bins: list[tuple[int, list[tuple[int, int]]]] = []  # sequences, [length, pieces in each]
    full = counts.pop(capacity, 0)
    if full:
        bins.append((full, [(capacity, 1)]))
    grouped = _groups(counts, large, groups)
    by_size: dict[int, list[list[int]]] = {}
    for g in grouped:  # groups whose longest pieces are equal are one
        by_size.setdefault(g[0][0], []).extend(g)
    sizes = sorted(by_size, reverse=True)
    rest = {k: v for k, v in counts.items() if k <= large}
    if sizes:
        demand = [sum(n for _, n in by_size[s]) for s in sizes]
        for column, use in configurations(sizes, demand, capacity):
            left = int(use + 1e-6)
            slots = [(k, int(m)) for k, m in enumerate(column) if m]
            while left:
                queues = [by_size[sizes[k]] for k, _ in slots]
                if any(sum(n for _, n in q) < m for q, (_, m) in zip(queues, slots, strict=True)):
                    break
                same = min(q[0][1] // m for q, (_, m) in zip(queues, slots, strict=True))
                times = max(1, min(left, same))
                held: list[tuple[int, int]] = []
                for q, (_, m) in zip(queues, slots, strict=True):
                    need = m * times
                    while need:
                        take = min(need, q[0][1])
                        held.append((q[0][0], take // times if same else take))
                        q[0][1] -= take
                        need -= take
                        if not q[0][1]:
                            q.pop(0)
                bins.append((times, held))
                left -= times
        for q in by_size.values():
            for length, n in q:
                rest[length] = rest.get(length, 0) + n
    # Best fit, by decreasing length: sequences of equal room are handled together.
    by_room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    for times, held in bins:
        by_room[capacity - sum(length * m for length, m in held)].append((times, held))

    def put(times: int, held: list[tuple[int, int]], room: int, length: int, each: int) -> None:
        by_room[room - length * each].append((times, [*held, (length, each)]))

    for length in sorted(rest, reverse=True):
        left, room = rest[length], length
        while left and room <= capacity:
            if not by_room[room]:
                room += 1
                continue
            times, held = by_room[room].pop()
            each = room // length
            whole = min(times, left // each)
            if whole:
                put(whole, held, room, length, each)
                left -= whole * each
                times -= whole
            if times and left and left < each:
                put(1, held, room, length, left)
                left, times = 0, times - 1
            if times:
                by_room[room].append((times, held))
        each = capacity // length
        if left // each:
            put(left // each, [], capacity, length, each)
        if left % each:
            put(1, [], capacity, length, left % each)
    slots_out, seen, sequence = [], dict.fromkeys([*counts, capacity], 0), 0
    for times, held in (b for room in by_room for b in room):
        offset = 0
        for length, each in held:
            slots_out.append(Slots(length, seen[length], times * each, sequence, each, offset))
            seen[length] += times * each
            offset += length * each
        sequence += times
    return slots_out, sequence


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str | None, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary, ranks).encode
    separator = SEPARATOR.to_bytes(4, "little")
    for batch in batches:
        rows: dict[str, list] = {"id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
        for id_, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            ids = encode(text) + separator
            n, start, piece = len(ids) // 4, 0, 0
            while start < n:
                length = (n % capacity or capacity) if start == 0 else capacity
                part = ids[4 * start:4 * (start + length)]
                for name, value in zip(rows, (id_, piece, start, length, zlib.crc32(part), part if with_ids else None), strict=True):
                    rows[name].append(value)
                start, piece = start + length, piece + 1
        ids_of = pa.array([x.as_py() for x in rows["id"]], batch.schema.field(0).type)
        yield pa.RecordBatch.from_arrays(
            [ids_of, pa.array(rows["piece"], pa.int32()), *(pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")),
             pa.array(rows["ids"], pa.binary())], names=list(rows))


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, id: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and (with_ids) ids of every piece; ids as little-endian unsigned 32-bit numbers."""
    rows = keep_row(docs).select(F.col("row")[id].alias("id"), F.col("row")[text].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _cut(it, vocabulary, ranks, capacity, with_ids),
                           f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def _place(slots: list[Slots], length: Column, rank: Column) -> Column:
    """sequence_id and offset of the rank-th piece (from 0) of a length."""
    order = sorted(slots)
    table = np.array(order, np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 48) + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 48) + rank.to_numpy(), side="right") - 1
        within = rank.to_numpy() - table[at, 1]
        return pd.DataFrame({"sequence_id": table[at, 3] + within // table[at, 4],
                             "offset": table[at, 5] + within % table[at, 4] * table[at, 0]})

    return look_up(length, rank)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS,
         id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces with their ``sequence_id`` and ``offset``."""
    buckets = 4 * tasks(docs.sparkSession)
    cut = pieces(docs, vocabulary, ranks, capacity, id, text, with_ids)
    cut = land((cut if with_ids else cut.drop("ids")).withColumn(
        "bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    # At most ``capacity`` counts.
    slots, _ = plan({r.length: r["count"] for r in cut.groupBy("length").count().collect()}, capacity, groups)
    along = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = (cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
              .select("length", "bucket", F.coalesce(F.sum("n").over(along), F.lit(0).cast("long")).alias("before")))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    return ranked.withColumn("place", _place(slots, F.col("length"), F.col("rank"))).select(
        "id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (in order of offset) and the ids of its pieces' documents, from ``pack(with_ids=True)``."""
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "ids", "id")))  # at most ``capacity`` tokens
    return packed.groupBy("sequence_id").agg(held.alias("p")).select(
        "sequence_id", F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"),
        F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.col("p.id").alias("documents"))
