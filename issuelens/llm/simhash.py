"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

1. ``fingerprint`` turns each whole text into 64 bits (Arrow batches, vectorised bit counts).
2. Equal fingerprints become one. Two that differ in at most ``bits`` bits agree in one
   of ``bits + 1`` blocks, so the trie is dealt out by (block, value): each fingerprint,
   rotated so that the block leads, goes to ``bits + 1`` subtrees.
3. ``_Trie`` walks pairs of nodes of those subtrees together, one bit a level, adds up the
   differing bits and drops a pair when they exceed the budget. Nodes whose leaves
   are one component already are dropped too, and a subtree returns links that span its
   components (fewer than leaves), not all pairs.
4. ``components`` joins the links of all subtrees.

A subtree with more than ``SUBTREE`` fingerprints is cut further on its most balanced
bits; only pairs of cut subtrees within the budget are walked, each in a task of its own.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other;
a component's id is its smallest non-null doc_id (null if it has none); repeated rows and
repeated ids are rows of their own; empty tables give empty results; other columns are
carried along, whatever their names; long texts are hashed in pieces of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land, row_hashes, tasks, text_of
from issuelens.llm.components import components

SEED = 42
PIECE = 1 << 20  # bytes of text hashed at once
SUBTREE = 50_000  # fingerprints of a subtree before it is cut further
MOST_CUTS = 12  # bits a subtree is cut on at most (4096 cut subtrees)
CHUNK = 1 << 14  # node pairs expanded at once (or an eighth of the leaves)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def simhash(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint: a bit is set if over half of the shingle hashes have it set."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower: A-Z only
    blank = re.compile(rb"[\x20\x09-\x0d]")
    counts, n, words, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = blank.search(data, end)
            end = cut.start() if cut else len(data)
        words += data[at:end].split()  # bytes.split: the six blanks
        at = end
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            m = len(words) - shingle + 1
            hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, m)
            for k in range(0, m, 1 << 16):
                counts += _bit_counts(hashes[k:k + (1 << 16)])
            n += m
            words = words[m:]
    if not n:
        if not words:
            return 0
        counts, n = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)), 1
    return int(sum(1 << b for b in range(64) if 2 * counts[b] > n))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint of a text column, as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


class _Trie:
    """Walks the pairs of nodes of two sorted arrays (or of one with itself) together.

    A node is a range of an array whose members agree in all higher bits.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray | None, bits: int):
        self.same = b is None
        self.a, self.b, self.bits = a, a if self.same else b, bits
        self.chunk = max(CHUNK, len(self.a) // 8)
        self.shift = 0 if self.same else len(a)  # where b starts in label
        self.label = np.arange(len(a) + (0 if self.same else len(b)))
        self._mark()

    def _mark(self) -> None:
        change = np.zeros(len(self.label), np.int64)
        np.cumsum(self.label[1:] != self.label[:-1], out=change[1:])
        self.change = change

    def _link(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            lu, lv = label[u], label[v]
            if (lu == lv).all():
                break
            low = np.minimum(lu, lv)
            np.minimum.at(label, lu, low)
            np.minimum.at(label, lv, low)
            while True:  # to the roots
                up = label[label]
                if (up == label).all():
                    break
                label = up
        self.label = label
        self._mark()

    def _one(self, lo: np.ndarray, hi: np.ndarray, shift: int) -> np.ndarray:
        return self.change[lo + shift] == self.change[hi - 1 + shift]

    @staticmethod
    def _split(x: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
        one = np.uint64(1 << level)
        top = np.uint64((~((1 << (level + 1)) - 1)) & 0xFFFFFFFFFFFFFFFF)
        return np.searchsorted(x, (x[lo] & top) | one)

    def walk(self, level: int, alo, ahi, blo, bhi) -> np.ndarray:
        """Labels of the leaves after walking the given pairs from bit ``level`` down."""
        stack = [(level, alo, ahi, blo, bhi, np.zeros(len(alo), np.int64))]
        while stack:
            level, alo, ahi, blo, bhi, d = stack.pop()
            if len(alo) > self.chunk:
                stack.append((level, *(x[:-self.chunk] for x in (alo, ahi, blo, bhi, d))))
                alo, ahi, blo, bhi, d = (x[-self.chunk:] for x in (alo, ahi, blo, bhi, d))
            joined = (self._one(alo, ahi, 0) & self._one(blo, bhi, self.shift)
                      & (self.label[alo] == self.label[blo + self.shift]))
            leaves = ~joined & (ahi - alo == 1) & (bhi - blo == 1)
            if leaves.any():
                u, v = alo[leaves], blo[leaves]
                near = np.bitwise_count(self.a[u] ^ self.b[v]) <= self.bits
                if near.any():
                    self._link(u[near], v[near] + self.shift)
            go = ~joined & ~leaves
            if level < 0 or not go.any():
                continue
            alo, ahi, blo, bhi, d = alo[go], ahi[go], blo[go], bhi[go], d[go]
            am, bm = self._split(self.a, alo, level), self._split(self.b, blo, level)
            twin = (alo == blo) & (ahi == bhi) if self.same else np.zeros(len(alo), bool)
            parts = [(alo, am, blo, bm, d, None), (am, ahi, bm, bhi, d, None),
                     (alo, am, bm, bhi, d + 1, None), (am, ahi, blo, bm, d + 1, ~twin)]
            alo, ahi, blo, bhi, d = (np.concatenate([p[k] if p[5] is None else p[k][p[5]] for p in parts]) for k in range(5))
            ok = (ahi > alo) & (bhi > blo) & (d <= self.bits)
            # Pairs of the fewest differing bits last: they are popped first and join components early.
            order = np.argsort(-d[ok], kind="stable")
            stack.append((level - 1, *(x[ok][order] for x in (alo, ahi, blo, bhi, d))))
        return self.label


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _spanning(leaves: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(labels != np.arange(len(labels)))
    return leaves[at], leaves[labels[at]]


def _walk_partition(batches: Iterator[pa.RecordBatch], bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links that span the components of every subtree of a partition.

    Rows: turn (bits to rotate left so that the shared block leads), cell (-1, or the
    pair of cut subtrees), side (0 or 1 in the pair), fp. Holds 8-byte values of its
    partition; a cut keeps a subtree's share of them bounded.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    turn, cell, side = (table.column(c).to_numpy() for c in ("turn", "cell", "side"))
    fp = table.column("fp").to_numpy().view(np.uint64)
    us, vs = [], []
    for t in np.unique(turn):
        whole = np.sort(_turned(fp[(turn == t) & (cell < 0)], int(t)))
        if len(whole):
            block = whole >> np.uint64(64 - width)
            lo = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            hi = np.r_[lo[1:], len(whole)]
            many = hi - lo > 1
            trie = _Trie(whole, None, bits)
            trie.walk(63 - width, lo[many], hi[many], lo[many], hi[many])
            u, v = _spanning(whole, trie.label)
            us.append(_turned(u, (64 - int(t)) % 64))
            vs.append(_turned(v, (64 - int(t)) % 64))
    for c in np.unique(cell[cell >= 0]):
        at = cell == c
        a, b = np.sort(fp[at & (side == 0)]), np.sort(fp[at & (side == 1)])
        zero = np.zeros(1, np.int64)
        if len(b) and len(a):
            trie = _Trie(a, b, bits)
            trie.walk(63, zero, zero + len(a), zero, zero + len(b))
            u, v = _spanning(np.r_[a, b], trie.label)
        elif len(a) > 1 and not len(b):
            trie = _Trie(a, None, bits)
            trie.walk(63, zero, zero + len(a), zero, zero + len(a))
            u, v = _spanning(a, trie.label)
        else:
            continue
        us.append(u)
        vs.append(v)
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["a", "b"])


def near_links(fps: DataFrame, bits: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (column fp) within ``bits`` bits."""
    n_blocks = bits + 1
    width = 64 // n_blocks
    # The last block is as wide as the others; bits that are left over belong to no block.
    blocks = F.array(*[F.struct(F.lit(k * width).alias("turn"), F.shiftrightunsigned(
        F.shiftleft("fp", k * width), 64 - width).alias("value")) for k in range(n_blocks)])
    dealt = fps.select("fp", F.explode(blocks).alias("b")).select("fp", "b.turn", "b.value")
    # At most n_blocks * 2**width counts, whatever the input; only subtrees over the bound come to the driver.
    large = dealt.groupBy("turn", "value").count().filter(F.col("count") > subtree)
    ones = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))).alias(f"o{k}") for k in range(64)]
    hot = {}
    found = large.collect()
    if found:
        for r in dealt.join(F.broadcast(large), ["turn", "value"]).groupBy("turn", "value").agg(F.count("*").alias("n"), *ones).collect():
            cuts = min(MOST_CUTS, int(np.ceil(np.log2(r.n / subtree))) + 1)
            hot[(r.turn, r.value)] = sorted(range(64), key=lambda k: abs(2 * r[f"o{k}"] - r.n))[:cuts]
    plain = dealt.withColumns({"cell": F.lit(-1).cast("long"), "side": F.lit(0)})
    if hot:
        spark = fps.sparkSession
        cuts = spark.createDataFrame([(t, v, k, b) for k, ((t, v), b) in enumerate(hot.items())],
                                     "turn int, value long, id long, cuts array<int>")
        cut = dealt.join(F.broadcast(cuts), ["turn", "value"])
        own = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, k: a * 2 + F.getbit(F.col("fp"), k))
        cut = cut.withColumn("own", own).withColumn("other", F.explode(F.filter(
            F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.size("cuts")).cast("long") - 1),
            lambda o: F.bit_count(o.bitwiseXOR(F.col("own"))) <= bits)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        cut = cut.select("fp", "turn", "value", ((F.col("id") * (1 << MOST_CUTS) + low) * (1 << MOST_CUTS) + high).alias("cell"),
                         F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
        plain = plain.join(F.broadcast(cuts.select("turn", "value")), ["turn", "value"], "left_anti").select(*cut.columns).unionByName(cut)
    return (plain.repartition(tasks(fps.sparkSession), "turn", "value", "cell").select("turn", "cell", "side", "fp")
            .mapInArrow(lambda it: _walk_partition(it, bits, width), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id: str = "doc_id", text: str = "text",
                    subtree: int = SUBTREE) -> DataFrame:
    """(id, h1, h2, fingerprint, component_id, chosen) for every row of ``docs``.

    ``component_id`` is the smallest id within reach of links of at most ``bits`` bits.
    (h1, h2) is a 128-bit hash of the row; ``chosen`` is true for the one row content of a
    component that ``one_of_each`` keeps.
    """
    rows = keep_row(docs)
    marked = land(rows.select(F.col("row")[id].alias("id"), *row_hashes(docs),
                              fingerprint(text_of(F.col("row")[text]), shingle).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h1", "h2"))  # null ids last
    fps = land(marked.groupBy("fp").agg(first.alias("first")), "fps")
    roots = land(components(near_links(fps.select("fp"), bits, subtree)), "roots")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = land(rooted.drop("first").join(chosen, "root").select("fp", "first"), "components")
    return (marked.join(of_fp, "fp")
            .select("id", "h1", "h2", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("first.id").alias("component_id"),
                    ((F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))).alias("chosen")))


def one_of_each(docs: DataFrame, shingle: int = 3, bits: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one of the smallest id, with its columns as they are."""
    chosen = near_duplicates(docs, shingle, bits, id, text).filter("chosen").select("h1", "h2")
    kept = keep_row(docs).select("row", *row_hashes(docs)).join(chosen, ["h1", "h2"], "left_semi")
    return kept.dropDuplicates(["h1", "h2"]).select("row.*")  # rows equal in every column share both hashes
