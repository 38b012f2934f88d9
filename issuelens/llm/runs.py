"""Periodic runs of words inside texts, by the branching tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) that no neighbouring word extends keeping that period, at least
``max(least_words, exponent * q)`` words long. For every batch of texts:

1. suffix array by prefix doubling: suffixes are ranked by their first 3, 6, 12 ... words,
   and only those still sharing a rank are sorted again. Words of two texts never count
   as equal, so no repeat crosses a text;
2. LCP of neighbouring suffixes, read off the ranks of the doubling rounds;
3. LCP intervals (all suffixes that share ``depth`` words, none more) as borders between
   the previous and the next smaller value, found by range minima; no tree node is made;
4. for every suffix i outside the largest child of an interval, ISA[i + depth] and
   ISA[i - depth] are looked up: if they lie in the interval, the words at both places are
   the same ``depth`` words, a square, which is branching if the word after it differs
   from the word ``depth`` before. Skipping the largest child keeps this to n log n looks;
5. a branching square ends where its run ends. It is rotated left as long as the words
   agree; squares whose run is that of a shorter period are merged into it.

Only squares that can belong to a run long enough are followed: the places one and two
periods further left must lie in the interval too (exponent 4), and a stretch of suffixes
whose longest repeat is under the least a run repeats (5 words here) is left out. Neither
drops a run.

Each text is worked on by the task that reads it, without any shuffle; memory grows with
the longest text (about 4 bytes a word and doubling round), or with ``SLICE`` words.

Defined results: a null text is empty, an empty one has no words and no runs; equal rows
give equal rows each; empty tables give empty results; all input columns stay in ``row``
and can clash with nothing; ``planted`` leaves a row with a null key as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, let, text_of, words_of

LEAST_WORDS, EXPONENT = 6, 4
BASE = 3  # words ranked together in the first round
SLICE = 1 << 17  # words of the texts worked on at once


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of the keys, equal keys sharing the first place of their group."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(len(key), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return rank


def doubling_ranks(words: np.ndarray, end: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(h, rank by the first h words) of every round, until all suffixes differ.

    ``words`` are word numbers, ``end`` the end of the text that each place is in.
    """
    n = len(words)
    at = np.arange(n)
    key = words.astype(np.int64)
    for k in range(1, BASE):
        # Numbers below 2 ** 20 fit three to a key; else each round is made dense first.
        if len(words) and int(words.max()) >= 1 << 20 and k > 1:
            key = _dense(key)
        later = np.where(at + k < end, words[np.minimum(at + k, n - 1)] + 1, 0)
        key = key * (int(words.max()) + 2 if n else 1) + later
    rank, h = _dense(key), BASE
    rounds = [(h, rank.astype(np.int32))]
    place = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(place[rank] > 1)
    while len(open_):
        old = rank[open_]
        later = np.where(open_ + h < end[open_], rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        key = old * (n + 2) + later
        order = np.argsort(key, kind="stable")
        open_, key, old = open_[order], key[order], old[order]
        index = np.arange(len(open_))
        starts = np.ones(len(open_), bool)
        starts[1:] = key[1:] != key[:-1]
        groups = np.ones(len(open_), bool)
        groups[1:] = old[1:] != old[:-1]
        in_group = np.maximum.accumulate(np.where(starts, index, 0)) - np.maximum.accumulate(np.where(groups, index, 0))
        rank = rank.copy()
        rank[open_] = old + in_group
        h *= 2
        rounds.append((h, rank.astype(np.int32)))
        alone = starts.copy()
        alone[:-1] &= starts[1:]
        open_ = open_[~alone]
    return rounds


def neighbour_lcp(words: np.ndarray, sa: np.ndarray, rounds: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """lcp[k]: words that suffixes sa[k - 1] and sa[k] share from their start (0 at k = 0)."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    left, right = sa[:-1].copy(), sa[1:].copy()
    held = np.arange(1, n)
    deepest = np.zeros(n, np.int8)
    for level, (_, rank) in enumerate(rounds):
        same = rank[sa[held - 1]] == rank[sa[held]]
        held = held[same]
        if not len(held):
            break
        deepest[held] = level + 1
    held = np.flatnonzero(deepest)
    for level in range(len(rounds) - 1, -1, -1):
        h, rank = rounds[level]
        k = held[deepest[held] > level]
        a, b = left[k - 1], right[k - 1]
        inside = (a < n) & (b < n)  # past its text's end a place is in another text, and differs
        k = k[inside][rank[a[inside]] == rank[b[inside]]]
        lcp[k] += h
        left[k - 1] += h
        right[k - 1] += h
    k = np.arange(1, n)
    for _ in range(BASE - 1):
        a, b = left[k - 1], right[k - 1]
        inside = (a < n) & (b < n)
        k = k[inside][words[a[inside]] == words[b[inside]]]
        lcp[k] += 1
        left[k - 1] += 1
        right[k - 1] += 1
    return lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every k: borders (first, last slot) of the interval of depth lcp[k] that holds slots k - 1 and k.

    The last value below lcp[k] before k, and the first after it, found by descending
    through minima over stretches of 1, 2, 4 ... values.
    """
    n = len(lcp)
    minima = [lcp]
    while 1 << len(minima) <= n:
        below, half = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(below[:-half], below[half:]))
    first, last = np.arange(n), np.arange(n) + 1
    for level in range(len(minima) - 1, -1, -1):
        table, step = minima[level], 1 << level
        # Move over the stretch before (behind) if none of its values is smaller.
        start = first - step
        go = (start >= 0) & (table[np.clip(start, 0, len(table) - 1)] >= lcp)
        first = np.where(go, start, first)
        go = (last + step <= n) & (table[np.clip(last, 0, len(table) - 1)] >= lcp)
        last = np.where(go, last + step, last)
    return first - 1, last - 1


def branching_squares(words: np.ndarray, end: np.ndarray, least_words: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the last square of every stretch long enough to be a run (periods need not be smallest)."""
    n, none = len(words), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < least_words:
        return none
    rounds = doubling_ranks(words, end)
    isa = rounds[-1][1].astype(np.int64)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = neighbour_lcp(words, sa, rounds)
    del rounds
    # A run of period q holds its last q words m times or more, so two suffixes share (m - 1) q words.
    repeat = min((max(exponent, least_words // q) - 1) * q for q in range(1, least_words + 1))
    cuts = np.flatnonzero(lcp == 0)
    rich = np.maximum.reduceat(lcp, cuts) >= repeat
    keep = np.repeat(rich, np.diff(np.append(cuts, n)))
    slots = np.flatnonzero(keep)
    if not len(slots):
        return none
    depth = lcp[slots]  # stretches begin with 0, so no interval reaches into the next
    first, last = intervals(depth)
    inner = np.flatnonzero((depth > 0) & (last - first + 1 >= exponent))
    if not len(inner):
        return none
    # Entries of the same interval beside each other, in order of slots: the borders of its children.
    order = inner[np.lexsort((inner, last[inner], first[inner]))]
    f, l_, d = first[order], last[order], depth[order]
    new = np.ones(len(order), bool)
    new[1:] = (f[1:] != f[:-1]) | (l_[1:] != l_[:-1])
    number = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    f, l_, d = f[begins], l_[begins], d[begins]
    owner = np.concatenate([np.arange(len(begins)), number])
    child = np.concatenate([f, order])
    by = np.lexsort((child, owner))
    owner, child = owner[by], child[by]
    until = np.append(child[1:], 0)
    final = np.append(owner[1:] != owner[:-1], True)
    until[final] = l_[owner[final]] + 1
    size = until - child
    largest = np.maximum.reduceat(size, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
    # One largest child of each interval is left out.
    big = np.flatnonzero(size == largest[owner])
    drop = big[np.append(True, owner[big][1:] != owner[big][:-1])]
    small = np.ones(len(child), bool)
    small[drop] = False
    owner, child, size = owner[small], child[small], size[small]
    total = int(size.sum())
    member = np.repeat(child - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(total)
    owner = np.repeat(owner, size)
    i = sa[slots[member]]
    q = d[owner]
    low, high = slots[f][owner], slots[l_][owner]

    def inside(place: np.ndarray, of: np.ndarray) -> np.ndarray:
        ok = (place >= 0) & (place < n)
        at = isa[np.clip(place, 0, n - 1)]
        return ok & (at >= low[of]) & (at <= high[of])

    squares = []
    for start, other in ((i, i + q), (i - q, i - q)):
        k = np.flatnonzero(inside(other, np.arange(total)))
        for back in range(1, exponent - 1):
            k = k[inside(start[k] - back * q[k], k)]
        s, p = start[k], q[k]
        stop = s + 2 * p
        branch = (stop >= end[s]) | (words[np.minimum(stop, n - 1)] != words[s + p])
        squares.append(np.stack([s[branch], p[branch]]))
    s, p = np.unique(np.concatenate(squares, axis=1), axis=1)
    return s, p


def _agreeing(words: np.ndarray, start: int, period: int, least: int) -> int:
    """First place of the stretch that ends with the square at ``start`` and keeps ``period``; not before ``least``."""
    at, step = start, 64
    while at > least:
        low = max(least, at - step)
        differ = np.flatnonzero(words[low:at] != words[low + period:at + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, step = low, step * 4
    return at


def runs_of(words: np.ndarray, end: np.ndarray, least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start, then period.

    ``words`` numbers the words of many texts one after the other (a number belongs to one
    text only), ``end`` is the end of each place's text.
    """
    s, p = branching_squares(words, end, least_words, exponent)
    first_of = np.searchsorted(end, end[s], side="left") if len(s) else s  # places of a text share its end
    out: list[tuple[int, int, int]] = []
    stop, known = -1, []
    for k in np.lexsort((p, s + 2 * p)):
        start, period = int(s[k]), int(p[k])
        if start + 2 * period != stop:
            stop, known = start + 2 * period, []
        # A shorter period over the same last exponent x period words makes this one a multiple of it.
        if any(begin <= stop - exponent * period for begin in known):
            continue
        begin = _agreeing(words, start, period, int(first_of[k]))
        if stop - begin >= max(least_words, exponent * period):
            known.append(begin)
            out.append((begin, stop - begin, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, their numbers (of one text only), the text's end at every place, the texts' starts."""
    split = [t.split() for t in texts]  # on bytes: the six ASCII blanks
    sizes = np.array([len(w) for w in split], np.int64)
    numbers: list[int] = []
    count = 0
    for w in split:
        seen = {x: count + k for k, x in enumerate(dict.fromkeys(w))}
        count += len(seen)
        numbers += map(seen.__getitem__, w)
    stops = np.cumsum(sizes)
    return split, np.array(numbers, np.int64), np.repeat(stops, sizes), stops - sizes


def _found(texts: list[str], least_words: int, exponent: int) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each text."""
    split, words, end, starts = _numbered([t.encode() for t in texts])
    dropped = np.zeros(len(words), bool)
    runs: list[list[dict]] = [[] for _ in texts]
    found = runs_of(words, end, least_words, exponent)
    texts_of = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
    for (start, length, period), t in zip(found, texts_of.tolist()):
        runs[t].append({"start": start - int(starts[t]), "length": length, "period": period})
        dropped[start + period:start + length] = True
    collapsed = []
    for w, at, has in zip(split, starts.tolist(), runs):
        if has:
            w = [x for x, gone in zip(w, dropped[at:at + len(w)].tolist()) if not gone]
        collapsed.append(b" ".join(w).decode())
    return runs, collapsed


def _slices(texts: pd.Series) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) // 6
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_runs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``row`` (all input columns), ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the words that stand in a run after its first
    ``period`` words, joined by single spaces.
    """

    @F.pandas_udf("runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    def found(texts: pd.Series) -> pd.DataFrame:
        runs, collapsed = [], []
        for some in _slices(texts):
            r, c = _found(some, least_words, exponent)
            runs += r
            collapsed += c
        return pd.DataFrame({"runs": runs, "collapsed": collapsed})

    return (keep_row(docs).withColumn("f", found(text_of(F.col("row")[text])))
            .select("row", F.col("f.runs").alias("runs"), F.col("f.collapsed").alias("collapsed")))


def collapse(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """The documents with the repetitions of their runs taken out; texts without a run stay as they are (null ones too)."""
    found = find_runs(docs, text, least_words, exponent)
    clean = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row")[text])
    return found.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, exactly; ties: smallest start, then period. Null if there is none."""
    # By cross products, since two quotients that differ may be the same double.
    better = lambda a, b: a["length"].cast("decimal(19,0)") * b["period"] > b["length"].cast("decimal(19,0)") * a["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.element_at(runs, 1), lambda best, r: F.when(better(r, best), r).otherwise(best)))


def listed(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))


def planted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with periodic stretches written into about a tenth of them (chosen by CRC-32 of the key).

    With h = crc32(decimal key), g = h div 10: if h % 10 = 0 and the text has n > 0 words, word
    i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Other
    texts, and those with a null key, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    changed = let(words_of(text_of(text)), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(F.col(text)))
    return docs.withColumn(text, F.when(h % 10 == 0, changed).otherwise(F.col(text)))
