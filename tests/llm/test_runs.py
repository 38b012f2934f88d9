import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import queries, runs


def plain_runs(w, least=6, exponent=4):
    """(start, length, period) of every run, by trying every period at every place."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(w[t] == w[t + p] for t in range(i, i + length - p)) for p in range(1, q))
            if j > i and length >= max(least, exponent * q) and not smaller:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n):
    words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a = rng.randrange(n) if n else 0
        p = 1 + (n - a) // rng.randrange(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_many_texts_at_once(seed):
    rng = random.Random(seed)
    texts = [periodic(rng, rng.randrange(0, 70)) for _ in range(rng.randrange(1, 8))]
    least, exponent = rng.choice([(6, 4), (6, 4), (2, 2), (4, 3), (12, 4), (1, 5)])
    words = np.array([k * 10 + x for k, t in enumerate(texts) for x in t], np.int64)
    end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    want, at = [], 0
    for t in texts:
        want += [(at + i, length, q) for i, length, q in plain_runs(t, least, exponent)]
        at += len(t)
    assert runs.runs_of(words, end, least, exponent) == want


def test_suffix_array_lcp_and_intervals():
    rng = random.Random(3)
    for _ in range(40):
        w = [rng.randrange(3) for _ in range(rng.randrange(2, 50))]
        rounds = runs.doubling_ranks(np.array(w), np.full(len(w), len(w)))
        sa = sorted(range(len(w)), key=lambda i: w[i:])
        assert [int(rounds[-1][1][i]) for i in sa] == list(range(len(w)))
        shared = lambda a, b: next((k for k in range(len(w)) if a + k >= len(w) or b + k >= len(w) or w[a + k] != w[b + k]), len(w))
        lcp = [0] + [shared(a, b) for a, b in zip(sa, sa[1:])]
        assert runs.neighbour_lcp(np.array(w), np.array(sa), rounds).tolist() == lcp
        first, last = runs.intervals(np.array(lcp))
        for k in range(1, len(w)):
            lo = max(j for j in range(k) if lcp[j] < lcp[k] or j == 0) if lcp[k] else None
            if lo is not None:
                assert first[k] == lo
                assert last[k] == min([j for j in range(k + 1, len(w)) if lcp[j] < lcp[k]], default=len(w)) - 1


def test_long_texts_of_one_word_and_of_one_period():
    n = 300_000
    assert runs.runs_of(np.zeros(n, np.int64), np.full(n, n)) == [(0, n, 1)]
    assert runs.runs_of(np.arange(n) % 999, np.full(n, n)) == [(0, n, 999)]
    distinct = np.arange(n) + (1 << 21)  # word numbers too large for three to a key
    assert runs.runs_of(distinct, np.full(n, n)) == []


def rows():
    rng = random.Random(5)
    out = [(1, None), (2, ""), (3, " \n\t "), (None, "a " * 9), (4, "ein ein\x0bein\x0cein\rein\tein"), (5, "x x " * 8), (5, "x x " * 8),
           (6, "a b a b a b a b c c c c c c"), (7, "\U0001f600   " * 7), (8, "word " * 70_000), (9, "p q r s " * 20_000 + "end")]
    return out + [(k, " ".join(f"w{x}" for x in periodic(rng, rng.randrange(0, 90)))) for k in range(10, 120)]


def test_query_against_a_plain_version(spark, tmp_dir):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows()], "doc_id long, text string, row string, runs int, collapsed string").repartition(5)
    frame.write.parquet(f"{tmp_dir}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, tmp_dir).collect()), key=str)
    want = []
    for doc_id, text in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = [(0, len(w), len(set(w)))] if len(w) > 1000 and len(set(w)) == 1 else [(0, 80_000, 4)] if len(w) > 1000 else plain_runs(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     digest("".join(f"{s},{length},{q}\n" for s, length, q in found)),
                     digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert got == sorted(want, key=str)


def test_collapse_keeps_texts_without_runs(spark):
    frame = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id long, text string, row string")
    done = {(r.doc_id, r.text) for r in runs.collapse(frame).collect()}
    assert {(1, None), (2, ""), (3, " \n\t "), (8, "word"), (6, "a b c"), (None, "a")} <= done
    assert runs.collapse(frame).columns == frame.columns and runs.collapse(frame.limit(0)).count() == 0
    best = frame.limit(1).select(runs.strongest(F.expr("array(named_struct('start',3L,'length',8L,'period',2L),named_struct('start',5L,'length',12L,'period',3L),"
                                                       "named_struct('start',4L,'length',9L,'period',2L))")).alias("b")).first().b
    assert tuple(best) == (4, 9, 2)
