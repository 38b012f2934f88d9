import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from issuelens.llm import simhash as S
from issuelens.llm.components import components


def plain_simhash(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, bits=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for k in range(i):
            if (values[i] ^ values[k]).bit_count() <= bits:
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint_equals_the_plain_one(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É ÉÉ ß A", "x " * 50,
             " ".join(rng.choice(["the", "Of", "kö", "x\ty", "z w"]) for _ in range(999))]
    want = [plain_simhash(t) for t in texts]
    assert [S.simhash(t) for t in texts] == want
    monkeypatch.setattr(S, "PIECE", 7)  # texts in many pieces
    assert [S.simhash(t) for t in texts] == want


def near_values(rng, n, centres, flips):
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("subtree", [S.SUBTREE, 8])
def test_links_give_the_components_of_all_pairs(spark, subtree):
    rng = random.Random(5)
    values = near_values(rng, 400, [rng.getrandbits(64) for _ in range(40)] + [0, 2 ** 64 - 1], 9)
    signed = [x - 2 ** 64 if x >= 2 ** 63 else x for x in values]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(r.a, r.b) for r in S.near_links(fps, 3, subtree).collect()]
    assert all(((a ^ b) & (2 ** 64 - 1)) for a, b in links)
    got = components(spark.createDataFrame(links, "a long, b long"))
    rows = {r.node: r.root for r in got.collect()}
    want = plain_components(values)
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(rows.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_dense_ball_is_walked_without_all_pairs():
    rng = random.Random(9)
    values = np.array(near_values(rng, 20000, [rng.getrandbits(64)], 7), np.uint64)
    trie = S._Trie(values, None, 3)
    zero = np.zeros(1, np.int64)
    labels = trie.walk(63, zero, zero + len(values), zero, zero + len(values))
    assert (labels == labels[0]).mean() > 0.9


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (200, 201)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(rows[i] == 0 for i in range(51)) and all(rows[k] == 100 for k in range(100, 160)) and rows[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_with_nulls_ties_and_clashing_names(spark):
    words = [f"w{i}" for i in range(300)]
    base = " ".join(words)
    edit = " ".join(words[:-1] + ["other"])
    rows = [(3, base, "a", 1), (1, base, "b", 1), (9, edit, None, 2), (None, base, "c", 1), (4, None, "d", 0), (5, "", "e", 0),
            (6, " ".join(f"v{i}" for i in range(300)), "f", 1), (6, " ".join(f"v{i}" for i in range(300)), "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, h1 int")
    got = S.near_duplicates(docs)
    by = {}
    for r in got.collect():
        by.setdefault(r.id, []).append(r)
    fps = [plain_simhash(t) for _, t, _, _ in rows]
    comp = plain_components(fps)
    for (i, *_), f, c in zip(rows, fps, comp):
        want = min(x for x, g in zip((r[0] for r in rows), comp) if g == c and x is not None)
        assert all(r.fingerprint == f"{f:016x}" and r.component_id == want for r in by[i])
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.one_of_each(docs).count() == 0


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert {r.component_id for r in S.near_duplicates(docs).collect()} == {None}
    assert S.one_of_each(docs).count() == 1 and S.one_of_each(docs).filter(F.col("text").isNull()).count() == 0
