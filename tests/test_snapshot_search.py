"""Commits and snapshots, the guard of the index, text search, cells that are skipped, completions asked for once."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from issuelens.functions.embedding import DigestEncoder, HashingEncoder
from issuelens.operators import cells as cl
from issuelens.operators import completions as cp
from issuelens.operators import evaluate as ev
from issuelens.operators import generate as gn
from issuelens.operators import neighbours as nb
from issuelens.operators import search
from issuelens.operators import snapshot as sn
from issuelens.sources import files
from issuelens.streaming import incremental as inc

ISSUE = "repo string, _id long, key string, fields struct<summary:string,description:string,issuetype:struct<name:string>>"


def issues(spark, rows):
    return spark.createDataFrame([(r, i, k, (t, None, ("Bug",))) for i, (r, k, t) in enumerate(rows)], ISSUE)


def numbered(spark, ids, word="text"):
    return issues(spark, [("A", f"T-{i}", f"{word} {i} {'abcdefgh'[i % 8]}") for i in ids])


class Failing(HashingEncoder):
    def encode(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("text")
        return super().encode(texts)


# ------------------------------------------------------------------ snapshots

def test_tables_of_a_commit_appear_together(spark, tmp_dir):
    root = os.path.join(tmp_dir, "s")
    assert sn.latest(spark, root) == sn.EMPTY
    with pytest.raises(ValueError, match="no committed rows"):
        sn.read(spark, root)
    one = sn.commit(spark, root, {sn.MAIN: spark.range(5), "side": spark.range(2)}, "a", {"read": 7})
    two = sn.commit(spark, root, {sn.MAIN: spark.range(5, 9), "side": spark.range(0)}, "b")
    assert (one.version, two.version) == (1, 2) and two.rows() == 9 and two.rows("side") == 2
    assert sn.done(two, "a") and not sn.done(one, "b") and two.batches["a"] == {"read": 7}
    assert sn.read(spark, root, snapshot=one).count() == 5 and sn.read(spark, root).count() == 9
    assert sn.read(spark, root, "side", two).count() == 2
    assert sn.latest(spark, root, 1) == one
    with pytest.raises(sn.Conflict):   # a second writer that also started from version 1
        sn.commit(spark, root, {sn.MAIN: spark.range(100)}, "c", base=one)
    assert sn.read(spark, root).count() == 9
    gone = sn.vacuum(spark, root)      # the folder of the writer that lost
    assert any(root in g for g in gone) and sn.verify(spark, root).version == 2
    packed = sn.compact(spark, root)
    assert len(packed.parts[sn.MAIN]) == 1 and packed.batches == two.batches
    assert sorted(r.id for r in sn.read(spark, root).collect()) == list(range(9))


def test_torn_and_short_tables_are_refused(spark, tmp_dir):
    root = os.path.join(tmp_dir, "s")
    sn.commit(spark, root, {sn.MAIN: spark.range(40).repartition(3)}, "a")
    assert sn.verify(spark, root).rows() == 40
    part = glob.glob(f"{root}/commit=*/part-*.parquet")[0]
    held = open(part, "rb").read()
    os.remove(part)
    with pytest.raises(sn.Torn):
        sn.verify(spark, root)
    with open(part, "wb") as f:
        f.write(held[:-7])
    with pytest.raises(sn.Torn):
        sn.verify(spark, root)


def test_a_file_is_published_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m", "1.json")
    os.makedirs(os.path.dirname(path))
    assert files.publish(spark, "one", path) and not files.publish(spark, "two", path)
    assert files.read_text(spark, path) == "one" and files.names(spark, os.path.dirname(path)) == ["1.json"]
    mark = files.fingerprint(spark, tmp_dir)
    assert files.fingerprint(spark, tmp_dir) == mark
    assert files.publish(spark, "two", os.path.join(tmp_dir, "m", "2.json")) and files.fingerprint(spark, tmp_dir) != mark


# ----------------------------------------------------------------- the ledger

def test_every_row_of_a_batch_is_in_one_count(spark, tmp_dir):
    root = os.path.join(tmp_dir, "i")
    search.add(spark, root, numbered(spark, range(10)), Failing(8), "one")
    rows = [("A", f"T-{i}", "bad" if i in (12, 13) else f"text {i}") for i in range(5, 16)] + [("A", "T-15", "again"), ("B", "T-1", "x")]
    search.add(spark, root, issues(spark, rows), Failing(8), "two")
    got = {r.batch: tuple(r)[1:] for r in search.ledger(spark, root).collect()}
    assert got == {"one": (10, 0, 0, 10, 0), "two": (13, 1, 5, 5, 2)}
    assert sorted(r.issue_key for r in search.rejected(spark, root).collect()) == ["T-12", "T-13"]
    search.retry_rejected(spark, root, HashingEncoder(8))
    held, index, cells = search.open_index(spark, root)
    assert held.rows() == index.count() == 17 == int(cells.rows.sum()) and search.rejected(spark, root).count() == 0


def test_a_replayed_batch_is_not_read(spark, tmp_dir):
    root = os.path.join(tmp_dir, "i")
    first = search.add(spark, root, numbered(spark, range(4)), HashingEncoder(8), "s:0")
    unread = numbered(spark, range(9)).where(F.raise_error(F.lit("was read")).isNull())
    assert search.add(spark, root, unread, HashingEncoder(8), "s:0") == first


def test_a_crash_between_the_writes_leaves_nothing(spark, tmp_dir, monkeypatch):
    root = os.path.join(tmp_dir, "i")
    search.add(spark, root, numbered(spark, range(4)), HashingEncoder(8), "s:0")
    real, calls = sn.write_part, []

    def dies(df, *a):
        calls.append(a)
        if len(calls) == 2:   # index rows are written, the others are not
            raise RuntimeError("lost")
        return real(df, *a)

    monkeypatch.setattr(sn, "write_part", dies)
    with pytest.raises(RuntimeError):
        search.add(spark, root, numbered(spark, range(2, 9)), HashingEncoder(8), "s:1")
    monkeypatch.setattr(sn, "write_part", real)
    assert search.open_index(spark, root)[1].count() == 4
    search.add(spark, root, numbered(spark, range(2, 9)), HashingEncoder(8), "s:1")
    index = search.open_index(spark, root)[1]
    assert index.count() == index.select("issue_key").distinct().count() == 9
    assert sn.latest(spark, root).batches["s:1"]["known"] == 2


def test_a_batch_opens_only_the_buckets_of_its_keys(spark, tmp_dir):
    root = os.path.join(tmp_dir, "i")
    opened = []
    for n in range(12):
        search.add(spark, root, numbered(spark, range(40 * n, 40 * n + 40)), HashingEncoder(8), f"b{n}")
        held = sn.latest(spark, root)
        one = spark.createDataFrame([("A", "T-7")], "repo string, issue_key string")
        found, parts = search.known_keys(spark, root, held, one)
        assert found.where("issue_key = 'T-7'").count() == 1
        opened.append(len(parts))
    assert held.rows(search.KEYS) == held.rows() == 480
    per_bucket = [sum(search._bucket(p) == str(b) for p in held.parts[search.KEYS]) for b in range(search.KEY_BUCKETS)]
    assert max(per_bucket) <= 6 and max(opened) <= 6   # about log n parts a bucket, not one for each batch
    again = search.add(spark, root, numbered(spark, range(480)), HashingEncoder(8), "again")
    assert again.rows() == 480 and again.batches["again"]["known"] == 480


def test_stream_batches_are_named_by_their_checkpoint(spark, tmp_dir):
    src, root, ck = (os.path.join(tmp_dir, x) for x in ("src", "i", "ck"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, f"t {i}", "en", "s", 3) for i in range(6)], schema).repartition(2).write.parquet(src)
    for _ in range(2):
        inc.index_incrementally(spark, src, schema, root, ck, encoder=HashingEncoder(8), max_files_per_trigger=1,
                                prepare=inc.documents_as_issues).awaitTermination()
    mark = inc.checkpoint_id(spark, ck)
    got = {r.batch: (r["read"], r.indexed) for r in search.ledger(spark, root).collect()}
    assert set(got) == {f"{mark}:0", f"{mark}:1"} and sum(n for n, _ in got.values()) == sum(n for _, n in got.values()) == 6


# ------------------------------------------------------------- index and guard

def test_text_search_over_the_stored_index(spark, tmp_dir):
    root, encoder = os.path.join(tmp_dir, "i"), DigestEncoder(16)
    with pytest.raises(ValueError, match="holds no index"):
        search.open_index(spark, root)
    words = "red green blue cyan pink gray gold teal".split()
    rows = [("A", f"T-{i}", " ".join(words[(i * k) % 8] for k in range(1, 5)) + f" {i % 5}") for i in range(300)]
    search.add(spark, root, issues(spark, rows[:200]), encoder, "a")
    search.add(spark, root, issues(spark, rows), encoder, "b")
    queries = spark.createDataFrame([("q1", "red green"), ("q2", "teal 3"), ("q3", None)], "query_id string, query string")
    got = [tuple(r)[:4] for r in search.search(spark, root, queries, 4, encoder).orderBy("query_id", "rank").collect()]
    from issuelens.constants import TASK_DESCRIPTION
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    index = unit(encoder.encode([t + " " for _, _, t in rows])).astype(np.float32).astype(float)
    want = []
    for q, t in (("q1", "red green"), ("q2", "teal 3"), ("q3", "")):
        v = unit(encoder.encode([f"Instruct: {TASK_DESCRIPTION}\nQuery: {t}"])).astype(np.float32).astype(float)[0]
        best = sorted((-s, k) for s, (_, k, _) in zip((index * v).sum(axis=1), rows))[:4]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    one = search.search_one(spark, root, "red green", 4, encoder).collect()
    assert [r.issue_key for r in one] == [w[2] for w in want[:4]]
    part = sorted(glob.glob(f"{root}/commit=*/part-*.parquet"))[0]
    os.remove(part)
    with pytest.raises(sn.Torn):
        search.search_one(spark, root, "red", 4, encoder)


def test_digest_vectors(spark):
    from hashlib import md5
    texts = ["Red red\tgreen", "", " \n ", "É é"]
    got = DigestEncoder(8).encode(texts)
    for t, v in zip(texts, got):
        want = np.zeros(8)
        for w in t.lower().encode().split():
            h = int(md5(w).hexdigest()[:8], 16)
            want[h % 8] += 1 if h < 1 << 31 else -1
        assert (v == want).all()


# ------------------------------------------------------------------------ cells

def vectors(kind, n, rng):
    if kind == "clusters":
        centre = rng.normal(size=(25, 6)) * 5
        return centre[rng.integers(0, 25, n)] + rng.normal(size=(n, 6)) * .1
    if kind == "ties":
        return rng.integers(-1, 2, (n, 3)).astype(float)
    if kind == "one":   # a third of the rows are the same vector
        v = rng.normal(size=(n, 5))
        v[: n // 3] = v[0]
        return v
    return rng.normal(size=(n, 12))


@pytest.mark.parametrize("kind", ["clusters", "ties", "one", "random"])
def test_cells_give_the_same_rows_as_a_full_search(spark, kind):
    rng = np.random.default_rng(5)
    n = 1600
    V = vectors(kind, n, rng).astype(np.float32)
    odd = [("none", None, "x", "T"), ("nan", [float("nan")] * V.shape[1], "x", "T")]
    rows = spark.createDataFrame([(f"k{i:05d}", [float(x) for x in v], f"t{i}", "T") for i, v in enumerate(V)] + odd,
                                 "key string, embedding array<float>, text string, issuetype string").repartition(4)
    q = spark.createDataFrame([(f"k{i:05d}", [float(x) for x in V[i]]) for i in range(0, n, 80)] + [("zz", None)],
                              "query_id string, embedding array<float>")
    want = sorted(map(tuple, nb.similar(q, rows, k=4, exclude_self=True, plan="broadcast").collect()))
    assert want == sorted(map(tuple, nb.similar(q, rows, k=4, exclude_self=True, plan="blocked", block_rows=300).collect()))
    index, cells = cl.cell_index(rows)
    small, seen = cl.search(q, index, cells, 4, True)
    large, seen_large = cl.search(q, index, cells, 4, True, max_broadcast_queries=3, block_rows=100)
    assert sorted(map(tuple, small.collect())) == want == sorted(map(tuple, large.collect()))
    assert seen == seen_large and seen.first + seen.second <= seen.all
    if kind == "clusters":
        assert seen.first + seen.second < 0.25 * seen.all


def test_cells_of_no_rows_and_of_few(spark):
    rows = lambda r: spark.createDataFrame(r, "key string, embedding array<float>, text string, issuetype string")
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, embedding array<float>")
    index, cells = cl.cell_index(rows([]))
    assert cl.search(q, index, cells, 3)[0].count() == 0 and cl.search(q, index, cells, 3, max_broadcast_queries=0)[0].count() == 0
    index, cells = cl.cell_index(rows([("x", [0.5, 0.0], "t", "T"), ("y", [0.0, 0.0], "t", "T")]))
    assert [(r.key, r.rank) for r in cl.search(q, index, cells, 3)[0].orderBy("rank").collect()] == [("x", 1), ("y", 2)]
    assert cl.search(q.limit(0), index, cells, 3)[0].count() == 0


@pytest.mark.parametrize("most", [100, 0])
def test_repeated_query_ids_are_excluded_from_themselves(spark, most):
    rows = spark.createDataFrame([(k, [float(x), 1.0], "t", "T") for k, x in (("a", 1), ("a", 2), ("b", 3), ("c", 4))],
                                 "key string, embedding array<float>, text string, issuetype string")
    index, cells = cl.cell_index(rows)
    found, _ = cl.search(rows.select(F.col("key").alias("query_id"), "embedding"), index, cells, 1, True, ("issuetype",), most)
    assert sorted((r.query_id, r.key, r.similarity) for r in found.collect()) == [("a", "c", 9.0), ("b", "c", 13.0), ("c", "b", 13.0)]


def test_small_cells_share_a_bin():
    cells = cl.Cells(np.zeros((5, 2)), np.zeros(5), np.array([40, 60, 1, 250, 3]))
    assert cl.bins(cells, 100).tolist() == [0, 0, 1, 2, 3]


def test_every_vector_is_a_query_of_join_01(spark, tmp_dir):
    rng = np.random.default_rng(6)
    ids = [*range(1, 45), 7, None]   # one id comes again, one is null
    V = {i: [float(x) for x in rng.normal(size=4).astype(np.float32)] for i in ids}
    spark.createDataFrame([(i, V[i], 1) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_dir}/embeddings.parquet")
    spark.createDataFrame([(1, "a\nb", "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = {}
    for r in se.queries()["join_01"](spark, tmp_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.key))
    for i in range(1, 45):
        near = sorted((-float(np.dot(V[i], V[j])), str(j)) for j in ids for _ in range(2 if i == 7 else 1) if j is not None and j != i)
        assert sorted(got.pop(str(i))) == [(n + 1, key) for n, (_, key) in enumerate(near[:3])]
    assert not got


def test_ranges_of_cells():
    assert cl.cell_ranges([5, 1, 2, 3, 9, 8]) == [(1, 3), (5, 5), (8, 9)] and cl.cell_ranges([]) == []


# ------------------------------------------------------------------ completions

class Counting(gn.NearestLabelGenerator):
    """Counts its calls in a file, a line for each prompt."""

    def __init__(self, path, fails=()):
        self.path, self.fails = path, fails

    def generate(self, prompt, max_new_tokens=512, system_prompt=None):
        with open(self.path, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        if any(x in prompt for x in self.fails):
            raise RuntimeError("down")
        return f"Issuetype: {prompt[-1]}"


def calls(path):
    return sorted(open(path).read().splitlines()) if os.path.exists(path) else []


def test_each_prompt_is_asked_once_over_two_runs(spark, tmp_dir):
    root, log = os.path.join(tmp_dir, "c"), os.path.join(tmp_dir, "calls")
    prompts = spark.createDataFrame([(f"q{i}", f"prompt {i % 6}") for i in range(18)] + [("n", None)], "query_id string, prompt string").repartition(3)
    first = cp.complete(prompts, root, Counting(log, fails=["prompt 5"]))
    got = {r.query_id: (r.llm_output, r.error) for r in first.collect()}
    assert calls(log) == [f"prompt {i}" for i in range(6)]   # distinct prompts, the null one never reaches the model
    assert got["q4"] == ("Issuetype: 4", None) and got["q5"][0] is None and "down" in got["q5"][1] and got["n"][0] is None
    again = {r.query_id: (r.llm_output, r.error) for r in cp.complete(prompts, root, Counting(log)).collect()}
    assert calls(log) == sorted([f"prompt {i}" for i in range(6)] + ["prompt 5"])   # only what had failed
    assert again["q5"] == ("Issuetype: 5", None) and again["q4"] == got["q4"] and len(again) == 19
    cp.complete(prompts.where("query_id = 'q1'"), root, Counting(log), model="other").collect()
    assert len(calls(log)) == 8                              # another model is asked anew
    cp.complete(prompts.where("query_id = 'q1'"), root, Counting(log), system_prompt="s").collect()
    assert len(calls(log)) == 9
    assert cp.complete(prompts.limit(0), root, Counting(log)).count() == 0


def test_one_evaluation_gives_all_results_and_files(spark, tmp_dir):
    index, store, out, log = (os.path.join(tmp_dir, x) for x in ("i", "c", "out", "calls"))
    encoder = DigestEncoder(16)
    search.add(spark, index, numbered(spark, range(80)), encoder, "all")
    items = spark.createDataFrame([(f"T-{i}", f"text {i} {'abcdefgh'[i % 8]}", None, "Bug") for i in range(9)],
                                  "query_id string, summary string, description string, expected string")

    class Nearest(gn.NearestLabelGenerator):
        def __init__(self, path):
            self.path = path

        def generate(self, prompt, max_new_tokens=512, system_prompt=None):
            with open(self.path, "a") as f:
                f.write("x\n")
            return super().generate(prompt, max_new_tokens, system_prompt)

    for _ in range(2):
        e = ev.run(spark, items, index, store, Nearest(log), encoder)
        assert len(calls(log)) == 9
        assert ev.accuracy(e.results).first().accuracy == 1.0 and ev.confusion_wide(e.results).columns == ["expected", "Bug"]
        assert ev.by_class(e.results).first()["count"] == 9 and [r.label for r in ev.labels(e.results).collect()] == ["Bug"]
        assert ev.ordered_report(e.results).first().position == 1
    assert not any(f"(Key: {r.query_id}," in r.prompt for r in e.prompts.collect())   # no item is its own neighbour
    assert len(calls(log)) == 9
    assert ev.write_files(e, out) == ["results.jsonl", "results.csv", "prompts.jsonl"] and len(calls(log)) == 9
    assert spark.read.json(f"{out}/results.jsonl").count() == 9
    empty = ev.run(spark, items.limit(0), index, store, Nearest(log), encoder)
    assert ev.write_files(empty, f"{out}2") == [] and ev.accuracy(empty.results).first().accuracy == 0.0
