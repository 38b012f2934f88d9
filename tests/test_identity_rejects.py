"""Issues of two trackers under one key, texts the encoder fails on, ties, slices, the shared folder."""

import os
from types import SimpleNamespace

import numpy as np
import pytest
from issuelens import session
from issuelens.functions.embedding import HashingEncoder
from issuelens.operators import comments as cm
from issuelens.operators import index as ix
from issuelens.operators import neighbours as nb
from issuelens.sources import testset as ts
from issuelens.streaming import incremental as inc

ISSUE = "repo string, _id long, key string, fields struct<summary:string,description:string,issuetype:struct<name:string>>"


def _issues(spark, rows):
    return spark.createDataFrame([(r, i, k, (t, None, ("Bug",))) for i, (r, k, t) in enumerate(rows)], ISSUE)


class Failing(HashingEncoder):
    def encode(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("text")
        return super().encode(texts)


def test_one_key_in_two_trackers_is_two_issues(spark, tmp_dir):
    path = os.path.join(tmp_dir, "index")
    inc.index_batch(_issues(spark, [("A", "T-1", "x"), ("A", "T-1", "x")]), path, HashingEncoder(8))
    inc.index_batch(_issues(spark, [("B", "T-1", "x"), ("A", "T-1", "x")]), path, HashingEncoder(8))
    index = spark.read.parquet(path)
    assert sorted((r.repo, r.issue_key) for r in index.collect()) == [("A", "T-1"), ("B", "T-1")]
    assert ix.check_index(index).first()["consistent"]


def test_failing_texts_are_kept_and_encoded_later(spark, tmp_dir):
    path = os.path.join(tmp_dir, "index")
    rows = [("A", f"T-{i}", "bad" if i == 7 else f"text {i}") for i in range(30)]
    inc.index_batch(_issues(spark, rows), path, Failing(8))
    inc.index_batch(_issues(spark, rows), path, Failing(8))
    assert spark.read.parquet(path).count() == 29
    assert [r.issue_key for r in inc.rejected(spark, path).collect()] == ["T-7"]
    inc.retry_rejected(spark, path, Failing(8))
    assert spark.read.parquet(path).count() == 29
    inc.retry_rejected(spark, path, HashingEncoder(8))
    assert spark.read.parquet(path).count() == 30 and inc.rejected(spark, path).count() == 0


def test_comments_stay_in_their_tracker(spark):
    issues = spark.createDataFrame([("A", "T-1", (None,)), ("B", "T-1", (None,))],
                                   "repo string, key string, fields struct<comments:array<struct<id:string,created:string,body:string>>>")
    one = spark.createDataFrame([("A", "T-1", "1", "2020", "hi")], "repo string, key string, id string, created string, body string")
    got = {r.repo: r.fields.comments for r in cm.attach_comments(issues, one).collect()}
    assert len(got["A"]) == 1 and got["B"] is None
    got = {r.repo: r.fields.comments for r in cm.attach_comments(issues, one, processed=issues.select("repo", "key")).collect()}
    assert len(got["A"]) == 1 and got["B"] == []
    by_key = {r.repo: r.fields.comments for r in cm.attach_comments(issues, one.drop("repo")).collect()}
    assert len(by_key["A"]) == len(by_key["B"]) == 1


def test_ties_are_cut_by_key_inside_a_block():
    rng = np.random.default_rng(0)
    for _ in range(50):
        corpus, queries = rng.integers(-1, 2, (40, 3)).astype(float), rng.integers(-1, 2, (6, 3)).astype(float)
        keys = np.array([f"k{i:02d}" for i in rng.permutation(40)], object)
        ids = np.array([f"q{i}" for i in range(6)], object)
        best = nb.Best(queries, ids, 3, False)
        for part in np.array_split(np.arange(40), 3):
            best.add(corpus[part], keys[part])
        got = [best.rows()[c].to_numpy() for c in ("query_id", "key", "similarity")]
        assert len(got[0]) == 18
        for q in range(6):
            best = sorted(zip(-(corpus @ queries[q]), keys))[:3]
            assert sorted((-s, k) for i, k, s in zip(*got) if i == ids[q]) == best


@pytest.mark.parametrize("skip,limit", [(0, 4), (2, 5), (5, 10), (38, 5), (40, 5), (500, 5), (0, 100)])
def test_slices_with_ties_and_nulls(spark, skip, limit):
    values = [None] * 3 + [i // 4 for i in range(37)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    got = [r.v for r in ts.slice_by_order(df, "v", skip, limit, partitions=5).collect()]
    assert got == values[skip:skip + limit]


def test_a_cluster_needs_a_shared_folder():
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None),
                           sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(bare)


def test_intermediate_tables_lie_in_the_application_s_folder(spark):
    path = session.scratch_path(spark, "x")
    assert path.startswith(session.scratch_root(spark)) and spark.sparkContext.applicationId in path
    session.materialize(spark.range(3), "gone")
    from issuelens.sources import files
    assert any(n.startswith("gone-") for n in files.names(spark, session.scratch_root(spark)))
