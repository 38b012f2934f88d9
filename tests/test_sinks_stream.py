"""Sinks round trips, the incremental index restart rule and the held-out slice."""

import os

from pyspark.sql import functions as F

from issuelens import schemas as S
from issuelens import sinks
from issuelens.functions.embedding import HashingEncoder
from issuelens.operators import index as ix
from issuelens.sources import testset as ts
from issuelens.streaming import incremental as inc

NASTY = 'say "hi", then\nnew line, back\\slash, ünïcode,  nbsp'


def test_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(NASTY, "", "Bug", "Bug", True, "Issuetype: Bug\r\nok"),
                                ("s", None, "Task", "Unknown", False, "")],
                               S.EVAL_RESULT)
    p = os.path.join(tmp_dir, "r.csv")
    assert sinks.write_csv(df, p)
    back = sorted(sinks.read_csv(spark, p, S.EVAL_RESULT).collect(), key=lambda r: r["summary"])
    # CSV has one spelling for null and empty: both come back as '' (results hold no nulls)
    want = sorted(df.fillna("", subset=["description"]).collect(), key=lambda r: r["summary"])
    assert back == want


def test_jsonl_round_trip_and_empty(spark, tmp_dir):
    df = spark.createDataFrame([(NASTY, None, "Bug")], S.EVAL_ITEM)
    p = os.path.join(tmp_dir, "t.jsonl")
    assert sinks.write_jsonl(df, p)
    text = "".join(open(os.path.join(p, f), encoding="utf-8").read() for f in os.listdir(p) if f.endswith(".json"))
    assert '"description":null' in text and "ünïcode" in text
    assert sinks.read_jsonl(spark, p, S.EVAL_ITEM).collect() == df.collect()
    e = os.path.join(tmp_dir, "empty")
    assert not sinks.write_jsonl(df.where("false"), e)
    assert not os.path.exists(e)


def _docs(spark, ids):
    return spark.createDataFrame([(i, f"title {i}\nbody {i} words", "en", "s", 10) for i in ids],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stream_restart(spark, tmp_dir):
    src, index, ck = (os.path.join(tmp_dir, x) for x in ("src", "index", "ck"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"

    def run(checkpoint):
        q = inc.index_incrementally(spark, src, schema, index, checkpoint, encoder=HashingEncoder(16),
                                    max_files_per_trigger=1, prepare=inc.documents_as_issues)
        q.awaitTermination()
        return spark.read.parquet(index)

    _docs(spark, range(0, 10)).coalesce(1).write.mode("append").parquet(src)
    _docs(spark, range(10, 20)).coalesce(1).write.mode("append").parquet(src)
    assert run(ck).count() == 20
    _docs(spark, range(15, 30)).coalesce(1).write.mode("append").parquet(src)   # overlaps 15..19
    assert run(ck).count() == 30
    idx = run(os.path.join(tmp_dir, "fresh-ck"))                                # fresh checkpoint
    assert idx.count() == 30 and idx.select("issue_key").distinct().count() == 30
    chk = ix.check_index(idx).collect()[0]
    assert chk["consistent"] and chk["min_dim"] == 16
    batch = ix.build_index(inc.documents_as_issues(_docs(spark, range(0, 30))), HashingEncoder(16))
    assert sorted(r["issue_key"] for r in batch.collect()) == sorted(r["issue_key"] for r in idx.collect())


def test_index_consistency_rule(spark):
    bad = spark.createDataFrame([("a", "t", "x", [1.0, 0.0]), ("a", "t", "x", [1.0]), ("b", "t", "x", None)],
                                "issue_key string, text string, issuetype string, embedding array<float>")
    r = ix.check_index(bad).collect()[0]
    assert (r["rows"], r["keys"], r["null_vectors"], r["consistent"]) == (3, 2, 1, False)


def test_slice_strategies_agree(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("_id"), (F.col("id") * 7 % 13).alias("v"))
    a = [r["_id"] for r in ts.slice_by_order(df, "_id", 1234, 77, strategy="take").collect()]
    b = [r["_id"] for r in ts.slice_by_order(df, "_id", 1234, 77, strategy="ranked", partitions=6).collect()]
    assert a == b == list(range(1234, 1311))
