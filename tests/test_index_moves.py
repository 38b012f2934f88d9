"""What a commit of the index moves: texts are not dealt anew, a worker gets few at once; nulls and copies end as before."""

from pyspark.sql import functions as F

from issuelens.functions.embedding import HashingEncoder
from issuelens.operators import search
from issuelens.operators import snapshot as sn
from issuelens.plans.inspect import plan_text

SCHEMA = "repo string, _id long, key string, fields struct<summary:string,description:string,issuetype:struct<name:string>>"


def _issues(spark, rows):
    return spark.createDataFrame([(r, i, k, (t, None, ("Bug",))) for i, (r, k, t) in enumerate(rows)], SCHEMA)


def test_texts_are_written_without_a_shuffle_in_small_batches(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/docs"
    _issues(spark, [("A", f"T-{i}", f"text {i}") for i in range(300)]).repartition(8).write.parquet(path)
    real, seen = sn.write_part, []

    def look(df, *a):
        if "text" in df.columns:
            seen.append((plan_text(df, "simple"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return real(df, *a)

    monkeypatch.setattr(sn, "write_part", look)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        search.add(spark, f"{tmp_dir}/i", spark.read.parquet(path), HashingEncoder(8), "one")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(seen) == 1 and "Exchange" not in seen[0][0] and int(seen[0][1]) == search.BATCH_ROWS
    held, index, cells = search.open_index(spark, f"{tmp_dir}/i")
    assert held.rows() == index.count() == 300 == int(cells.rows.sum())


def test_copies_and_null_keys_are_indexed_once(spark, tmp_dir):
    rows = [("A", "1", "a"), ("A", "1", "a"), (None, "1", "b"), (None, "1", "b"), ("B", "1", "c"), (None, "2", "d")]
    search.add(spark, f"{tmp_dir}/i", _issues(spark, rows), HashingEncoder(8), "one")
    _, index, _ = search.open_index(spark, f"{tmp_dir}/i")
    got = sorted((r.repo or "", r.issue_key, r.text) for r in index.select("repo", "issue_key", "text").collect())
    assert got == [("", "1", "b "), ("", "2", "d "), ("A", "1", "a "), ("B", "1", "c ")]
    assert search.ledger(spark, f"{tmp_dir}/i").where(F.col("batch") == "one").collect()[0][1:] == (6, 2, 0, 4, 0)
