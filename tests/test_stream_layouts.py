"""Registered stream queries on tables that are one file or a folder of files, and the files a table lands in."""

import os

import pytest

from issuelens.plans import q_stream


def _documents(spark, folder, parts):
    rows = [(i, f"title {i}\nbody {i}", "en", "s", 10) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if parts > 1:
        d.repartition(parts).write.parquet(f"{folder}/documents.parquet")
    else:
        d.toPandas().to_parquet(f"{folder}/documents.parquet", index=False)
    spark.range(3).write.parquet(f"{folder}/labels.parquet")
    return sorted((str(i), "en", f"title {i} body {i}") for i in range(30))


@pytest.mark.parametrize("parts", [1, 3])
def test_str_01_reads_a_file_and_a_folder_of_files(spark, tmp_dir, parts):
    want = _documents(spark, tmp_dir, parts)
    got = q_stream.str_01(spark, tmp_dir)
    assert sorted((r.issue_key, r.issuetype, r.text) for r in got.collect()) == want


def test_str_02_lands_more_files_of_a_larger_table(spark, tmp_dir, monkeypatch):
    want = _documents(spark, tmp_dir, 3)
    assert q_stream.landed_files(spark, tmp_dir) == 4
    held = sum(os.path.getsize(f"{tmp_dir}/documents.parquet/{f}") for f in os.listdir(f"{tmp_dir}/documents.parquet"))
    monkeypatch.setattr(q_stream, "LANDED_BYTES", held // 6)
    assert q_stream.landed_files(spark, tmp_dir) >= 6
    got = q_stream.str_02(spark, tmp_dir)
    assert sorted((r.issue_key, r.issuetype, r.text) for r in got.collect()) == want
