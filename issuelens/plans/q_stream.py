"""Registered incremental-index queries (Structured Streaming, available-now)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.embedding import HashingEncoder
from ..operators import search
from ..session import scratch_path
from ..sources import files, tables
from ..streaming import incremental as inc
from . import oracle_views as ov
from .registry import register

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

_SQL = ov.with_(ov.ISSUES_TEXT) + """
SELECT key AS issue_key, issuetype, coalesce(summary, '') || ' ' || coalesce(description, '') AS text FROM issues_text"""


def _run(spark, src, glob=None, max_files=None, checkpoint=None, index=None):
    index = index or scratch_path(spark, "stream-index")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    q = inc.index_incrementally(spark, src, DOC_SCHEMA, index, checkpoint,
                                encoder=HashingEncoder(64), path_glob=glob,
                                max_files_per_trigger=max_files,
                                prepare=inc.documents_as_issues)
    q.awaitTermination()
    return index, checkpoint, q


def stream_source(spark, sf, name="documents"):
    """(path, glob) of a table's files as a stream: a folder of files is streamed itself, a single file from the folder that holds it."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    return (path, None) if files.is_folder(spark, path) else (sf, f"{name}.parquet")


@register("str_01", _SQL)
def str_01(spark, sf):
    """Build, then run again with the same checkpoint and with a fresh one: the
    index still holds every document exactly once."""
    src, glob = stream_source(spark, sf)
    index, ckpt, _ = _run(spark, src, glob=glob)
    _run(spark, src, glob=glob, checkpoint=ckpt, index=index)
    _run(spark, src, glob=glob, index=index)
    return search.open_index(spark, index)[1].select("issue_key", "issuetype", "text")


LANDED_BYTES = 128 << 20   # of the table in a landed file


def landed_files(spark, sf, name="documents") -> int:
    """Files in which a table lands: four, and as many more as keep a file near ``LANDED_BYTES``."""
    return max(4, math.ceil(files.size(spark, f"{sf.rstrip('/')}/{name}.parquet").bytes / LANDED_BYTES))


@register("str_02", _SQL)
def str_02(spark, sf):
    """Landed files arrive as several parts; one file per micro-batch."""
    landed = scratch_path(spark, "landed-docs")
    docs = tables.table(spark, sf, "documents")
    docs.repartition(landed_files(spark, sf), F.col("doc_id")).write.parquet(landed)
    index, _, q = _run(spark, landed, max_files=1)
    return search.open_index(spark, index)[1].select("issue_key", "issuetype", "text")
