"""Token counts by a separator scan of flat token files.

A flat token file is nothing but ids, each document's followed by the separator's; there
is no index. The stream is read as blocks. In every block the separators are searched at
once (NumPy), which gives their positions, the ids of the block and where its last
separator is. A document that began in an earlier block is stitched by a prefix scan
over these block summaries: the last separator before a block is the running maximum
along its file, taken within runs of ``CHUNK`` blocks and then over the runs, so that no
task needs a file's whole list of blocks.

Defined results: two separators in a row are an empty document; ids after the last
separator of a file are a document that is not ``terminated``; an empty file gives none;
a null text is empty; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land
from issuelens.llm.tokens import encoder

BLOCK = 1 << 16  # ids of a block
CHUNK = 1024  # blocks of a run
SEPARATOR = 50256


def _blocks_of(file: object, data: bytes, width: int, block: int, first: int = 0) -> Iterator[tuple]:
    for k in range(0, len(data), block * width):
        yield file, first + k // (block * width), data[k:k + block * width]


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, block, ids) of flat files below ``path``, by Spark's reader of whole binary files (2 GB a file at most)."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in _blocks_of(file, content.as_py(), width, block):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file", "block", "ids"])

    return files.mapInArrow(cut, "file string, block long, ids binary")


def token_stream(docs: DataFrame, vocabulary: str, ranks: str | None = None, dtype: str = "<u2", block: int = BLOCK,
                 separator: int = SEPARATOR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of every partition as the blocks of one flat file: file, block, ids, and labels.

    ``labels``, the ids of the documents whose separator lies in the block, stand beside
    the stream for callers that want to name what a scan finds; the scan reads only ids.
    """
    rows = keep_row(docs).select(F.col("row")[id].alias("id"), F.col("row")[text].cast("string").alias("text"),
                                 F.spark_partition_id().alias("file"))
    kind = rows.schema["id"].dataType.simpleString()
    size = block * np.dtype(dtype).itemsize

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, ranks).encode, np.array([separator], dtype).tobytes()
        held, length, n, labels, file, id_type = [], 0, 0, [], None, None

        def full(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary()),
                                               pa.array([labels], pa.list_(id_type))], names=["file", "block", "ids", "labels"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for id_, words, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                file = part
                data = np.frombuffer(encode(words), "<u4").astype(dtype).tobytes() + end
                while length + len(data) >= size:  # the block is full; what is left goes on in the next
                    cut = size - length
                    whole, data = b"".join([*held, data[:cut]]), data[cut:]
                    done = not data
                    if done:
                        labels.append(id_.as_py())
                    yield full(whole)
                    held, length, n, labels = [], 0, n + 1, []
                    if done:
                        break
                else:
                    held.append(data)
                    length += len(data)
                    labels.append(id_.as_py())
        if length:
            yield full(b"".join(held))

    return rows.mapInArrow(flat, f"file int, block long, ids binary, labels array<{kind}>")


def write_token_files(blocks: DataFrame, folder: str) -> DataFrame:
    """Writes each file's blocks, in order, as one flat file in a folder that all executors share; (file, bytes).

    A file is written under another name and then renamed, so a lost task leaves no part of one.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        out, name, tmp, size = None, None, None, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(tmp, f"{base}/{name:06d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([size], pa.int64())], names=["file", "bytes"])

        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if file != name:
                    if out is not None:
                        yield close()
                    name, tmp, size = file, f"{base}/_{uuid.uuid4().hex}", 0
                    store.create_dir(base)
                    out = store.open_output_stream(tmp)
                out.write(data)
                size += len(data)
        if out is not None:
            yield close()

    ordered = blocks.select("file", "block", "ids").repartition("file").sortWithinPartitions("file", "block")
    return ordered.mapInArrow(write, "file int, bytes long")


def scan(blocks: DataFrame, dtype: str = "<u2", separator: int = SEPARATOR, chunk: int = CHUNK) -> DataFrame:
    """One row per document: file, start, n_tokens, terminated, block (of its end), nth (end within the block), label.

    ``start`` counts ids from the file's first. Every block of a file but the last has equally many ids.
    """
    labelled = "labels" in blocks.columns
    if not labelled:
        blocks = blocks.withColumn("labels", F.lit(None).cast("array<bigint>"))
    file, label = blocks.schema["file"].dataType.simpleString(), blocks.schema["labels"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.frombuffer(x.as_buffer(), dtype) == separator) for x in batch.column("ids")]
            sizes = [len(x.as_buffer()) // np.dtype(dtype).itemsize for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), batch.column("labels")],
                names=["file", "block", "size", "ends", "labels"])

    found = land(blocks.select("file", "block", "ids", "labels").mapInArrow(
        search, f"file {file}, block long, size long, ends array<bigint>, labels {label}"), "separators")
    sums = (found.select("file", "block", "size", F.get("ends", F.size("ends") - 1).alias("last"))
            .withColumn("run", F.floor(F.col("block") / chunk)))
    full = found.groupBy("file").agg(F.max("size").alias("ids"), F.max("block").alias("blocks"))
    at = F.col("block") * F.col("ids")
    sums = sums.join(full, "file").withColumn("last", at + F.col("last"))
    in_run = sums.withColumn("before", F.max("last").over(W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    runs = (sums.groupBy("file", "run").agg(F.max("last").alias("last"))
            .withColumn("earlier", F.max("last").over(W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1))).drop("last"))
    carried = (in_run.join(runs, ["file", "run"]).withColumn("carry", F.coalesce("before", "earlier", F.lit(-1).cast("long")))
               .select("file", "block", "ids", "blocks", "carry"))
    whole = found.join(carried, ["file", "block"]).withColumn("at", at)
    ends = F.transform("ends", lambda e, i: F.struct(
        (F.when(i > 0, F.col("at") + F.get("ends", i - 1)).otherwise(F.col("carry")) + 1).alias("start"),
        (F.col("at") + e).alias("end"), F.lit(True).alias("terminated"), i.alias("nth"), F.get("labels", i).alias("label")))
    after = F.coalesce(F.col("at") + F.get("ends", F.size("ends") - 1), F.col("carry")) + 1
    tail = F.when((F.col("block") == F.col("blocks")) & (after < F.col("at") + F.col("size")), F.array(F.struct(
        after.alias("start"), (F.col("at") + F.col("size")).alias("end"), F.lit(False).alias("terminated"),
        F.size("ends").alias("nth"), F.get("labels", F.size("ends")).alias("label"))))
    docs = whole.select("file", "block", F.explode(F.concat(ends, F.coalesce(tail, F.filter(ends, lambda x: F.lit(False))))).alias("d"))
    out = docs.select("file", F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"),
                      "d.terminated", "block", "d.nth", "d.label")
    return out if labelled else out.drop("label")
