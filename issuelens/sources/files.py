"""Small file operations through Spark's own file systems (local, HDFS, object stores)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession


class Size(NamedTuple):
    files: int
    bytes: int


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> Size | None:
    """Files and bytes below a folder, by one call to the file system; None if it is not there."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    summary = fs.getContentSummary(p)
    return Size(summary.getFileCount(), summary.getLength())


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes when a file of a table is added, removed or written again (names, sizes, times)."""
    from hashlib import md5

    fs, p = _at(spark, path)
    found, listed = [], fs.listFiles(p, True)
    while listed.hasNext():
        s = listed.next()
        found.append(f"{s.getPath().toString()}:{s.getLen()}:{s.getModificationTime()}")
    return md5("\n".join(sorted(found)).encode()).hexdigest()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, text: str, path: str) -> bool:
    """A new file with this text, there whole or not at all; False if the path is taken.

    The text goes to a hidden file beside it, which is then renamed without overwriting.
    """
    import uuid

    from py4j.protocol import Py4JJavaError

    fs, target = _at(spark, path)
    jvm = spark.sparkContext._jvm
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(hidden, target, no_options)
        return True
    except Py4JJavaError as e:
        fs.delete(hidden, False)
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
