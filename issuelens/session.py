"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults a job on this library wants; every one can be overridden by the cluster.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches feeding the encoder, the generator and the block products:
    # rows can be whole documents or prompts with three documents, so batches are
    # kept small enough to stay far below a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "issuelens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` defaults to ``local[$BENCH_CPUS]`` / ``local[*]`` only when no master
    is configured, so the same call works under ``spark-submit`` on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master is None and "SPARK_MASTER" not in os.environ:
        cpus = os.environ.get("BENCH_CPUS")
        master = f"local[{cpus}]" if cpus else "local[*]"
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextlib.contextmanager
def settings(spark: SparkSession, **conf):
    """Session settings (names with _ for .) for the plans that run inside; those before come back after."""
    before = {k: spark.conf.get(k, None) for k in (k.replace("_", ".") for k in conf)}
    try:
        for k, v in conf.items():
            spark.conf.set(k.replace("_", "."), str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Read from the session; only when it is unset in a local run (tests, bench) a
    private folder is created and registered, so lineage cuts and sink round trips
    work. On a cluster an unset folder is an error: executors share no local disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="issuelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared one: intermediate tables, removed when the driver's process ends."""
    root = f"{shared_dir(spark).rstrip('/')}/issuelens/{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_remove_at_exit, spark, root)
    return root


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path for an intermediate table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Results that still read them must have been written before."""
    root = scratch_root(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:   # else the session was stopped, and with it the way to the file system
        remove_scratch(spark)


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df, name: str = "table", partition_by: str | None = None):
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts lineage (an executor loss recomputes from the files, not from the
    source joins) and lets every later branch prune columns from the file; with
    ``partition_by`` a filter on that column prunes whole folders. No shuffle:
    each task writes the partitions it holds.
    """
    path = scratch_path(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)
