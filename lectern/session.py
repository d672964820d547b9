"""Shared folder and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Bytes that a Python worker gets at a time where a task has several workers, each with buffers on both sides.
SMALL_BATCH = 1 << 22
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_handed_out: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting (tests) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext.getCheckpointDir()


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``clear_scratch`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def small_batches(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of this one, in which an Arrow batch has at most ``SMALL_BATCH`` bytes.

    Spark takes the size of batches from the session that runs a plan, so everything in it has to come from this session.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    given = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING, str(SMALL_BATCH)))
    own.conf.set(BATCH_SETTING, str(min(given, SMALL_BATCH) if given > 0 else SMALL_BATCH))
    return own


def clear_scratch(spark: SparkSession) -> int:
    """Delete everything that this session wrote below the shared folder; returns the number of paths.

    For when results have been consumed or stored: a frame read from such a path is gone with it.
    """
    return _delete(spark, 0)


def scratch_mark(spark: SparkSession) -> int:
    """A mark for ``materialized(..., since=mark)``."""
    return len(_handed_out.setdefault(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, since: int, last: int | None = None) -> int:
    """Delete the paths handed out from number ``since`` on, up to ``last``."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    paths = _handed_out.get(context.applicationId, [])
    gone = paths[since:last]
    paths[since:last] = []
    for path in map(jvm.org.apache.hadoop.fs.Path, gone):
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def materialized(df: DataFrame, label: str, since: int | None = None, until: int = -1) -> DataFrame:
    """Write the rows to the shared folder once and read them back.

    For results that several branches of a plan need: they are not computed again, they
    survive lost executors, and every reader gets only the columns it asks for. With
    ``since``, what was written after that mark and before these rows, or the mark ``until``,
    is deleted: the steps that led to them are over.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    if since is not None:
        _delete(spark, since, until)
    return spark.read.parquet(path)
