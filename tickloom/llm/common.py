"""Helpers shared by the operators of this subpackage: table reads, the shared work folder, list slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, by a path that only Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local master (as in tests) gets a temporary folder; on a cluster that is an error, as a machine's
    own folder isn't seen by the others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tickloom-"))
        shared = context.getCheckpointDir().get()
    return shared.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is saved inside goes at the end, but for what is saved to be kept: that has to be all that is read later."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            drop_dir(spark, path)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_dir(df.sparkSession, name)
    if not keep and (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and its Path class, for small metadata files and renames."""
    jvm = spark._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def drop_dir(spark: SparkSession, path: str) -> None:
    fs, to_path = file_system(spark, path)
    fs.delete(to_path(path), True)


def workers_find_us(spark: SparkSession) -> None:
    """Python workers import this package by name, from the folder that holds it, wherever the driver was started.

    Batches for them are kept small: their default of 64 MB, on both sides of the pipe, is much where texts are long. This
    changes the session: its batch size, where that is the default, and the workers' PYTHONPATH, to which a folder is added.
    """
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, "8m")
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
