"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary
    folder; on a cluster no folder of one machine would do, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"draftgraph-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if ":/" in found else "file://" + os.path.abspath(found)


def _remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Scratch(threading.local):
    """Which tables were written in the blocks that are open in this thread, innermost last."""

    def __init__(self):
        self.blocks: list[dict[str, SparkSession]] = []


_SCRATCH = Scratch()


@contextmanager
def scratch(sweep: bool = False):
    """Tables that ``materialize`` writes in this block are removed at its end, but for those that are read
    by DataFrames given to the function that it yields; these belong to the block around it, if any. Only
    such DataFrames may leave the block. Shuffle files of its jobs go when the driver's JVM next collects
    its garbage, for which ``sweep`` asks: in blocks that shuffle much."""
    block: dict[str, SparkSession] = {}
    left: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        read = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
        left.update(p for p in block if os.path.basename(p) in read)
        return df

    _SCRATCH.blocks.append(block)
    try:
        yield keep
    finally:
        _SCRATCH.blocks.remove(block)
        for path, spark in block.items():
            if path in left:
                if _SCRATCH.blocks:
                    _SCRATCH.blocks[-1][path] = spark
            else:
                _remove(spark, path)
        if sweep and block:
            gc.collect()
            next(iter(block.values()))._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/draftgraph/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back: lineage ends there, so a lost
    executor costs no recomputation and later readers do not run the plan again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _SCRATCH.blocks:
        _SCRATCH.blocks[-1][path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grows(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is never broadcast: a row or more for each drawing. Files of
    regular drawings are so small, and a Generate counts for nothing in Spark's estimates, that Spark
    would send millions of rows through the driver's memory."""
    return df.hint("merge")
