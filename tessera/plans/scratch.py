"""Tables that cut lineage, written where every executor can read them.

The folder is the one the session names in ``spark.checkpoint.dir``; only a local session without
that setting (tests, a laptop) gets a temporary folder of its own, on a cluster that is an error. What
is in a temporary folder goes when the driver ends; ``remove`` deletes a finished table of a shared one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes ``df`` to the shared folder once and returns a reader of it.

    A lost executor costs no recomputation beyond this table, and the reader carries no
    partitioning, so that a join on it plans exchanges that adaptive execution may split.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a finished table or folder, wherever its file system is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
