"""Fixing a result once for several readers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_pinned: list[str] = []


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder spark.checkpoint.dir and read back.

    Where that is unset, a local session uses a temporary folder; on a cluster that would
    be another folder on each machine, so it is an error there.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lectern-pinned-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    path = f"{base.rstrip('/')}/lectern-pinned-{uuid.uuid4().hex}"
    _pinned.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all pinned folders: for when the results that read them are written."""
    while _pinned:
        at = spark._jvm.org.apache.hadoop.fs.Path(_pinned.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
