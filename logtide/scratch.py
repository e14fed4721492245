"""Intermediate tables in the cluster's shared folder.

They are Parquet folders under ``spark.checkpoint.dir``, so a lost executor costs a re-read and
nothing more.  Only a session on one machine (``local[...]``) without that setting gets a folder of
its own; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError

#: This process's tables, removed when it ends normally.
_written: list[tuple] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="logtide-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared folder; ``clean`` removes what is there."""
    path = f"{scratch_dir(spark)}/logtide-{tag}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext.applicationId, path))
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete this session's intermediate tables; call it once results that read them are written."""
    sc = spark.sparkContext
    mine = [p for app, p in _written if app == sc.applicationId]
    for path in mine:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [x for x in _written if x[1] not in mine]


@atexit.register
def _clean_local() -> None:
    """What a local session leaves behind when its process ends."""
    for _, path in _written:
        local = path.removeprefix("file:")
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
