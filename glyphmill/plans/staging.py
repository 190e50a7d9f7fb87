"""Staged tables: lineage is cut by a Parquet table in the folder all executors share.

A staged table is columnar and survives the loss of any executor, unlike a
checkpoint on their disks.  The folder is the session's ``spark.checkpoint.dir``; only
where that is unset and the session runs on one machine (tests, notebooks) a local
folder is made, and removed when the process ends.  Results read staged tables
lazily, so these live until ``drop_stages``, which a job calls when it has written
its results.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables, from ``spark.checkpoint.dir`` if the session names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _local:
        path = tempfile.mkdtemp(prefix="glyphmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local["dir"] = "file://" + path
    return _local["dir"]


def write_stage(df: DataFrame, name: str) -> str:
    """Write ``df`` once to the shared folder and return its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with its own schema."""
    path = write_stage(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables that this process has staged; results made from them cannot be read afterwards."""
    context = spark.sparkContext
    dropped = 0
    while _staged:
        path = context._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        dropped += bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True))
    return dropped
