"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JSON objects in model responses keep the last of two equal keys.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

_local_dirs: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators rely on.

    The number of shuffle partitions stays the caller's: set it, or
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum``, for the size of the cluster;
    adaptive execution merges what turns out small.
    """
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session that runs in this one process and names none gets a folder of its own; elsewhere
    a missing setting is an error, since a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="textquarry-")
        path, fs = hadoop(spark, f"file://{folder}")
        fs.deleteOnExit(path)
        _local_dirs[context.applicationId] = folder
    return _local_dirs[context.applicationId]


def staging_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder, removed when the driver JVM ends."""
    path = f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    hadoop_path, fs = hadoop(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """Hadoop ``Path`` and its ``FileSystem``."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
