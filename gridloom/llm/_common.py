"""Shared plumbing: the cluster's shared folder, written tables and batch loops."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all of it is one local process (tests,
    a laptop) is a temporary folder set; a cluster without the setting is an error.
    """
    path = spark.conf.get(_KEY, None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set(_KEY, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts lineage and survives the loss of any executor: the files are in
    shared storage, not in block managers.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    schema = df.schema
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._gridloom_path = path
    return out


def drop_written(df: DataFrame | None) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans nobody refers to."""
    gc.collect()
    with contextlib.suppress(Exception):
        spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
