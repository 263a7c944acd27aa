"""Session helpers: reading tables, spreading small inputs, cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share, named by ``spark.checkpoint.dir``.

    Where that is unset a session on this machine alone, as in tests, gets a temporary folder;
    on a cluster, whose executors could not see each other's files there, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loopline.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[(\*|\d+)(,\s*\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loopline-")
        spark.conf.set("spark.loopline.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs at most the tasks since the last stage. The
    table has the schema of ``df`` and compressed columns, so later reads can prune.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stage` that nothing reads any more; other tables are left alone."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
    for folder in {os.path.dirname(x) for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        if p.getParent().toUri().getPath().rstrip("/") == root.rstrip("/"):
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, per_core: int = 2, most: int = 64) -> DataFrame:
    """Round-robin ``df`` over all cores when its scan has fewer tasks than cores, and fewer than ``most``.

    A scan of a large table has one task per file block already and is left alone, so at
    scale this adds no shuffle; it matters for tables of a few files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if df.rdd.getNumPartitions() < min(cores, most) else df
