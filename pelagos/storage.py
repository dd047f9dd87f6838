"""Materialised steps in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may go without; it gets a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="pelagos-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The table cuts the lineage and outlives lost executors; later steps scan it with
    column pruning instead of computing it anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pelagos/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.pelagos_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise``. Only for those that no later step reads, lazily or after a lost executor."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.pelagos_path)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)
