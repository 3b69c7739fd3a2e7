"""Where jobs keep their intermediate tables.

Every table that cuts lineage or is read more than once goes to the folder the
cluster names in ``spark.checkpoint.dir``, which the driver and all executors
share, so that a lost executor never takes rows with it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one under the temp folder only where none is set and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"boxloom-{os.getpid()}")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/boxloom/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reader of those files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.table_path = path
    return made


def drop_tables(*tables: DataFrame) -> None:
    """Delete what :func:`write_table` wrote for ``tables``; nothing may read them any more."""
    for df in tables:
        remove_path(df.sparkSession, df.table_path)


def sized_broadcast(df: DataFrame, row_bytes: int = 128, limit: int = 64 << 20) -> DataFrame:
    """``df`` (a written table) hinted for a broadcast if its rows, at ``row_bytes`` each, keep below ``limit``; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
