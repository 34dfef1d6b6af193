"""Tables that cut lineage: written to the shared folder of the session and read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.conf.get("spark.master", "local").startswith("local["):
        made = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; nobody else uses it."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the files: lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`stored` made, once what was derived from them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
