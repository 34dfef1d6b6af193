"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "cuework") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "10g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a table comes in fewer splits than there are cores (a few small files).

    Tables with enough splits, which is what large ones have, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package() -> None:
    """Let functions of this package travel to the executors by value, where it is not installed there.

    Call once on the driver, before the first query.
    """
    import cuework
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(cuework)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is set only where none is configured (local tests).
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and sc.master.startswith("local"):
            shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        if shared is None:
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(shared)
    return df.checkpoint()
