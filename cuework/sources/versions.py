"""Tables with a current version: folders of data, and a log that says which of them count.

``<table>/_log/<number>.json`` is the state after commit ``number``; the highest one is current. A state is written
after all data it names, under another name first and then renamed, which fails when the number is taken: readers see
whole states only, a writer that dies leaves the table as it was, and of two writers one has to start again. Everything
goes through Hadoop's file systems, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """The commit number is taken by somebody else."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def commits(spark: SparkSession, table: str) -> list[int]:
    """Numbers of all commits that are still in the log, rising."""
    log, fs = _path(spark, f"{table}/_log")
    if not fs.exists(log):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def state(spark: SparkSession, table: str, number: int | None = None) -> dict | None:
    """The state after a commit, the last one without ``number``; None for a table without commits."""
    if number is None:
        done = commits(spark, table)
        if not done:
            return None
        number = done[-1]
    p, fs = _path(spark, f"{table}/_log/{number:020d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, table: str, number: int, new: dict) -> None:
    """Make ``new`` the state after commit ``number``; raises :class:`Conflict` when there is such a commit."""
    jvm = spark._jvm
    hidden, fs = _path(spark, f"{table}/_log/.{uuid.uuid4().hex}")
    final, _ = _path(spark, f"{table}/_log/{number:020d}.json")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            final.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(hidden, final, options)
    except Exception as e:
        fs.delete(hidden, False)
        if fs.exists(final):
            raise Conflict(f"commit {number} of {table} exists") from e
        raise


def delete_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


# --- whole versions, clustered by key ---------------------------------------------------------------------------

def write_version(df: DataFrame, table: str, cluster_by: Sequence[str] = (), files: int | None = None,
                  name: str = "") -> int:
    """Write ``df`` as the new current version (in folder ``data/<name>``) and return its number.

    Rows are cut into ranges of ``cluster_by``, one file or more each (``files`` ranges, else as many as Spark finds
    right), and the least and greatest key of each file are kept next to the log, for :func:`read_version`. Nulls in
    the first cluster column come first and are never pruned. A conflict is tried again once more per commit of others.
    """
    spark = df.sparkSession
    cluster_by = list(cluster_by)
    name = name or uuid.uuid4().hex
    out = df
    if cluster_by:
        out = out.repartitionByRange(*([files] if files else []), *cluster_by).sortWithinPartitions(*cluster_by)
    out.write.mode("error").parquet(f"{table}/data/{name}")
    entry = {"data": f"data/{name}", "bounds": None, "cluster_by": cluster_by}
    if cluster_by:
        first = F.col(cluster_by[0])
        bounds = (spark.read.schema(df.schema).parquet(f"{table}/data/{name}").groupBy(F.input_file_name().alias("file"))
                  .agg(F.min(first).alias("low"), F.max(first).alias("high"), F.count_if(first.isNull()).alias("nulls"),
                       F.count(F.lit(1)).alias("n")))
        bounds.coalesce(1).write.mode("error").parquet(f"{table}/bounds/{name}")
        entry["bounds"] = f"bounds/{name}"
    while True:
        number = (commits(spark, table) or [0])[-1] + 1
        try:
            commit(spark, table, number, entry)
            return number
        except Conflict:
            continue


def version_files(spark: SparkSession, table: str, low=None, high=None, number: int | None = None) -> DataFrame:
    """Files (``file``, ``low``, ``high``, ``nulls``, ``n``) of a version that may hold keys from ``low`` to ``high``."""
    now = state(spark, table, number)
    files = spark.read.parquet(f"{table}/{now['bounds']}")
    keep: Column = F.lit(True)
    if low is not None:
        keep = keep & (F.col("high") >= F.lit(low))
    if high is not None:
        keep = keep & (F.col("low") <= F.lit(high))
    return files.where(keep)


def read_version(spark: SparkSession, table: str, low=None, high=None, number: int | None = None) -> DataFrame:
    """The current version (or an older one that is still kept). With bounds, only rows whose first cluster column lies
    between them, read from the files that may hold such; raises LookupError for a table without a version."""
    now = state(spark, table, number)
    if now is None:
        raise LookupError(f"{table} has no version")
    whole = f"{table}/{now['data']}"
    if low is None and high is None:
        return spark.read.parquet(whole)
    if not now["cluster_by"]:
        raise ValueError("bounds need a clustered table")
    names = [r["file"] for r in version_files(spark, table, low, high, number).select("file").collect()]
    schema = spark.read.parquet(whole).schema
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    key = F.col(now["cluster_by"][0])
    if low is not None:
        rows = rows.where(key >= F.lit(low))
    return rows.where(key <= F.lit(high)) if high is not None else rows


def drop_versions(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Forget all but the last ``keep`` commits and delete data that no kept one names; returns how many went.

    Data of a writer that has not committed yet would go too: run it when nobody writes.
    """
    done = commits(spark, table)
    kept = [state(spark, table, n) for n in done[-keep:]]
    named = {part for s in kept for part in _folders(s)}
    for n in done[:-keep]:
        p, fs = _path(spark, f"{table}/_log/{n:020d}.json")
        fs.delete(p, False)
    gone = 0
    for top in ("data", "bounds"):
        p, fs = _path(spark, f"{table}/{top}")
        for f in fs.listStatus(p) if fs.exists(p) else []:
            name = f"{top}/{f.getPath().getName()}"
            if name not in named:
                fs.delete(f.getPath(), True)
                gone += 1
    return gone


def _folders(s: dict) -> set[str]:
    """First two levels of every path a state names."""
    paths = [s.get("data"), s.get("bounds"), *s.get("buckets", {}).values()]
    return {"/".join(p.split("/")[:2]) for p in paths if p}


# --- buckets, rewritten one by one ------------------------------------------------------------------------------

BUCKET = "_bucket"


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, table: str, schema, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of all buckets of the current state, or of some; an empty table has the schema and no rows."""
    now = state(spark, table)
    folders = [] if now is None else [f"{table}/{p}" for b, p in now["buckets"].items()
                                      if only is None or int(b) in only]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def merge_buckets(table: str, changes: DataFrame, key: Sequence[str], apply, number: int, buckets: int = 64) -> list[int]:
    """Commit ``number``: ``apply(base, changes)`` for the buckets (hash of ``key``) that ``changes`` touches.

    Only the touched buckets are read and written, each to a folder of this commit; the others keep their files. The
    same commit again, as a stream repeats a batch after a failure, does nothing when it is in the log, and otherwise
    overwrites what a dead try may have left. ``apply`` must not depend on other keys. Returns the touched buckets.
    A table keeps the number of buckets it was made with.
    """
    spark = changes.sparkSession
    now = state(spark, table) or {"buckets": {}, "count": buckets}
    if number in commits(spark, table):
        return []
    buckets = now["count"]
    of = bucket_of(key, buckets)
    touched = sorted(r[0] for r in changes.select(of.alias("b")).distinct().collect())
    if touched:
        base = read_buckets(spark, table, changes.schema, touched)
        folder = f"data/commit={number}"
        new = apply(base, changes).withColumn(BUCKET, of)
        # one shuffle: the rows of a bucket meet in one place, or in several where it is large
        new.repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{table}/{folder}")
        left = {str(b): f"{folder}/{BUCKET}={b}" for b in touched if exists(spark, f"{table}/{folder}/{BUCKET}={b}")}
        kept = {b: p for b, p in now["buckets"].items() if int(b) not in touched}
        now = {**now, "buckets": {**kept, **left}}
    commit(spark, table, number, now)
    return touched
