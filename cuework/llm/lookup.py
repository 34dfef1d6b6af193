"""Rows of a large table by a list of ids, without moving the rows that can't be meant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22  # of the filter: half a megabyte, whatever the number of ids


def _marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows with ``__bit``: 1 where the hash of ``key`` is that of an id, as a map of ``2 ** BITS`` bits tells."""
    name = ids.columns[0]
    h = F.xxhash64(F.col(name)).bitwiseAND((1 << BITS) - 1)
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("__w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("__bits"))
    h = F.xxhash64(F.col(key)).bitwiseAND((1 << BITS) - 1)
    near = rows.withColumn("__at", F.shiftright(h, 6).cast("int")).join(
        F.broadcast(words), F.col("__at") == F.col("__w"), "left")
    return near.withColumn("__bit", F.getbit(F.coalesce("__bits", F.lit(0).cast("long")), h.bitwiseAND(63).cast("int")))


def rows_without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` (long, not null) is not in the one column of ``ids``: only those are joined whose bit is set."""
    near = _marked(rows, key, ids)
    left = near.where("__bit = 1").join(ids.select(F.col(ids.columns[0]).alias("__id")), F.col(key) == F.col("__id"), "left_anti")
    return near.where("__bit = 0").select(rows.columns).unionByName(left.select(rows.columns))


def rows_of(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` (long) is in the one column of ``ids``, which are distinct.

    A bit for each hash value of an id is set in a map of fixed size, a table of at most ``2 ** (BITS - 6)`` words that
    every task gets; rows whose bit is not set end where they are read, the others are joined. With very many ids all
    bits are set, and the join alone decides.
    """
    name = ids.columns[0]
    h = F.xxhash64(F.col(name)).bitwiseAND((1 << BITS) - 1)
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("__w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("__bits"))
    h = F.xxhash64(F.col(key)).bitwiseAND((1 << BITS) - 1)
    word = F.shiftright(h, 6).cast("int")
    near = rows.withColumn("__at", word).join(F.broadcast(words), F.col("__at") == F.col("__w"))
    near = near.where(F.getbit("__bits", h.bitwiseAND(63).cast("int")) == 1)
    return near.join(ids, near[key] == ids[name]).select(*(near[c] for c in rows.columns))
