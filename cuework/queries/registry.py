"""The registered queries: an operator run over the given tables, and its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuework.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR, DAY = 3600.0, 86400.0
# events carry seconds since 2024-01-01 as ``t``
EPOCH_US = 1704067200000000
E = f"e AS (SELECT *, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS t FROM events)"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(lambda t: table(spark, sf_dir, t))
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "events":
        df = df.withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1e6)
    # texts cost far more to work on than to move
    return spread(df) if name in ("documents", "part", "conversations") else df


def of_type(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("event_type") == kind)


def r(col: Column | str, digits: int = 6) -> Column:
    """Round for output; adding 0.0 turns a negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        return quote(x) if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows)
