"""Ordered scans per key that survive a hot key.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task. Here a key with more than
``hot_rows`` rows is cut into chunks along its order column; windows run per (key, chunk), and what
has to cross a chunk border travels in a small table with one row per chunk. That table holds at
most ``2 * rows / hot_rows`` rows, which is why it (and nothing else) is broadcast. Keys below the
limit keep one chunk and cost one shuffle, as with a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuework.session import checkpoint

HOT_ROWS = 1_000_000
TASK_ROWS = 200_000  # that one task of an ordered scan sorts
NO_SPLIT = 1 << 62
CHUNK, HOT = "_chunk", "_hot"


SPAN = 1 << 20  # parts of a chunk of equal values at most


def in_tasks(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Rows by key, in as many tasks as ``rows`` need; small tables come back as they are.

    Spark merges shuffled partitions up to a number of compressed bytes. Timed rows unfold to many times that, and every
    sort of a chain of scans holds them, so the memory of a task would grow with the table.
    """
    n = -(-rows // TASK_ROWS)
    return df if n <= 1 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *key)


def split_hot(df: DataFrame, key: Sequence[str], order: str, hot_rows: int | None = None,
              ties: Sequence[str] = ()) -> DataFrame:
    """Cut hot keys into chunks of their order column; without hot keys ``df`` comes back whole, spread by key.

    One map-side combined count per key decides (a small job of its own, so that the usual case
    keeps the plain plan). ``order`` is the leading order column, of any type; chunks are cut at
    approximate quantiles of its values, so they hold about as many rows each wherever the values lie.
    A value that is a cut has a chunk of its own, and so have rows where ``order`` is NULL, in front of the others.
    Such a chunk of equal values is cut further along the first of ``ties``, the columns that come next in the order,
    where it is too large; without ``ties`` it stays whole.
    """
    hot_rows = hot_rows or HOT_ROWS
    if hot_rows >= NO_SPLIT:
        return df
    key = list(key)
    o = _number(F.col(order), df.schema[order].dataType)
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    most, rows = counts.agg(F.max("_n"), F.sum("_n")).first()
    if most is None or most <= hot_rows:
        return in_tasks(df, key, rows or 0)
    counts = counts.filter(F.col("_n") > hot_rows)
    # one list of borders for each hot key, as long as the hottest one needs
    parts = -(-most // hot_rows)
    borders = (df.join(F.broadcast(counts), key, "left_semi").groupBy(*key)
               .agg(F.coalesce(F.array_distinct(F.percentile_approx(
                   o, [i / parts for i in range(1, parts)], 10_000)), F.array().cast("array<double>")).alias("_cut")))
    chunk = F.when(o.isNull(), F.lit(-1)).when(F.col("_cut").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("_cut", lambda x: x < o)) + F.size(F.filter("_cut", lambda x: x <= o)))
    split = (
        df.join(F.broadcast(borders), key, "left")
        .withColumn(CHUNK, chunk.cast("long"))
        .withColumn(HOT, F.col("_cut").isNotNull())
        .drop("_cut")
    )
    # every scan reads its input twice (rows, and chunk ends of hot keys): store it once instead of
    # working it out again at each step
    split = checkpoint(split)
    plain = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if ties and isinstance(df.schema[ties[0]].dataType, plain):
        split = _split_ties(split, key, order, hot_rows, ties)
    return in_tasks(split, [*key, CHUNK], rows)


def _split_ties(split: DataFrame, key: list[str], order: str, hot_rows: int, ties: Sequence[str]) -> DataFrame:
    """Cut chunks of equal values along the first of ``ties``; chunk numbers keep their order."""
    t = _number(F.col(ties[0]), split.schema[ties[0]].dataType)
    equal = (F.min(order).eqNullSafe(F.max(order))) & (F.count(order).isin(0) | (F.count(order) == F.count(F.lit(1))))
    heavy = split.filter(F.col(HOT)).groupBy(*key, CHUNK).agg(F.count(F.lit(1)).alias("_n"), equal.alias("_same")).filter(
        f"_same AND _n > {2 * hot_rows}").select(*key, CHUNK, "_n")
    most = heavy.agg(F.max("_n")).first()[0]
    if most is None:
        return split
    parts = min(SPAN, -(-most // hot_rows))
    within = (split.join(F.broadcast(heavy), [*key, CHUNK], "left_semi").groupBy(*key, CHUNK)
              .agg(F.percentile_approx(t, [i / parts for i in range(1, parts)], 10_000).alias("_cut")))
    part = F.when(F.col("_cut").isNull() | t.isNull(), F.lit(0)).otherwise(F.size(F.filter("_cut", lambda x: x < t)))
    return checkpoint(split.join(F.broadcast(within), [*key, CHUNK], "left").withColumn(
        CHUNK, F.col(CHUNK) * F.lit(SPAN) + part.cast("long")).drop("_cut"))


def _number(o: Column, kind: T.DataType) -> Column:
    """A number that rises with ``o`` (not strictly): its value, or the first bytes of a string."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(o).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(o.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(o).cast("double")
    if isinstance(kind, T.StringType):
        first = F.hex(F.substring(F.encode(o, "utf-8"), 1, 6))
        return F.conv(F.rpad(first, 12, "0"), 16, 10).cast("double")
    return o.cast("double")


def skew_limit(tables: Sequence[DataFrame], key: Sequence[str], hot_rows: int | None = None,
               growth: int = 8) -> int:
    """One look at the base tables of a composite flow instead of one per step.

    When no key comes near the limit in any of them (``growth`` allows for steps that multiply
    rows), every step may use plain windows and :data:`NO_SPLIT` is returned; otherwise the steps
    check for themselves.
    """
    hot_rows = hot_rows or HOT_ROWS
    if hot_rows >= NO_SPLIT:
        return NO_SPLIT
    sizes = None
    for t in tables:
        top = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
        sizes = top if sizes is None else sizes.unionByName(top)
    top = sizes.agg(F.max("n")).first()[0] or 0
    return NO_SPLIT if top * growth <= hot_rows else hot_rows


def is_split(df: DataFrame) -> bool:
    return CHUNK in df.columns


def unsplit(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK, HOT)


def _total(kind: str, col: Column, order: Column, reverse: bool) -> Column:
    if kind == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(col, F.when(col.isNotNull(), order))
    return {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[kind](col)


def _running(kind: str, col: Column) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True)
    return {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[kind](col)


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))


def scan(df: DataFrame, key: Sequence[str], order: Sequence[str],
         outputs: dict[str, tuple[str, Column | str]], reverse: bool = False) -> DataFrame:
    """Add what precedes each row (follows it, when ``reverse``), the row itself left out.

    ``df`` comes from :func:`split_hot`. ``outputs`` maps a column name to ``(kind, column)`` with
    kind ``last`` (nearest value that is not NULL), ``max``, ``min``, ``sum`` or ``count``.
    ``order`` must be total where the nearest value depends on it, its first column being the one
    the keys were split on.
    """
    key, order = list(key), list(order)
    cols = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in outputs.items()}
    by = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    if not is_split(df):
        w = Window.partitionBy(*key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({
            n: F.coalesce(_running(k, c).over(w), F.lit(0)) if k in ("sum", "count")
            else _running(k, c).over(w) for n, (k, c) in cols.items()})
    # HOT follows from the key; naming it lets the filter below reach the input
    local = Window.partitionBy(*key, CHUNK, HOT).orderBy(*by).rowsBetween(
        Window.unboundedPreceding, -1)
    across = Window.partitionBy(*key).orderBy(
        F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()).rowsBetween(
        Window.unboundedPreceding, -1)
    position = F.struct(*order)
    carried = (
        df.filter(F.col(HOT))
        .groupBy(*key, CHUNK)
        .agg(*[_total(k, c, position, reverse).alias(n) for n, (k, c) in cols.items()])
        .select(*key, CHUNK, *[
            _running("sum" if k == "count" else k, F.col(n)).over(across).alias(f"_c_{n}")
            for n, (k, _) in cols.items()])
    )
    out = df.withColumns({f"_l_{n}": _running(k, c).over(local) for n, (k, c) in cols.items()})
    out = out.join(F.broadcast(carried), [*key, CHUNK], "left")
    out = out.withColumns({n: _merge(k, F.col(f"_c_{n}"), F.col(f"_l_{n}"))
                           for n, (k, _) in cols.items()})
    return out.drop(*[f"_c_{n}" for n in cols], *[f"_l_{n}" for n in cols])


def totals(df: DataFrame, key: Sequence[str],
           outputs: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """Add whole-key aggregates (``max``, ``min``, ``sum``, ``count``) to every row of the key."""
    key = list(key)
    cols = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in outputs.items()}
    if not is_split(df):
        w = Window.partitionBy(*key)
        return df.withColumns({n: _running(k, c).over(w) for n, (k, c) in cols.items()})
    local = Window.partitionBy(*key, CHUNK, HOT)
    whole = (df.filter(F.col(HOT)).groupBy(*key)
             .agg(*[_running(k, c).alias(f"_g_{n}") for n, (k, c) in cols.items()]))
    out = df.withColumns({f"_l_{n}": _running(k, c).over(local) for n, (k, c) in cols.items()})
    out = out.join(F.broadcast(whole), key, "left")
    out = out.withColumns({n: F.coalesce(F.col(f"_g_{n}"), F.col(f"_l_{n}")) for n in cols})
    return out.drop(*[f"_g_{n}" for n in cols], *[f"_l_{n}" for n in cols])


def range_sums(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, value: str | None,
               lo: str, hi: str, span_id: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Per span the count (and sum of ``value``) of the key's points with ``lo <= at < hi``.

    Both ends of every span are merged into the points and read off running totals, so the work
    grows with points + spans, never with the pairs. Returns ``spans`` columns plus ``n`` and
    ``total``.
    """
    key, span_id = list(key), list(span_id)
    v = F.col(value).cast("double") if value else F.lit(0.0)
    pts = points.select(*key, F.col(at).cast("double").alias("_at"), F.lit(2).alias("_k"),
                        v.alias("_v"), F.lit(1).alias("_one"))
    rest = [c for c in spans.columns if c not in key and c not in span_id]
    # the other columns of a span ride on its lower end, so the spans are read once
    row = F.struct(F.lit(1).alias("_"), *rest)
    low = F.struct(F.col(lo).cast("double").alias("_at"), F.lit(0).alias("_k"), row.alias("_row"))
    high = F.struct(F.col(hi).cast("double").alias("_at"), F.lit(1).alias("_k"),
                    F.when(F.lit(False), row).alias("_row"))
    ends = spans.select(*key, *span_id, F.explode(F.array(low, high)).alias("e")).select(
        *key, *span_id, "e._at", "e._k", "e._row")
    both = split_hot(pts.unionByName(ends, allowMissingColumns=True), key, "_at", hot_rows)
    run = scan(both, key, ["_at", "_k"], {"_s": ("sum", "_v"), "_n": ("count", "_one")})
    sign = F.when(F.col("_k") == 1, 1).otherwise(-1)
    per_span = (run.filter(F.col("_k") < 2).groupBy(*key, *span_id)
                .agg(F.first("_row", ignorenulls=True).alias("_row"),
                     F.sum(sign * F.col("_n")).alias("n"),
                     # differences of running totals carry noise in the last digits
                     F.bround(F.sum(sign * F.col("_s")), 9).alias("total")))
    return per_span.select(*key, *span_id, *[F.col("_row")[c].alias(c) for c in rest], "n", "total")
