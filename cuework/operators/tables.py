"""Keeping tables current: upserts, patches, caches, tombstones, cascades, cleanup.

Each function returns the new state as a DataFrame; :func:`cuework.sources.sinks.write_version`
writes it next to the old one. Inputs with one row per key use joins that Spark may broadcast by
size; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions.hashing import content_key
from cuework.operators.ordered import in_tasks
from cuework.session import checkpoint


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], replace: Sequence[str],
           created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Insert new keys; for known keys take ``replace`` and ``updated`` from the change.

    ``created`` of a known key and every other column stay. ``changes`` has one row per key.
    """
    key = list(key)
    c = changes.select(*key, *[F.col(x).alias(f"_{x}") for x in changes.columns if x not in key],
                       F.lit(True).alias("_hit"))
    both = base.withColumn("_old", F.lit(True)).join(c, key, "full")
    hit, old = F.col("_hit").isNotNull(), F.col("_old").isNotNull()
    cols = []
    for name in base.columns:
        if name in key:
            cols.append(F.col(name))
        elif f"_{name}" not in both.columns:
            cols.append(F.col(name))
        elif name in replace or name == updated:
            cols.append(F.when(hit, F.col(f"_{name}")).otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.when(old, F.col(name)).otherwise(F.col(f"_{name}")).alias(name))
    return both.select(*cols)


def patch(base: DataFrame, changes: DataFrame, key: Sequence[str],
          set_flags: dict[str, str] | None = None) -> DataFrame:
    """Change only what a change row supplies.

    Without flags a NULL means "leave as it is"; ``set_flags`` maps a column to the boolean column
    that says whether it was supplied, so that NULL can also be written.
    """
    key = list(key)
    set_flags = set_flags or {}
    named = [x for x in changes.columns if x in base.columns and x not in key]
    c = changes.select(*key, *[F.col(x).alias(f"_{x}") for x in named],
                       *[F.col(f).alias(f"_set_{x}") for x, f in set_flags.items()])
    out = base.join(c, key, "left")
    for x in named:
        given = F.coalesce(F.col(f"_set_{x}"), F.lit(False)) if x in set_flags \
            else F.col(f"_{x}").isNotNull()
        out = out.withColumn(x, F.when(given, F.col(f"_{x}")).otherwise(F.col(x)))
    return out.select(*base.columns)


def ttl_lookup(keys: DataFrame, cache: DataFrame, key: Sequence[str], now: Column,
               fetched: str = "fetched_at", ttl: float = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Cached values for the keys; ``hit`` is true only for entries no older than ``ttl`` seconds."""
    def seconds(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) / 1e6

    age = seconds(now) - seconds(F.col(fetched))
    out = keys.join(cache, list(key), "left").withColumn("age_seconds", age)
    hit = F.coalesce(F.col("age_seconds") <= ttl, F.lit(False))
    values = [c for c in cache.columns if c not in (*key, fetched)]
    return out.withColumn("hit", hit).withColumns(
        {c: F.when(F.col("hit"), F.col(c)) for c in values})


def memo_enrich(df: DataFrame, key_cols: Sequence[str],
                fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``v`` to every row, calling ``fn`` only for keys the memo table (k, v) lacks.

    ``fn`` maps batches of (k, key columns) to (k, v) and sees each key once. Of repeated memo keys the least
    value counts. Returns the rows and the new memo table.
    """
    keyed = df.withColumn("k", content_key(*key_cols))
    memo = memo.groupBy("k").agg(F.min("v").alias("v"))
    todo = keyed.select("k", *key_cols).dropDuplicates(["k"]).join(memo.select("k"), "k",
                                                                   "left_anti")
    # written down once: both results below read it
    fresh = checkpoint(todo.mapInPandas(fn, "k string, v string"))
    table = memo.select("k", "v").unionByName(fresh)
    return keyed.join(table, "k", "left"), table


def exclude(assets: DataFrame, exclusions: DataFrame, refs: DataFrame,
            on: Sequence[str] = ("job_id", "provider", "provider_ref")
            ) -> tuple[DataFrame, DataFrame]:
    """(assets without the excluded references, exclusions with them added once)."""
    on = list(on)
    return (assets.join(refs.select(*on), on, "left_anti"),
            exclusions.select(*on).unionByName(refs.select(*on)).distinct())


def clear_assets(assets: DataFrame, keys: DataFrame, key: str = "job_id") -> DataFrame:
    return assets.join(keys.select(key), key, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str,
                   keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Drop the keys from every table except those named in ``keep`` (history that must stay)."""
    gone = keys.select(key).distinct()
    return {n: t if n in keep else t.join(gone, key, "left_anti") for n, t in tables.items()}


def plan_cleanup(items: DataFrame, known: DataFrame, active: DataFrame, now: Column,
                 key: str = "job_id", max_age: float = fixed.PREVIEW_MAX_AGE_SECONDS) -> DataFrame:
    """Items that may be deleted: job and media folders of unknown keys, and old previews.

    ``items`` has path, job_id, kind ("job", "media", "preview", ...), mtime. Any other kind, such
    as finished output, is never listed.
    """
    keep = known.select(key).unionByName(active.select(key)).distinct()
    orphans = (items.filter(F.col("kind").isin("job", "media")).join(keep, key, "left_anti")
               .select(*items.columns).withColumn("why", F.lit("orphan")))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp"))
           ) / 1e6
    old = items.filter((F.col("kind") == "preview") & (age > max_age)).withColumn(
        "why", F.lit("old preview"))
    return orphans.unionByName(old)


def apply_alignment(lines: DataFrame, words: DataFrame, aligned: DataFrame,
                    aligned_words: DataFrame, stats: DataFrame, tracks: DataFrame, key: Sequence[str],
                    now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store an alignment: times on lines that exist, words of those lines replaced, track stats.

    Returns the new (lines, words, tracks). Lines that were not aligned keep times and words.
    """
    key = list(key)
    line_key = [*key, "line_index"]
    # all tables meet by line, in as many tasks as their rows need
    sizes = lines.agg(F.count(F.lit(1)).alias("n"))
    for t in (words, aligned, aligned_words):
        sizes = sizes.unionByName(t.agg(F.count(F.lit(1)).alias("n")))
    rows = sizes.agg(F.sum("n")).first()[0]
    lines, words, aligned, aligned_words = (in_tasks(t, line_key, rows) for t in (lines, words, aligned, aligned_words))
    a = aligned.select(*line_key, *[F.col(c).alias(f"_{c}") for c in ("start", "end", "confidence")],
                       F.lit(True).alias("_hit"))
    new_lines = lines.join(a, line_key, "left")
    hit = F.col("_hit").isNotNull()
    new_lines = new_lines.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c))
                                       for c in ("start", "end", "confidence")}).select(*lines.columns)
    touched = aligned.select(*line_key).join(lines.select(*line_key), line_key, "left_semi")
    new_words = words.join(touched, line_key, "left_anti").unionByName(
        aligned_words.join(touched, line_key, "left_semi").select(*words.columns))
    s = stats.select(*key, F.col("matched_ratio").alias("_r"), F.col("mean_confidence").alias("_m"))
    new_tracks = tracks.join(s, key, "left")
    got = F.col("_r").isNotNull()
    new_tracks = new_tracks.withColumns({
        "matched_ratio": F.when(got, F.col("_r")).otherwise(F.col("matched_ratio")),
        "mean_confidence": F.when(got, F.col("_m")).otherwise(F.col("mean_confidence")),
        "aligned_at": F.when(got, now.cast("timestamp")).otherwise(F.col("aligned_at")),
    }).select(*tracks.columns)
    return new_lines, new_words, new_tracks
