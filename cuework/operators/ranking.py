"""Ranking, capped lists, explicit orders, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions import predicates as pr
from cuework.functions import text as tx
from cuework.operators.aggregates import dedupe_first
from cuework.operators.joins import token_overlap
from cuework.operators.ordered import scan, split_hot, unsplit


def top_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int,
          name: str = "rank") -> DataFrame:
    """First ``n`` rows of each key. Spark trims every partition to ``n`` before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def rank_candidates(scored: DataFrame, key: Sequence[str], n: int = 5, score: str = "score",
                    input_pos: str = "input_pos") -> DataFrame:
    """Best ``n`` candidates per key, best first; ties stay in input order."""
    return top_n(scored, key, [F.col(score).desc(), F.col(input_pos).asc()], n)


def rank_all(scored: DataFrame, key: Sequence[str], score: str = "score",
             input_pos: str = "input_pos", hot_rows: int | None = None) -> DataFrame:
    """Rank of every row of a key, best first (1-based), for keys of any size."""
    df = scored.withColumn("_neg", -F.col(score))
    df = scan(split_hot(df, key, "_neg", hot_rows, [input_pos]), key, ["_neg", input_pos],
              {"rank": ("count", F.lit(1))})
    return unsplit(df.withColumn("rank", F.col("rank") + 1).drop("_neg"))


def nearest(col: Column | str, digits: int) -> Column:
    """The nearest multiple of 10 ** -digits, halves up, of a number that is not negative; all in doubles."""
    x = (F.col(col) if isinstance(col, str) else col) * float(10 ** digits)
    return (F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)) / float(10 ** digits)


def media_score(scene: Column, cand: Column) -> dict[str, Column]:
    """Columns relevance, orientation, headroom, resolution, provider_pref of a media candidate, given the token sets of
    its scene and itself."""
    w, h = F.col("width"), F.col("height")
    relevance = token_overlap(scene, cand)
    orientation = F.when(h > w, 1.0).when(h == w, 0.6).otherwise(0.35)
    headroom = (F.when(F.col("kind") == "photo", F.least(w / 1080.0, h / 1920.0))
                .when(h > w, h / 1920.0).otherwise(h / 1080.0))
    resolution = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (headroom - 0.8) / 1.2))
    pref = F.lit(0.7)
    for name, v in fixed.PROVIDER_PREFERENCE.items():
        pref = F.when(F.col("provider") == name, v).otherwise(pref)
    return {
        "relevance": relevance, "orientation": orientation, "headroom": headroom,
        "resolution": resolution, "provider_pref": pref,
    }


def rank_media(candidates: DataFrame, scenes: DataFrame, key: Sequence[str],
               input_pos: str = "input_pos", hot_rows: int | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """(accepted candidates with score, reasons and rank, rejected candidates with the reason).

    ``scenes`` has one row per key: queries, subjects, lyric, scene_duration. Scores that agree to nine digits are ties,
    which stay in input order.
    """
    # one token set for each scene and each candidate, used by all that follows
    words = tx.token_set(F.concat_ws(" ", "queries", "subjects", F.coalesce("lyric", F.lit(""))))
    df = candidates.withColumn("_c", tx.token_set(F.concat_ws(" ", "tags", "query"))).join(
        scenes.select(*key, words.alias("_s"), F.col("scene_duration").alias("_d")), list(key))
    df = df.withColumn("reject_reason", pr.reject_reason(F.col("_d")))
    rejected = df.filter(F.col("reject_reason").isNotNull()).drop("_c", "_s", "_d")
    ok = df.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    ok = ok.withColumns(media_score(F.col("_s"), F.col("_c")))
    # products of two decimals are decimals again, not what doubles make of them
    ok = ok.withColumn("score", 0.45 * F.col("relevance") + F.round(0.25 * F.col("orientation"), 9)
                       + 0.20 * F.col("resolution") + F.round(0.10 * F.col("provider_pref"), 9))
    ok = ok.withColumn("reasons", F.array(
        F.format_string("relevance %.2f (%d shared terms)", "relevance",
                        F.size(F.array_intersect("_s", "_c"))),
        F.when(F.col("height") > F.col("width"), "portrait orientation")
        .when(F.col("height") == F.col("width"), "square (needs framing)")
        .otherwise("landscape (needs crop/fill adaptation)"),
        F.format_string("resolution headroom %.2fx", "headroom")))
    ok = ok.drop("_c", "_s", "_d").withColumn("_even", nearest("score", 9))
    return rank_all(ok, key, "_even", input_pos, hot_rows).drop("_even"), rejected


def order_with_override(df: DataFrame, picks: DataFrame, key: Sequence[str], item: str,
                        order: str, pick_pos: str = "pick_pos",
                        hot_rows: int | None = None) -> DataFrame:
    """Picked items first in pick order, the rest after them in their own order (``place``)."""
    key = list(key)
    p = picks.groupBy(*key, item).agg(F.min(pick_pos).alias("_pick"))
    d = df.join(p, [*key, item], "left").withColumn("_tier", F.when(
        F.col("_pick").isNotNull(), 0).otherwise(1))
    d = d.withColumn("_in", F.coalesce(F.col("_pick").cast("double"), F.col(order).cast("double")))
    d = d.withColumn("_tier", F.col("_tier").cast("double"))
    out = scan(split_hot(d, [*key, "_tier"], "_in", hot_rows), [*key, "_tier"], ["_in"],
               {"_n": ("count", F.lit(1))})
    first = d.filter("_tier = 0").groupBy(*key).agg(F.count(F.lit(1)).alias("_picked"))
    out = unsplit(out).join(first, key, "left")
    place = F.col("_n") + F.when(F.col("_tier") == 1, F.coalesce("_picked", F.lit(0))).otherwise(0)
    return out.withColumn("place", place).drop("_pick", "_tier", "_in", "_n", "_picked")


def list_newest(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order])


def cap_list(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return top_n(df, key, order, n, "_rn").drop("_rn")


def union_providers(providers: Sequence[tuple[str, DataFrame]], keys: Sequence[str],
                    order: Sequence[str], failures: DataFrame | None = None) -> DataFrame:
    """Union in preference order, first occurrence of each key kept.

    ``order`` is the order within a provider. ``failures`` (provider, failed_at) names the query
    position at which a provider broke down: its rows from there on are left out, earlier ones stay.
    """
    parts = []
    for n, (name, df) in enumerate(providers):
        parts.append(df.withColumns({"source": F.lit(name), "preference": F.lit(n)}))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    if failures is not None:
        f = failures.select(F.col("provider").alias("source"), "failed_at")
        both = (both.join(f, "source", "left")
                .filter(F.col("failed_at").isNull() | (F.col(order[0]) < F.col("failed_at")))
                .drop("failed_at"))
    return dedupe_first(both, keys, ["preference", *order])


def keep_set(*tables: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in any of the tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()
