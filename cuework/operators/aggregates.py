"""Per-key summaries. All combine map-side, so a hot key costs no more than any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.operators.ordered import HOT_ROWS, NO_SPLIT, range_sums, scan, split_hot, totals, unsplit
from cuework.session import checkpoint


def line_summary(words: DataFrame, key: Sequence[str], start: str = "start", end: str = "end",
                 confidence: str = "confidence") -> DataFrame:
    """Line times over timed words; mean confidence over all words (untimed ones count as 0)."""
    conf = F.coalesce(F.col(confidence), F.lit(0.0))
    timed = F.col(start).isNotNull()
    return words.groupBy(*key).agg(
        F.min(start).alias("start"), F.max(F.when(timed, F.col(end))).alias("end"),
        F.bround(F.when(F.count_if(timed) > 0, F.avg(conf)).otherwise(0.0), 3).alias("confidence"))


def match_stats(words: DataFrame, key: Sequence[str], matched: str = "matched",
                confidence: str = "confidence") -> DataFrame:
    return words.groupBy(*key).agg(
        F.bround(F.avg(F.col(matched).cast("double")), 4).alias("matched_ratio"),
        F.bround(F.avg(F.coalesce(F.col(confidence), F.lit(0.0))), 4).alias("mean_confidence"))


def emotion_totals(df: DataFrame, key: Sequence[str], name: str = "emotion", weight: str = "weight",
                   names: Sequence[str] = tuple(fixed.EMOTIONS)) -> DataFrame:
    """Weighted totals per category, one column each (the category list is given, not collected)."""
    return df.groupBy(*key).agg(*[
        F.sum(F.when(F.col(name) == n, F.col(weight)).otherwise(0.0)).alias(n) for n in names])


def recommend_style(totals_df: DataFrame,
                    first: dict[str, float] | None = None, second: dict[str, float] | None = None,
                    labels: tuple[str, str] = ("archiveCollage", "doodleMemory"),
                    ratio: float = 1.15) -> DataFrame:
    """Choose between two weighted sums; the second must win by ``ratio``."""
    first = first or {"melancholy": 1, "loneliness": 1, "longing": 1, "nostalgia": 0.5}
    second = second or {"love": 1, "joy": 1, "calm": 1, "hope": 1, "nostalgia": 0.5}

    def weigh(ws: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for n, w in ws.items():
            out = out + F.coalesce(F.col(n), F.lit(0.0)) * F.lit(float(w))
        return out

    df = totals_df.withColumns({"_a": weigh(first), "_b": weigh(second)})
    total = F.col("_a") + F.col("_b")
    none = total <= 0
    wins = F.col("_b") > F.col("_a") * F.lit(ratio)
    return df.withColumns({
        "recommended_style": F.when(~none & wins, labels[1]).otherwise(labels[0]),
        "recommendation_confidence": F.when(none, 0.0).otherwise(
            F.bround(F.when(wins, F.col("_b")).otherwise(F.col("_a")) / F.nullif(total, F.lit(0.0)),
                     3)),
        "recommendation_reason": F.when(
            none, F.lit("no emotional signal; defaulting to Archive Collage")).when(
            wins, F.format_string("warm/domestic emotions dominate (%.1f vs %.1f)", "_b", "_a"))
        .otherwise(F.format_string("melancholic/longing emotions lead (%.1f vs %.1f)", "_a", "_b")),
    }).drop("_a", "_b")


def rms_envelope(samples: DataFrame, key: Sequence[str], t: str = "t", value: str = "value",
                 hop: float = fixed.ENERGY_HOP, hot_rows: int | None = None) -> DataFrame:
    """RMS per hop, and the same scaled by the key's loudest hop."""
    key = list(key)
    x = F.col(value)
    frames = (samples.groupBy(*key, F.floor(F.col(t) / F.lit(hop)).alias("frame"))
              .agg(F.sqrt(F.avg(x * x)).alias("rms")))
    frames = totals(split_hot(frames, key, "frame", hot_rows), key, {"_peak": ("max", "rms")})
    return unsplit(frames.withColumn(
        "energy", F.when(F.col("_peak") > 0, F.col("rms") / F.col("_peak")).otherwise(F.col("rms")))
        .drop("_peak"))


CUTS = 256  # ranges of values in a round of the selection
FEW_KEYS = 10_000  # so many hot keys at most are sent to every task


def median(df: DataFrame, key: Sequence[str], value: str, name: str = "median",
           hot_rows: int | None = None) -> DataFrame:
    """Exact median per key, and ``<name>_n``, the number of its values; NULLs don't count.

    Keys of ordinary size are one aggregate, combined on the map side. Of keys with more than ``hot_rows`` values only
    counts are gathered: :func:`select_ranks` narrows the range that holds the middle, so neither many values nor many
    equal ones meet in a task.
    """
    key = list(key)
    hot_rows = hot_rows or HOT_ROWS
    d = df.filter(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    plain = lambda x: x.groupBy(*key).agg(F.percentile("_v", 0.5).alias(name), F.count("_v").alias(f"{name}_n"))
    if hot_rows >= NO_SPLIT:
        return plain(d)
    # NULL keys compare equal here
    same = lambda t: F.lit(True) if not key else _all([d[k].eqNullSafe(t[f"_k{i}"]) for i, k in enumerate(key)])
    hot = checkpoint(d.groupBy(*key).agg(F.count("_v").alias("_n")).filter(F.col("_n") > hot_rows).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_n"))
    keys = hot.count()
    if not keys:
        return plain(d)
    small = F.broadcast(hot) if keys <= FEW_KEYS else hot
    rows = checkpoint(d.join(small, same(hot), "left_semi"))
    ranks = hot.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], "_n", F.explode(
        F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))).alias("_rank")).distinct()
    found = select_ranks(rows, key, ranks, keys)
    return plain(d.join(small, same(hot), "left_anti")).unionByName(
        found.groupBy(*key).agg(F.avg("_v").alias(name), F.max("_n").alias(f"{name}_n")))


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def select_ranks(rows: DataFrame, key: Sequence[str], ranks: DataFrame, keys: int) -> DataFrame:
    """``ranks`` (key, ``_rank`` from 0, further columns) with ``_v``, the value of that rank among the key's rows.

    Each round cuts the range in which a rank is sought at approximate quantiles, counts the values in each part
    (combined on the map side, with the least and greatest one) and goes on in the part that holds the rank, until that
    part has a single value. ``keys`` is the number of keys; ``rows`` are scanned once for the cuts and once for the
    counts of a round.
    """
    key = list(key)
    target = [*key, "_rank"]
    extra = [c for c in ranks.columns if c not in target]
    todo = ranks.withColumns({"_low": F.lit(float("-inf")), "_high": F.lit(float("inf")), "_before": F.lit(0).cast("long")})
    done = None
    while True:
        here = todo.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_rank", "_low", "_high", "_before")
        here = F.broadcast(here) if keys <= FEW_KEYS else here
        on = _all([rows[k].eqNullSafe(here[f"_k{i}"]) for i, k in enumerate(key)])
        inside = rows.join(here, on).where("_v >= _low AND _v <= _high").select(*target, "_v", "_before")
        cuts = inside.groupBy(*target).agg(F.percentile_approx(
            "_v", [i / CUTS for i in range(1, CUTS)], 100 * CUTS).alias("_cut"))
        cuts = checkpoint(cuts.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(target)], "_cut"))
        cut = F.broadcast(cuts) if keys <= FEW_KEYS else cuts
        part = inside.join(cut, _all([inside[c].eqNullSafe(cut[f"_c{i}"]) for i, c in enumerate(target)]))
        # a value that is a cut has a part of its own
        place = F.size(F.filter("_cut", lambda x: x < F.col("_v"))) + F.size(F.filter("_cut", lambda x: x <= F.col("_v")))
        counts = part.withColumn("_p", place).groupBy(*target, "_p").agg(
            F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_before").alias("_b"))
        upto = Window.partitionBy(*target).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = counts.withColumn("_upto", F.col("_b") + F.sum("_m").over(upto)).where(
            (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_m"))).select(
            *target, "_low", "_high", (F.col("_upto") - F.col("_m")).alias("_before"))
        hit = checkpoint(hit)
        ready = hit.where("_low = _high").select(*target, F.col("_low").alias("_v"))
        done = ready if done is None else done.unionByName(ready)
        todo = hit.where("_low < _high")
        if todo.isEmpty():
            break
    left = ranks.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(target)], *extra)
    return done.join(left, _all([done[c].eqNullSafe(left[f"_c{i}"]) for i, c in enumerate(target)])).select(
        *target, *extra, "_v")


def robust_drift(df: DataFrame, key: Sequence[str], drift: str = "drift", lines: str | None = None,
                 max_mad: float = 4.0, share: float = 0.25, hot_rows: int | None = None
                 ) -> DataFrame:
    """Median drift and its median absolute deviation, with the reason a key is not trusted.

    ``lines`` names a per-key line count (default: the number of drifts); a key needs at least
    ``max(2, share of its lines)`` drifts.
    """
    key = list(key)
    extra = [lines] if lines else []
    med = median(df, key, drift, "drift_median", hot_rows)
    with_med = df.filter(F.col(drift).isNotNull()).select(*key, drift, *extra).join(med, key)
    dev = with_med.withColumn("_dev", F.abs(F.col(drift) - F.col("drift_median")))
    mad = median(dev, key, "_dev", "mad", hot_rows).drop("mad_n")
    if lines:
        med = med.join(df.groupBy(*key).agg(F.max(lines).alias("_lines")), key)
    else:
        med = med.withColumn("_lines", F.col("drift_median_n"))
    need = F.greatest(F.lit(2), F.floor(F.lit(share) * F.col("_lines")))
    return med.join(mad, key).withColumns({
        "need": need.cast("long"),
        "rejected": F.when(F.col("drift_median_n") < need, F.lit("too few drifts"))
                     .when(F.col("mad") > max_mad, F.lit("drifts disagree")),
    }).withColumnRenamed("drift_median_n", "n_drifts").drop("_lines")


def reject_drift(df: DataFrame, stats: DataFrame, key: Sequence[str], drift: str = "drift",
                 tol: float = 3.0) -> DataFrame:
    """Flag rows whose drift is too far from the key's median, and keys left with too few rows."""
    key = list(key)
    d = df.join(stats.select(*key, "drift_median", "need", "rejected"), key, "left")
    d = d.withColumn("outlier", F.abs(F.col(drift) - F.col("drift_median")) > tol)
    left = d.groupBy(*key).agg(F.count_if(~F.col("outlier")).alias("kept"))
    return d.join(left, key).withColumn(
        "fall_back", F.col("rejected").isNotNull() | F.coalesce(F.col("kept") < F.col("need"),
                                                               F.lit(True)))


def estimate_offset(spans: DataFrame, frames: DataFrame, key: Sequence[str],
                    hop: float = fixed.ENERGY_HOP, search: float = 8.0, step: float = 0.1,
                    threshold: float = 0.15, hot_rows: int | None = None) -> DataFrame:
    """Global shift of the spans under which most of their frames are loud.

    ``spans`` has start and end, ``frames`` has frame and energy; a frame without a row is silent. Returns offset,
    best_score, zero_score.

    A span covers a frame for an unbroken run of shifts. These runs, one for each span and frame in reach, are merged
    per frame, and their two ends become events; events add up per shift, and running sums over the shifts of a key give
    all scores. So the rows before any aggregate depend on the length of the spans and the reach of the search, not on
    the number of shifts, and keys of any size spread over their frames. (``hot_rows`` is not needed and kept for callers.)
    """
    key = list(key)
    steps = int(round(search / step))
    size = frames.groupBy(*key).agg(F.max("energy").alias("_peak"),
                                    (F.max("frame") + 1).alias("_frames")).filter("_peak > 0")
    loud = frames.join(size, key).where(F.col("energy") > F.col("_peak") * F.lit(threshold)).select(
        *key, F.col("frame").cast("long").alias("frame"), F.lit(1).alias("_loud"))

    def at(x: Column, k: Column) -> Column:
        return F.bround((x + F.bround(k * F.lit(step), 2)) / F.lit(hop), 0).cast("long")

    def last_shift(x: Column, f: Column) -> Column:
        """Greatest shift that leaves ``x`` at frame ``f`` or before: near the real solution, tried with its rounding."""
        near = F.floor(((f + 0.5) * F.lit(hop) - x) / F.lit(step))
        out = near - 2
        for d in (-1, 0, 1, 2):
            out = F.when(at(x, near + d) <= f, near + d).otherwise(out)
        return out

    reach = F.lit(float(steps) * step + step)
    first = F.greatest(F.lit(0), F.floor((F.col("start") - reach) / F.lit(hop)) - 1)
    final = F.least(F.col("_frames") - 1, F.ceil((F.col("end") + reach) / F.lit(hop)) + 1)
    runs = (spans.filter("start is not null and end is not null").join(size, key)
            .where(first <= final).select(*key, "start", "end", F.explode(F.sequence(first, final)).alias("frame"))
            .select(*key, "frame", F.greatest(F.lit(-steps), last_shift(F.col("end"), F.col("frame")) + 1).alias("lo"),
                    F.least(F.lit(steps), last_shift(F.col("start"), F.col("frame"))).alias("hi"))
            .where("lo <= hi").select(*key, "frame", F.struct("lo", "hi").alias("_run")))
    # the runs of a frame are pairs of shifts: however many spans there are, only so many differ
    per_frame = runs.unionByName(loud, allowMissingColumns=True).groupBy(*key, "frame").agg(
        F.array_sort(F.collect_set("_run")).alias("_runs"), F.coalesce(F.max("_loud"), F.lit(0)).alias("_loud"))
    merged = per_frame.where(F.size("_runs") > 0).withColumn("_runs", F.expr(
        "aggregate(_runs, cast(array() AS array<struct<lo: bigint, hi: bigint>>), (a, r) -> CASE "
        "WHEN size(a) > 0 AND r.lo <= element_at(a, -1).hi + 1 THEN concat(slice(a, 1, size(a) - 1), "
        "array(named_struct('lo', element_at(a, -1).lo, 'hi', greatest(element_at(a, -1).hi, r.hi)))) "
        "ELSE concat(a, array(named_struct('lo', r.lo, 'hi', r.hi))) END)"))
    events = merged.select(*key, "_loud", F.explode("_runs").alias("r")).select(*key, "_loud", F.explode(F.array(
        F.struct(F.col("r.lo").alias("k"), F.lit(1).alias("d")), F.struct((F.col("r.hi") + 1).alias("k"), F.lit(-1).alias("d")))).alias("e"))
    changes = events.groupBy(*key, F.col("e.k").alias("_k")).agg(
        F.sum("e.d").alias("_all"), F.sum(F.col("e.d") * F.col("_loud")).alias("_hit"))
    upto = Window.partitionBy(*key).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*key).orderBy("_k")
    scored = changes.select(*key, "_k", F.sum("_all").over(upto).alias("_n"), F.sum("_hit").over(upto).alias("_h"),
                            F.lead("_k").over(after).alias("_next")).where("_n > 0").select(
        *key, "_k", "_next", (F.col("_h") / F.col("_n")).alias("score"))
    # scores stay as they are up to the next event, so the first shift of such a stretch stands for it;
    # the zero shift stands unless another strictly beats it, and among equals the smallest comes first
    best = scored.groupBy(*key).agg(
        F.max(F.struct("score", (-F.col("_k")).alias("neg"))).alias("best"),
        F.max(F.when((F.col("_k") <= 0) & (F.col("_next") > 0), F.col("score"))).alias("zero"))
    zero = F.coalesce(F.col("zero"), F.lit(0.0))
    beats = F.coalesce(F.col("best.score") > zero, F.lit(False))
    shift = F.bround(-F.col("best.neg") * F.lit(step), 2)
    found = best.select(*key, F.when(beats, shift).otherwise(0.0).alias("offset"),
                        F.bround(F.when(beats, F.col("best.score")).otherwise(zero), 3)
                        .alias("best_score"), F.bround(zero, 3).alias("zero_score"))
    return (spans.select(*key).distinct().join(found, key, "left")
            .na.fill(0.0, ["offset", "best_score", "zero_score"]))


def accept_offset(df: DataFrame, min_offset: float = 0.3, min_score: float = 0.55,
                  min_gain: float = 0.1) -> DataFrame:
    ok = ((F.abs("offset") >= min_offset) & (F.col("best_score") >= min_score)
          & (F.col("best_score") - F.col("zero_score") >= min_gain))
    return df.withColumn("applied", F.when(ok, F.col("offset")).otherwise(0.0))


def apply_offset(spans: DataFrame, accepted: DataFrame, key: Sequence[str],
                 columns: Sequence[str] = ("start", "end")) -> DataFrame:
    """Shift the timed spans of every key by its accepted offset."""
    out = spans.join(accepted.select(*key, "applied"), list(key), "left")
    by = F.coalesce(F.col("applied"), F.lit(0.0))
    return out.withColumns({c: F.col(c) + by for c in columns}).drop("applied")


def plan_summary(scenes: DataFrame, key: Sequence[str], lyric: str = "lyric") -> DataFrame:
    return scenes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.count_if(F.col(lyric).isNotNull() & (F.col(lyric) != "")).alias("lyric_scene_count"))


def ordered_distinct(df: DataFrame, key: Sequence[str], col: str, order: str,
                     limit: int | None = None) -> DataFrame:
    """Distinct values in order of first appearance: one row per value with its rank.

    ``limit`` keeps the first values of each key, for capped lists.
    """
    key = list(key)
    first = df.groupBy(*key, col).agg(F.min(order).alias("first_at"))
    ranked = unsplit(scan(split_hot(first, key, "first_at", ties=[col]), key, ["first_at", col],
                          {"rank": ("count", F.lit(1))}))
    return ranked.filter(F.col("rank") < limit) if limit else ranked


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in the given order (a partial minimum, not a window)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*keys, "_r.*").select(*df.columns)


def quality_counts(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Uncertain and untranslated lines per key."""
    c = F.col("confidence")
    return lines.groupBy(*key).agg(
        F.count_if(c.isNotNull() & (c < fixed.UNCERTAIN_BELOW)).alias("uncertain_lines"),
        F.count_if(F.coalesce(F.trim("translation"), F.lit("")) == "").alias("untranslated_lines"))


def cleanup_totals(doomed: DataFrame, size: str = "bytes") -> DataFrame:
    return doomed.agg(F.count(F.lit(1)).alias("items"),
                      F.coalesce(F.sum(size), F.lit(0)).alias("bytes_freed"))


def beat_period(tempo: Column) -> Column:
    return F.greatest(F.lit(0.45), F.least(F.lit(1.4), F.lit(60.0) / F.greatest(F.lit(40.0), tempo)))


def onset_density(onsets: DataFrame, windows: DataFrame, key: Sequence[str], t: str = "t",
                  start: str = "start", length: str = "length", window_id: Sequence[str] = ("start",),
                  hot_rows: int | None = None) -> DataFrame:
    """Points per second in each window, and the same over the key's densest window."""
    key = list(key)
    w = windows.withColumn("_stop", F.col(start) + F.col(length))
    out = range_sums(onsets, w, key, t, None, start, "_stop", window_id, hot_rows)
    out = out.withColumn("density", F.col("n") / F.col(length)).drop("_stop", "total")
    out = totals(split_hot(out, key, start, hot_rows), key, {"max_density": ("max", "density")})
    return unsplit(out.withColumn("relative_density", F.when(
        F.col("max_density") > 0, F.col("density") / F.col("max_density")).otherwise(
        F.col("density"))))
