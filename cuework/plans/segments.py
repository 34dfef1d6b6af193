"""Choice of the best time window of every track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.operators.joins import nearest_join
from cuework.operators.ordered import NO_SPLIT, in_tasks, scan, skew_limit, split_hot, totals, unsplit


def select_segments(tracks: DataFrame, frames: DataFrame, beats: DataFrame, onsets: DataFrame,
                    sections: DataFrame, key: Sequence[str], target: float,
                    override: str | None = None, hop: float = fixed.ENERGY_HOP, grid: float = 5.0,
                    snap: float = 0.5, manual_snap: float = 0.35, boundary: float = 4.0,
                    hot_rows: int | None = None) -> DataFrame:
    """One row per track: start, end, score, mode and the parts of the score.

    Short tracks are taken whole, an override is clamped and snapped to a beat, and otherwise every
    section start and grid point is a candidate window. All look-ups of a window are read off two ordered passes per
    track: one over beats and onsets, one over onsets, frames and sections under the snapped window.
    """
    key = list(key)
    hot_rows = skew_limit([frames, beats, onsets, sections], key, hot_rows)
    limit = F.col("duration") - F.lit(float(target))
    t = tracks.withColumn("_limit", limit)
    whole = t.filter("_limit <= 0").select(
        *key, F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.lit(1.0).alias("score"),
        F.lit("whole").alias("mode"))
    long = t.filter("_limit > 0")
    cols = [*key, "start", "end", "score", "mode"]
    out = whole
    if override:
        manual = long.filter(F.col(override).isNotNull()).select(
            *key, "_limit", F.greatest(F.lit(0.0), F.least(F.col(override), F.col("_limit")))
            .alias("_want"))
        manual = nearest_join(manual, beats, key, "_want", "t", manual_snap, name="_beat",
                              hot_rows=hot_rows)
        at = F.when(F.col("_beat.t") <= F.col("_limit"), F.col("_beat.t")).otherwise(F.col("_want"))
        out = out.unionByName(manual.select(*key, at.alias("start"), (at + target).alias("end"),
                                            F.lit(1.0).alias("score"), F.lit("override").alias("mode")))
        long = long.filter(F.col(override).isNull())
    # one candidate for each section start and grid point up to the limit, which every row of the track learns of
    both = long.select(*key, "_limit").unionByName(
        sections.filter("t is not null").select(*key, F.col("t").cast("double").alias("t")), allowMissingColumns=True)
    both = totals(split_hot(both, key, "t", hot_rows), key, {"_most": ("max", "_limit")})
    points = F.transform(F.sequence(F.lit(0), F.floor(F.col("_most") / F.lit(grid)).cast("int")),
                         lambda i: F.bround(i * F.lit(grid), 2))
    here = F.when(F.col("_limit").isNotNull(), points).when(F.col("t") <= F.col("_most"), F.array(F.bround("t", 2)))
    cands = unsplit(both).filter("_most is not null").select(*key, F.col("_most").alias("_limit"), F.explode(here).alias("cand"))
    cands = cands.groupBy(*key, "cand").agg(F.first("_limit").alias("_limit"))

    def rows(df: DataFrame, at: Column, kind: int, **values: Column) -> DataFrame:
        return df.select(*key, at.cast("double").alias("_at"), F.lit(kind).alias("_k"),
                         *[v.alias(n) for n, v in values.items()])

    def probes(df: DataFrame, *ends: Column) -> DataFrame:
        """A row at each of the ends, numbered; the other columns ride on the first."""
        row = F.struct(*[c for c in df.columns if c not in key and c != "cand"])
        at = [F.struct(F.lit(n).alias("n"), e.cast("double").alias("at"), (row if n == 0 else F.when(F.lit(False), row)).alias("row"))
              for n, e in enumerate(ends)]
        return df.select(*key, "cand", F.explode(F.array(*at)).alias("e")).select(
            *key, F.col("e.at").alias("_at"), F.lit(1).alias("_k"), "cand", F.col("e.n").alias("_n"), F.col("e.row").alias("_row"))

    def sweep(tables: list[DataFrame], ahead: dict, back: dict) -> DataFrame:
        """All tables in one order per track: what precedes and follows each probe. At equal times rows of kind 0 come
        before a probe and those of kind 2 after it."""
        df = tables[0]
        for t_ in tables[1:]:
            df = df.unionByName(t_, allowMissingColumns=True)
        df = split_hot(df, key, "_at", hot_rows)
        if hot_rows >= NO_SPLIT:
            df = in_tasks(df, key, size)
        df = scan(df, key, ["_at", "_k"], ahead)
        return unsplit(scan(df, key, ["_at", "_k"], back, reverse=True)).filter("_k = 1")

    def at_end(n: int, c: str) -> Column:
        return F.max(F.when(F.col("_n") == n, F.col(c)))

    def nearest(back: str, ahead: str, at: Column) -> Column:
        first = F.col(ahead).isNull() | (at - F.col(back) <= F.col(ahead) - at)
        return F.when(first, F.col(back)).otherwise(F.col(ahead))

    # a candidate is probed at two and at four places; the sweeps share the number of rows of the larger one
    sizes = [long.select((F.floor(F.col("_limit") / F.lit(grid)) * 4 + 4).alias("n")).agg(F.sum("n").alias("n")),
             sections.agg((F.count(F.lit(1)) * 5).alias("n"))] + [
        t_.agg(F.count(F.lit(1)).alias("n")) for t_ in (frames, onsets, beats)]
    size = sizes[0]
    for t_ in sizes[1:]:
        size = size.unionByName(t_)
    size = int(size.agg(F.sum("n")).first()[0] or 0)

    # first sweep: onsets in the raw window, by which density is scaled, and the nearest beat, to which it snaps
    hits = rows(onsets.filter("t is not null"), F.col("t"), 2, _o=F.lit(1))
    c = sweep([rows(beats.filter("t is not null"), F.col("t"), 0, _b=F.col("t").cast("double")), hits,
               probes(cands, F.col("cand"), F.col("cand") + F.lit(float(target)))],
              {"_pb": ("last", "_b"), "_on": ("count", "_o")}, {"_nb": ("last", "_b")})
    c = c.groupBy(*key, "cand").agg(F.first("_row", ignorenulls=True)["_limit"].alias("_limit"),
                                    (at_end(1, "_on") - at_end(0, "_on")).alias("_raw"), at_end(0, "_pb").alias("_pb"),
                                    at_end(0, "_nb").alias("_nb"))
    beat = nearest("_pb", "_nb", F.col("cand"))
    beat = F.when((F.abs(beat - F.col("cand")) <= F.lit(snap)) & (beat <= F.col("_limit")), beat)
    c = c.select(*key, "cand", F.coalesce(beat, F.col("cand")).alias("start"),
                 (F.max("_raw").over(Window.partitionBy(*key)) / F.lit(float(target))).alias("_dmax"))
    # second sweep: onsets and frames under the snapped window, the nearest section and the one it lies in
    i0, i1 = F.floor(F.col("start") / F.lit(hop)), F.floor((F.col("start") + F.lit(float(target))) / F.lit(hop)) + 1
    named = sections.filter("t is not null")
    part = F.struct(F.col("t").cast("double").alias("t"), "repetition")
    c = sweep([rows(named, F.col("t"), 0, _s=part), hits,
               rows(frames, F.col("frame") * F.lit(float(hop)), 2, _v=F.col("energy").cast("double")),
               probes(c, F.col("start"), F.col("start") + F.lit(float(target)), i0 * F.lit(float(hop)), i1 * F.lit(float(hop)))],
              {"_ps": ("last", "_s"), "_on": ("count", "_o"), "_vn": ("count", "_v"), "_vs": ("sum", "_v")}, {"_ns": ("last", "_s")})
    c = c.groupBy(*key, "cand").agg(
        F.first("_row", ignorenulls=True).alias("_row"), (at_end(1, "_on") - at_end(0, "_on")).alias("_o"),
        (at_end(3, "_vn") - at_end(2, "_vn")).alias("_n"), (at_end(3, "_vs") - at_end(2, "_vs")).alias("_v"),
        at_end(0, "_ps").alias("_sec"), at_end(0, "_ns")["t"].alias("_ahead"))
    c = c.select(*key, "cand", "_row.*", "_o", "_n", "_v", "_sec", "_ahead").withColumns({
        "onset_density": F.col("_o") / F.lit(float(target)),
        # differences of running totals carry noise in the last digits
        "mean_energy": F.when(F.col("_n") > 0, F.bround("_v", 9) / F.col("_n")).otherwise(0.0), "_back": F.col("_sec.t")})
    c = c.withColumn("_near", F.struct(nearest("_back", "_ahead", F.col("start")).alias("t")))
    reps = sections.groupBy(*key).agg(F.min_by("repetition", "t").alias("_first"),
                                      F.max("repetition").alias("_rmax"))
    c = c.join(reps, key, "left")
    rmax = F.when(F.coalesce("_rmax", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_rmax"))
    dmax = F.when(F.coalesce("_dmax", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_dmax"))
    c = c.withColumns({
        "boundary_score": F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs(
            F.col("_near.t") - F.col("start")) / F.lit(boundary)), F.lit(0.0)),
        "repetition_score": F.coalesce(F.coalesce("_sec.repetition", "_first") / rmax, F.lit(0.0)),
    })
    c = c.withColumn("score", 0.40 * F.col("mean_energy") + 0.25 * (F.col("onset_density") / dmax)
                     + 0.20 * F.col("boundary_score") + 0.15 * F.col("repetition_score"))
    best = c.groupBy(*key).agg(F.max(F.struct(
        "score", (-F.col("cand")).alias("neg"), "start", "mean_energy", "onset_density",
        "boundary_score", "repetition_score")).alias("b"))
    best = best.select(*key, "b.*").withColumns({
        "end": F.bround(F.col("start") + F.lit(float(target)), 3),
        "start": F.bround("start", 3), "mode": F.lit("scored")}).drop("neg")
    parts = ["mean_energy", "onset_density", "boundary_score", "repetition_score"]
    return out.select(*cols).unionByName(best.select(*cols, *parts), allowMissingColumns=True)


def segment_reasons(chosen: DataFrame, target: float) -> DataFrame:
    """Add the human-readable reasons of each choice."""
    scored = F.array(
        F.format_string("Chose %.1fs–%.1fs (score %.3f).", "start", "end", "score"),
        F.format_string("Mean energy %.2f (40%% weight), onset density %.2f/s (25%%), "
                        "section-boundary alignment %.2f (20%%), repetition/chorus likelihood "
                        "%.2f (15%%).", "mean_energy", "onset_density", "boundary_score",
                        "repetition_score"),
        F.lit("Start snapped to a beat to avoid clicks; 0.4s fades applied at cut."))
    return chosen.withColumn(
        "reasons", F.when(F.col("mode") == "scored", scored)
        .when(F.col("mode") == "whole", F.array(F.format_string(
            f"Track (%.1fs) is not longer than the requested {target:.0f}s — using the whole "
            "track.", "end")))
        .otherwise(F.array(F.format_string("Manual start override at %.1fs.", "start"))))
