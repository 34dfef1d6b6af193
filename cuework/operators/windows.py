"""Ordered operators over timed rows (line ends, regions, pauses, gaps, spans, thinning).

Every function takes key columns and works on the whole catalogue; keys may be as skewed as they
like because all of them run on the chunked scans of :mod:`cuework.operators.ordered`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.operators.ordered import CHUNK, HOT, is_split, scan, split_hot, totals, unsplit


def infer_line_ends(df: DataFrame, key: Sequence[str], start: str = "start",
                    duration: str | None = None, max_hold: float = 8.0, min_len: float = 0.5,
                    tie: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Add ``end``: the next start, held between ``min_len`` and ``max_hold`` after the start."""
    s = F.col(start)
    out = scan(split_hot(df, key, start, hot_rows, tie), key, [start, *tie],
               {"_next": ("last", start)}, reverse=True)
    stop = [F.col("_next"), s + F.lit(max_hold)]
    if duration:
        stop.insert(1, F.col(duration))
    end = F.greatest(s + F.lit(min_len), F.least(F.coalesce(*stop), s + F.lit(max_hold)))
    return unsplit(out.withColumn("end", end).drop("_next"))


def active_regions(frames: DataFrame, key: Sequence[str], frame: str = "frame",
                   energy: str = "energy", hop: float = fixed.ENERGY_HOP, threshold: float = 0.12,
                   merge_gap: float = 1.2, min_len: float = 0.5, digits: int = 2,
                   hot_rows: int | None = None) -> DataFrame:
    """Loud regions: frames above a share of the key's peak, merged over short gaps."""
    key = list(key)
    df = totals(split_hot(frames.select(*key, frame, energy), key, frame, hot_rows), key,
                {"_peak": ("max", energy)})
    loud = df.filter((F.col("_peak") > 0) & (F.col(energy) > F.col("_peak") * F.lit(threshold)))
    out = scan(loud, key, [frame], {"_prev": ("last", frame)})
    gap = F.col(frame) * F.lit(hop) - (F.col("_prev") + 1) * F.lit(hop)
    out = out.withColumn("_new", F.when(F.col("_prev").isNull() | (gap > merge_gap), 1).otherwise(0))
    out = scan(out, key, [frame], {"_before": ("sum", "_new")})
    runs = (out.groupBy(*key, (F.col("_before") + F.col("_new")).alias("_run"))
            .agg((F.min(frame) * F.lit(hop)).alias("a"), ((F.max(frame) + 1) * F.lit(hop)).alias("b")))
    return (runs.filter(F.col("b") - F.col("a") >= min_len)
            .select(*key, F.bround("a", digits).alias("start"), F.bround("b", digits).alias("end")))


def group_by_pause(words: DataFrame, key: Sequence[str], start: str = "start", end: str = "end",
                   tie: Sequence[str] = (), gap: float = 0.9, max_items: int | None = 8,
                   hot_rows: int | None = None) -> DataFrame:
    """Number the pause-separated groups of a key: adds ``pos``, ``group_index``, ``in_group``."""
    order = [start, *tie]
    df = scan(split_hot(words, key, start, hot_rows, tie), key, order,
              {"_prev": ("last", end), "pos": ("count", F.lit(1))})
    new = F.col("_prev").isNull() | (F.col(start) - F.col("_prev") > F.lit(gap))
    df = df.withColumn("_at", F.when(new, F.col("pos")))
    df = scan(df, key, order, {"_last": ("last", "_at")})
    since = F.col("pos") - F.coalesce(F.col("_at"), F.col("_last"))
    within = since % max_items if max_items else since
    df = df.withColumn("in_group", within)
    df = df.withColumn("_head", F.when(F.col("in_group") == 0, 1).otherwise(0))
    df = scan(df, key, order, {"_heads": ("sum", "_head")})
    df = df.withColumn("group_index", (F.col("_heads") + F.col("_head") - 1).cast("long"))
    return unsplit(df.drop("_prev", "_at", "_last", "_head", "_heads"))


def pause_lines(words: DataFrame, key: Sequence[str], text: str = "text", start: str = "start",
                end: str = "end", tie: Sequence[str] = (), gap: float = 0.9, max_items: int = 8,
                hot_rows: int | None = None) -> DataFrame:
    """The pause groups as lines of text; a group holds at most ``max_items`` words."""
    key = list(key)
    g = group_by_pause(words, key, start, end, tie, gap, max_items, hot_rows)
    lines = g.groupBy(*key, "group_index").agg(
        F.array_sort(F.collect_list(F.struct("in_group", F.col(text).alias("w")))).alias("ws"),
        F.min(start).alias("start"), F.max(end).alias("end"))
    return lines.select(*key, F.col("group_index").alias("line_index"),
                        F.concat_ws(" ", F.col("ws.w")).alias("text"), "start", "end")


def interpolate_gaps(df: DataFrame, key: Sequence[str], order: str = "pos", start: str = "start",
                     end: str = "end", confidence: str = "confidence",
                     hot_rows: int | None = None) -> DataFrame:
    """Spread untimed rows evenly between their timed neighbours; open-ended runs stay NULL.

    Adds ``matched``; filled rows get a fixed low confidence, rows never timed get 0.
    """
    s, e = F.col(start), F.col(end)
    df = split_hot(df, key, order, hot_rows)
    df = scan(df, key, [order], {"_i": ("count", F.lit(1))})
    df = scan(df, key, [order], {"_left": ("last", F.when(s.isNotNull(), F.struct(
        e.alias("t"), F.col("_i").alias("i"))))})
    df = scan(df, key, [order], {"_right": ("last", F.when(s.isNotNull(), F.struct(
        s.alias("t"), F.col("_i").alias("i"))))}, reverse=True)
    n = F.col("_right.i") - F.col("_left.i") - 1
    t0 = F.col("_left.t")
    floor = F.lit(fixed.MIN_WORD_SECONDS)
    t1 = F.when(F.col("_right.t") <= t0, t0 + floor * n).otherwise(F.col("_right.t"))
    step = (t1 - t0) / n
    k = F.col("_i") - F.col("_left.i") - 1
    new_start = t0 + k * step
    inside = s.isNull() & n.isNotNull()
    df = df.withColumns({
        "matched": s.isNotNull(),
        "_s": F.when(inside, new_start).otherwise(s),
        "_e": F.when(inside, F.greatest(new_start + floor, t0 + (k + 1) * step)).otherwise(e),
        "_q": F.when(inside, F.lit(fixed.INTERPOLATED_CONFIDENCE))
               .when(s.isNull(), F.lit(0.0)).otherwise(F.col(confidence)),
    })
    df = df.withColumns({start: F.col("_s"), end: F.col("_e"), confidence: F.col("_q")})
    return unsplit(df.drop("_s", "_e", "_q", "_i", "_left", "_right"))


def clamp_monotonic(df: DataFrame, key: Sequence[str], order: Sequence[str] = ("line_index",),
                    start: str = "start", end: str = "end", words: str | None = None,
                    hot_rows: int | None = None) -> DataFrame:
    """Starts never move back: a row that starts early is moved, with its end and words.

    Adds ``shift`` (0 when the row stays).
    """
    s, e = F.col(start), F.col(end)
    df = scan(split_hot(df, key, order[0], hot_rows), key, order, {"_max": ("max", start)})
    shift = F.when(s < F.col("_max"), F.col("_max") - s)
    df = df.withColumn("_shift", shift)
    moved = F.bround(s + F.col("_shift"), 3)
    has = F.col("_shift").isNotNull()
    old_end = F.when((e.isNotNull()) & (e != 0), e).otherwise(moved)
    cols = {"_s": F.when(has, moved).otherwise(s),
            "_e": F.when(has, F.bround(old_end + F.col("_shift"), 3)).otherwise(e),
            "shift": F.coalesce(F.col("_shift"), F.lit(0.0))}
    if words:
        def move(w):
            new = F.bround(w["start"] + F.col("_shift"), 3)
            stop = F.when(w["end"].isNotNull() & (w["end"] != 0), w["end"]).otherwise(new)
            return F.when(w["start"].isNull(), w).otherwise(
                w.withField("start", new).withField("end", F.bround(stop + F.col("_shift"), 3)))
        cols["_w"] = F.when(has, F.transform(F.col(words), move)).otherwise(F.col(words))
    df = df.withColumns(cols).withColumns({start: F.col("_s"), end: F.col("_e")})
    if words:
        df = df.withColumn(words, F.col("_w")).drop("_w")
    return unsplit(df.drop("_s", "_e", "_shift", "_max"))


def is_monotonic(df: DataFrame, key: Sequence[str], order: Sequence[str] = ("line_index",),
                 start: str = "start", tol: float = 0.05, hot_rows: int | None = None) -> DataFrame:
    """One row per key: do its timed starts never move back by more than ``tol``?"""
    out = scan(split_hot(df, key, order[0], hot_rows), key, order, {"_prev": ("last", start)})
    bad = F.coalesce(F.col(start) < F.col("_prev") - F.lit(tol), F.lit(False))
    return out.groupBy(*key).agg((~F.bool_or(bad)).alias("monotonic"),
                                 F.count_if(bad).alias("backward_jumps"))


def ordinal(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "idx",
            hot_rows: int | None = None) -> DataFrame:
    """Zero-based sequence number within the key."""
    return unsplit(scan(split_hot(df, key, order[0], hot_rows), key, order,
                        {name: ("count", F.lit(1))}))


def split_ambient(df: DataFrame, start: str = "start", end: str = "end",
                  longest: float = fixed.MAX_AMBIENT_SECONDS, unit: float = 1.0) -> DataFrame:
    """Cut each row's interval into equal parts of sane length; ``unit`` is seconds per time unit."""
    length = F.col(end) - F.col(start)
    parts = F.greatest(F.lit(1), F.bround(length / F.lit(longest * unit) + F.lit(0.4), 0)
                       .cast("int"))
    df = df.withColumns({"_p": parts, "_s": F.col(start), "_step": length / parts})
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    return df.withColumns({
        start: F.col("_s") + F.col("part") * F.col("_step"),
        end: F.col("_s") + (F.col("part") + 1) * F.col("_step"),
    }).drop("_p", "_s", "_step")


def carve_spans(lines: DataFrame, segments: DataFrame, key: Sequence[str],
                order: Sequence[str] = ("start", "line_index"), min_gap: float = fixed.MIN_GAP_SECONDS,
                longest: float = fixed.MAX_AMBIENT_SECONDS, min_len: float = 0.5,
                hot_rows: int | None = None) -> DataFrame:
    """Tile every segment with line spans and ambient spans.

    ``lines`` has key, line_index, start, end; ``segments`` has key, segment_start, segment_end.
    Returns key, span_start, span_end, line_index (NULL when ambient), part.
    """
    key = list(key)
    lo, hi = F.col("segment_start"), F.col("segment_end")
    df = (lines.join(segments.select(*key, "segment_start", "segment_end"), key)
          .filter((F.col("end") > lo) & (F.col("start") < hi)))
    # the lead-in of the first line belongs to it, so its start is settled before its end is
    df = scan(split_hot(df, key, order[0], hot_rows), key, order, {"_n": ("count", F.lit(1))})
    first = F.col("_n") == 0
    clipped = F.greatest(lo, F.col("start"))
    a = F.when(first & (clipped - lo < min_gap), lo).otherwise(clipped)
    df = df.withColumn("_a", a)
    df = df.withColumn("_b", F.greatest(F.least(hi, F.col("end")), F.col("_a") + F.lit(min_len)))
    df = scan(df, key, order, {"_cursor": ("last", "_b")})
    df = scan(df, key, order, {"_next": ("last", "_a")}, reverse=True)
    cursor = F.coalesce(F.col("_cursor"), lo)
    last = F.col("_next").isNull()
    tail = hi - F.col("_b")
    step = F.col("_next") - F.col("_b")
    end = (F.when(last, F.when(tail >= min_gap, F.col("_b")).otherwise(hi))
           .when((step > 0) & (step < min_gap), F.col("_next")).otherwise(F.col("_b")))
    # one pass emits the line span and the ambient gaps next to it
    def piece(a, b, line, ambient):
        return F.struct(a.cast("double").alias("span_start"), b.cast("double").alias("span_end"),
                        line.cast("long").alias("line_index"), F.lit(ambient).alias("ambient"))

    none = F.lit(None)
    pieces = F.array(
        piece(F.col("_a"), end, F.col("line_index"), False),
        F.when(F.col("_a") - cursor >= min_gap, piece(cursor, F.col("_a"), none, True)),
        F.when(last & (tail >= min_gap), piece(F.col("_b"), hi, none, True)),
    )
    spans = (df.select(*key, F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p"))
             .select(*key, "p.*"))
    with_lines = df.select(*key).distinct()
    bare = (segments.join(with_lines, key, "left_anti")
            .select(*key, lo.cast("double").alias("span_start"), hi.cast("double").alias("span_end"),
                    F.lit(None).cast("long").alias("line_index"), F.lit(True).alias("ambient")))
    spans = spans.unionByName(bare)
    ambient = split_ambient(spans.filter("ambient"), "span_start", "span_end", longest)
    return (spans.filter(~F.col("ambient")).withColumn("part", F.lit(0))
            .unionByName(ambient).drop("ambient"))


# --- minimum-gap thinning ------------------------------------------------------------------------

def thin_events(df: DataFrame, key: Sequence[str], t: str = "t", gap: float = 1.0,
                head: float | None = None, tail: str | None = None,
                hot_rows: int | None = None) -> DataFrame:
    """Keep a hit only if it is at least ``gap`` after the last kept hit of its key.

    Hits before ``head`` or after the column ``tail`` are ignored. The walk is sequential, so a hot
    key is cut into time chunks: each chunk reports where the walk leaves it for every place it can
    enter (only hits within one gap of its first), those short reports are chained per key, and
    the chunks are then walked in parallel.
    """
    key = list(key)
    hits = df
    if head is not None:
        hits = hits.filter(F.col(t) >= head)
    if tail is not None:
        hits = hits.filter(F.col(t) <= F.col(tail))
    hits = split_hot(hits.select(*key, F.col(t).cast("double").alias("_t")).distinct(), key, "_t",
                     hot_rows)
    schema = hits.schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields
                      if f.name in key)

    def reports(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        ts = pdf["_t"].to_numpy()
        leave = ts.copy()
        for i in range(len(ts) - 1, -1, -1):
            j = i + 1
            j = max(j, int(np.searchsorted(ts, ts[i] + gap)) - 1)
            while j < len(ts) and ts[j] - ts[i] < gap:
                j += 1
            if j < len(ts):
                leave[i] = leave[j]
        n = min(len(ts), int(np.searchsorted(ts, ts[0] + gap)) + 2)
        return pdf.iloc[:n].assign(leave=leave[:n])[[*key, CHUNK, "_t", "leave"]]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], None
        for chunk, part in pdf.sort_values([CHUNK, "_t"]).groupby(CHUNK, sort=True):
            ok = part if last is None else part[part["_t"] - last >= gap]
            if len(ok):
                row = ok.iloc[0]
                rows.append((chunk, row["_t"]))
                last = row["leave"]
            else:
                rows.append((chunk, np.inf))
        out = pd.DataFrame(rows, columns=[CHUNK, "_enter"])
        for k in reversed(key):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    group = [*key, CHUNK] if is_split(hits) else key
    if is_split(hits):
        entries = (hits.filter(F.col(HOT)).groupBy(*group)
                   .applyInPandas(reports, f"{types}, {CHUNK} long, _t double, leave double")
                   .groupBy(*key).applyInPandas(chain, f"{types}, {CHUNK} long, _enter double"))
        hits = hits.join(F.broadcast(entries), group, "left")
    else:
        hits = hits.withColumn("_enter", F.lit(None).cast("double"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = None, None
        for b in batches:
            keep = []
            enter = b["_enter"].to_numpy()
            for n, (at, when) in enumerate(zip(zip(*[b[c] for c in group]), b["_t"].to_numpy())):
                if at != here:
                    here, last = at, None
                if last is None:
                    ok = not when < enter[n]
                else:
                    ok = when - last >= gap
                if ok:
                    keep.append(n)
                    last = when
            yield b.iloc[keep][[*key, "_t"]]

    # sorted rows stream past in batches: no group is ever held as a whole
    rows = hits.repartition(*group).sortWithinPartitions(*group, "_t")
    return rows.mapInPandas(walk, f"{types}, _t double").withColumnRenamed("_t", t)
