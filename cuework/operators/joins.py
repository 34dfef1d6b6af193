"""Joins: lexicon, fuzzy, nearest, interval, duplicate, tag and rollup joins.

Nothing here is a theta join. Nearest-value and range questions are answered by ordered scans,
interval questions by equi-joins on time buckets, similarity questions by equi-joins on keys that
are proven to catch every match.
"""

from __future__ import annotations

import difflib
import itertools
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuework.functions import fixed_values as fixed
from cuework.functions import text as tx
from cuework.functions.hashing import hamming
from cuework.operators.ordered import range_sums, scan, split_hot, unsplit
from cuework.session import checkpoint

LEXICON_SCHEMA = ("stem string, subjects array<string>, emotions array<struct<name:string,"
                  "weight:double>>, queries array<string>")


# --- lexicon -----------------------------------------------------------------------------------

def lexicon(spark: SparkSession, rows: Sequence[tuple] = tuple(fixed.LEXICON)) -> DataFrame:
    """The lexicon as a DataFrame (a local relation, so its size is known)."""
    return spark.createDataFrame(
        [(stem, subjects, [(n, float(w)) for n, w in emotions.items()], queries)
         for stem, subjects, emotions, queries in rows], LEXICON_SCHEMA)


SMALL_LEXICON = 2000


def lexicon_join(tokens: DataFrame, lex: DataFrame, key: Sequence[str], token: str = "token",
                 pos: str = "pos") -> DataFrame:
    """Longest stem each token starts with; stems under 3 letters need the whole token.

    For lexicons of any size: prefixes of every distinct token, up to the length of the longest stem,
    meet the stems in an equi-join, and the tokens that have a stem are joined back. Returned are
    (key, stem, pos); ``pos`` numbers the stems of a key from 0 by first occurrence.
    """
    t = F.col(token)
    # read twice below: only what starts like a stem is kept, so that texts are cut into words once
    heads = lex.select(F.left("stem", F.lit(2)).alias("_head")).filter(F.length("_head") == 2).distinct()
    tokens = checkpoint(tokens.select(*key, pos, token).join(
        F.broadcast(heads), F.left(t, F.lit(2)) == F.col("_head"), "left_semi"))
    max_len = lex.agg(F.max(F.length("stem"))).first()[0] or 0
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(
        F.length(t), F.lit(max_len)))), lambda n: F.left(t, n))
    words = tokens.select(t).distinct()
    cand = (words.select(t, F.explode(prefixes).alias("stem"))
            .filter((F.length("stem") >= 3) | (F.col("stem") == t)))
    best = cand.join(lex.select("stem"), "stem").groupBy(token).agg(
        F.max_by("stem", F.length("stem")).alias("stem"))
    first = tokens.join(best, token).groupBy(*key, "stem").agg(
        F.min(pos).alias(pos))
    # a key has at most one row for each stem here
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(pos)) - 1
    return first.withColumn(pos, turn.cast("int"))


def matched_stems(df: DataFrame, lex: DataFrame, key: Sequence[str], col: str, name: str = "stems"
                  ) -> DataFrame | None:
    """Stems of each text in order of first occurrence, found in one pass inside the row.

    Only for lexicons of at most :data:`SMALL_LEXICON` stems, else None: the stems become one
    pattern tried at every word start, grouped by first letter and longest first.
    """
    stems = [r[0] for r in lex.select("stem").distinct().limit(SMALL_LEXICON + 1).collect()]
    if len(stems) > SMALL_LEXICON:
        return None
    by_letter: dict[str, list[str]] = {}
    for s in sorted(stems, key=lambda s: (-len(s), s)):
        by_letter.setdefault(s[0], []).append(
            rf"\Q{s[1:]}\E" + ("" if len(s) >= 3 else r"(?!\S)"))
    heads = "|".join(rf"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))
    found = F.regexp_extract_all(tx.semantic_norm(col), F.lit(rf"(?<!\S)(?:{heads})"), F.lit(0))
    return df.select(*key, F.array_distinct(found).alias(name))


def lexicon_match(df: DataFrame, lex: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """Stems of each text (key, stem, pos); ``pos`` numbers them from 0 by first occurrence.

    A small lexicon is matched inside the row, without a shuffle; a large one by
    :func:`lexicon_join`, with the same result.
    """
    rows = matched_stems(df, lex, key, col)
    if rows is None:
        return lexicon_join(text_tokens(df, key, col), lex, key)
    return tx.positions(rows, key, F.col("stems"), "pos", "stem")


def text_tokens(df: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """Distinct tokens of a text with the position where each first occurs."""
    return tx.positions(df, key, F.array_distinct(tx.semantic_words(col)), "pos", "token")


def extract_semantics(df: DataFrame, key: Sequence[str], col: str, lex: DataFrame,
                      names: Sequence[str] = tuple(fixed.EMOTIONS)) -> DataFrame:
    """Subjects (6), phrases (5), matched stems and emotion shares of each text.

    ``key`` identifies a row. What is gathered per key is at most one entry per lexicon stem.
    """
    key = list(key)
    hit = lexicon_match(df, lex, key, col).join(lex, "stem")
    per = hit.groupBy(*key).agg(F.array_sort(F.collect_list(
        F.struct("pos", "stem", "subjects", "emotions", "queries"))).alias("h"))
    flat = per.select(*key, F.col("h.stem").alias("matched"),
                      F.array_distinct(F.flatten("h.subjects")).alias("_s"),
                      F.array_distinct(F.flatten("h.queries")).alias("_q"),
                      F.flatten("h.emotions").alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e["weight"])

    def weight_of(name: str) -> Column:
        return F.aggregate(F.filter("_e", lambda e: e["name"] == name), F.lit(0.0),
                           lambda a, e: a + e["weight"])

    flat = flat.withColumn("_t", total).select(
        *key, "matched", F.slice("_s", 1, 6).alias("subjects"), F.slice("_q", 1, 5).alias("_q"),
        *[F.when(F.col("_t") > 0, F.bround(weight_of(n) / F.col("_t"), 3)).otherwise(0.0).alias(n)
          for n in names])
    empty = F.array().cast("array<string>")
    generic = F.array(*map(F.lit, fixed.GENERIC_QUERIES))
    out = df.select(*key).distinct().join(flat, key, "left")
    return out.select(
        *key, F.coalesce("subjects", empty).alias("subjects"),
        F.when(F.size(F.coalesce("_q", empty)) > 0, F.col("_q")).otherwise(generic).alias("queries"),
        F.coalesce("matched", empty).alias("matched"),
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


# --- fuzzy entity match ---------------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def ratio_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings; 0 when either is empty."""
    def one(x: str, y: str) -> float:
        return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(
        1.0 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def duration_match(want: Column, have: Column) -> tuple[Column, Column, Column]:
    """(whether both lengths are known, their difference, its share of the score)."""
    known = (F.coalesce(want, F.lit(0.0)) != 0) & (F.coalesce(have, F.lit(0.0)) != 0)
    delta = F.abs(have - want)
    return known, delta, F.when(known, F.greatest(F.lit(0.0), 1.0 - delta / 15.0)).otherwise(0.5)


def match_score(title_sim: Column, artist_sim: Column, duration_score: Column, synced: Column, long_enough: Column,
                instrumental: Column) -> Column:
    """Score of a candidate; it rises with each similarity, so bounds of those bound it."""
    score = (0.35 * title_sim + 0.25 * artist_sim + 0.20 * duration_score
             + 0.15 * F.when(synced, 1.0).otherwise(0.0) + 0.05 * F.when(long_enough, 1.0).otherwise(0.2))
    return F.when(instrumental, score * 0.1).otherwise(score)


def score_matches(pairs: DataFrame, measure: str = "ratio",
                  min_score: float = fixed.MIN_MATCH_SCORE) -> DataFrame:
    """Score request/candidate pairs already side by side.

    Request columns: want_artist, want_title, want_duration. Candidate columns: artist, title,
    duration, plain_text, lrc_text, instrumental. Adds score and reasons, drops hopeless pairs.
    """
    sim = ratio_similarity if measure == "ratio" else levenshtein_similarity
    df = pairs.withColumns({
        "_t": tx.normalize_title("title"), "_wt": tx.normalize_title("want_title"),
        "_a": tx.normalize_title("artist"), "_wa": tx.normalize_title("want_artist")})
    df = df.withColumns({"title_sim": sim(F.col("_t"), F.col("_wt")),
                         "_as": sim(F.col("_a"), F.col("_wa"))})
    asked = tx.text_or_empty("want_artist") != ""
    known, delta, duration_score = duration_match(F.col("want_duration"), F.col("duration"))
    synced = F.length(tx.strip(tx.text_or_empty("lrc_text"))) > 0
    body = F.when(tx.text_or_empty("plain_text") != "", F.col("plain_text")).otherwise(
        tx.text_or_empty("lrc_text"))
    long_enough = F.length(tx.strip(body)) >= 80
    instrumental = F.coalesce(F.col("instrumental"), F.lit(False))
    df = df.withColumns({
        "artist_sim": F.when(asked, F.col("_as")).otherwise(0.5),
        "duration_score": duration_score,
    })
    score = match_score(F.col("title_sim"), F.col("artist_sim"), F.col("duration_score"), synced, long_enough,
                        instrumental)
    df = df.withColumn("score", score)
    quote = F.lit("'")
    reasons = F.filter(F.array(
        F.concat(F.format_string("title match %.2f (", "title_sim"), quote, F.col("title"), quote,
                 F.lit(")")),
        F.when(asked, F.concat(F.format_string("artist match %.2f (", "artist_sim"), quote,
                               F.col("artist"), quote, F.lit(")")))
        .otherwise("no artist requested; neutral artist score"),
        F.when(known, F.format_string("duration off by %.1fs", delta))
        .otherwise("duration unknown; neutral duration score"),
        F.when(synced, "has synchronized (LRC) timings"),
        F.when(~long_enough & ~instrumental, "suspiciously short lyrics body"),
        F.when(instrumental, "marked instrumental")), lambda r: r.isNotNull())
    return (df.filter(F.col("score") >= min_score).withColumn("reasons", reasons)
            .drop("_t", "_wt", "_a", "_wa", "_as"))


def match_candidates(requests: DataFrame, candidates: DataFrame, key: Sequence[str],
                     measure: str = "ratio", min_score: float = fixed.MIN_MATCH_SCORE) -> DataFrame:
    """Score every candidate gathered for a request (both carry ``key``)."""
    want = requests.select(*key, F.col("artist").alias("want_artist"),
                           F.col("title").alias("want_title"),
                           F.col("duration").alias("want_duration"))
    return score_matches(candidates.join(want, list(key)), measure, min_score)


def similar_titles(left: DataFrame, right: DataFrame, title: str = "title",
                   min_jaccard: float = 0.5) -> DataFrame:
    """Pairs of distinct normalised titles sharing at least ``min_jaccard`` of their words.

    Used to gather candidates from a shared catalogue (join it back on the normalised title). Equal
    titles are matched as one, and words are joined rarest first: two titles this similar must
    share a word among the first ``n - ceil(min_jaccard * n) + 1`` of either, so common words
    hardly ever become join keys and no pair is lost.
    """
    def titles(df: DataFrame) -> DataFrame:
        t = df.select(tx.normalize_title(title).alias("t")).filter("t <> ''").distinct()
        return t.withColumn("ws", F.array_distinct(F.split("t", " ")))

    a, b = titles(left), titles(right)
    freq = (a.unionByName(b).select(F.explode("ws").alias("w"))
            .groupBy("w").agg(F.count(F.lit(1)).alias("n")))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        ranked = (df.select("t", F.explode("ws").alias("w")).join(freq, "w")
                  .groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("o")))
        size = F.size("o")
        take = size - F.ceil(F.lit(min_jaccard) * size).cast("int") + 1
        return ranked.select(F.col("t").alias(name), F.col("o.w").alias(f"{name}_ws"),
                             F.explode(F.slice(F.col("o.w"), F.lit(1), take)).alias("w"))

    common = F.size(F.array_intersect("left_title_ws", "right_title_ws"))
    union = F.size("left_title_ws") + F.size("right_title_ws") - common
    return (prefix(a, "left_title").join(prefix(b, "right_title"), "w")
            .withColumn("jaccard", common / union).filter(F.col("jaccard") >= min_jaccard)
            .select("left_title", "right_title", "jaccard").distinct())


# --- nearest value --------------------------------------------------------------------------------

def nearest_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_t: str = "t",
                 right_t: str = "t", tol: float | None = None, payload: Sequence[str] = (),
                 name: str = "nearest", hot_rows: int | None = None) -> DataFrame:
    """Add the key's nearest right value (NULL beyond ``tol``); the earlier one wins a tie.

    One ordered pass each way over both tables together. ``payload`` columns of the right row come
    along as struct fields of ``name``, next to ``t``.
    """
    key = list(key)
    info = F.struct(F.col(right_t).cast("double").alias("t"), *payload)
    pts = right.filter(F.col(right_t).isNotNull()).select(
        *key, F.col(right_t).cast("double").alias("_at"), F.lit(0).alias("_k"), info.alias("_p"))
    probes = left.select(*key, F.col(left_t).cast("double").alias("_at"), F.lit(1).alias("_k"),
                         F.struct(*[c for c in left.columns if c not in key]).alias("_row"))
    both = split_hot(pts.unionByName(probes, allowMissingColumns=True), key, "_at", hot_rows)
    both = scan(both, key, ["_at", "_k"], {"_prev": ("last", "_p")})
    both = scan(both, key, ["_at", "_k"], {"_next": ("last", "_p")}, reverse=True)
    back, ahead = F.col("_at") - F.col("_prev.t"), F.col("_next.t") - F.col("_at")
    best = F.when(ahead.isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    out = both.filter("_k = 1").withColumn("_best", best)
    if tol is not None:
        out = out.withColumn("_best", F.when(
            F.abs(F.col("_best.t") - F.col("_at")) <= F.lit(tol), F.col("_best")))
    return out.select(*key, "_row.*", F.col("_best").alias(name))


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_t: str, right_t: str,
              payload: Sequence[str], name: str = "asof", hot_rows: int | None = None) -> DataFrame:
    """Add the key's last right row at or before each left time, as a struct."""
    key = list(key)
    pts = right.select(*key, F.col(right_t).cast("double").alias("_at"), F.lit(0).alias("_k"),
                       F.struct(F.col(right_t).cast("double").alias("t"), *payload).alias("_p"))
    probes = left.select(*key, F.col(left_t).cast("double").alias("_at"), F.lit(1).alias("_k"),
                         F.struct(*[c for c in left.columns if c not in key]).alias("_row"))
    both = split_hot(pts.unionByName(probes, allowMissingColumns=True), key, "_at", hot_rows)
    both = scan(both, key, ["_at", "_k"], {"_prev": ("last", "_p")})
    return both.filter("_k = 1").select(*key, "_row.*", F.col("_prev").alias(name))


# --- points in intervals ---------------------------------------------------------------------------

def points_in_spans(points: DataFrame, spans: DataFrame, key: Sequence[str], t: str = "t",
                    start: str = "start", end: str = "end", base: float = 1.0) -> DataFrame:
    """All (point, span) pairs of a key with ``start <= t < end``.

    Spans meet points in an equi-join on (key, level, bucket). The bucket width doubles with the
    level and a span uses the first level at least as wide as itself, so it touches two buckets
    however long it is; points are repeated once per level in use. The levels are the only thing
    gathered (at most 64 numbers).
    """
    key = list(key)
    length = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1e-9)) / F.lit(base)))
                       ).cast("int")
    s = spans.filter(length > 0).withColumn("_lv", level)
    levels = sorted(r[0] for r in s.select("_lv").distinct().collect())
    width = F.pow(F.lit(2.0), F.col("_lv")) * F.lit(base)
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width),
                                                F.floor(F.col(end) / width))))
    p = points.withColumn("_lv", F.explode(F.array(*map(F.lit, levels or [0]))))
    p = p.withColumn("_b", F.floor(F.col(t) / width))
    hit = p.join(s, [*key, "_lv", "_b"])
    return hit.filter((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("_lv", "_b")


def relative_points(points: DataFrame, spans: DataFrame, key: Sequence[str], span_id: Sequence[str],
                    t: str = "t", **kw) -> DataFrame:
    """Times of the points inside each span, counted from its start and rounded to 3 digits."""
    hit = points_in_spans(points.select(*key, t), spans.select(*key, *span_id, "start", "end"), key,
                          t, **kw)
    return hit.select(*key, *span_id, F.bround(F.col(t) - F.col("start"), 3).alias("rel"))


def overlap_join(spans: DataFrame, regions: DataFrame, key: Sequence[str], span_id: Sequence[str],
                 min_overlap: float = 0.3, base: float = 1.0) -> DataFrame:
    """Hull of each span's overlaps with the key's regions; NULL when none is long enough.

    Two intervals overlap when one starts inside the other, so two point-in-interval joins with
    disjoint results find every pair once.
    """
    key, span_id = list(key), list(span_id)
    a = spans.select(*key, *span_id, "start", "end")
    r = regions.select(*key, F.col("start").alias("_rs"), F.col("end").alias("_re"))
    inside = points_in_spans(r, a, key, "_rs", base=base)
    later = points_in_spans(a, r, key, "start", "_rs", "_re", base=base).filter(
        F.col("start") > F.col("_rs"))
    both = inside.unionByName(later)
    lo, hi = F.greatest("start", "_rs"), F.least("end", "_re")
    hull = (both.filter(hi - lo >= F.lit(min_overlap)).groupBy(*key, *span_id)
            .agg(F.min(lo).alias("overlap_start"), F.max(hi).alias("overlap_end")))
    return spans.join(hull, [*key, *span_id], "left")


def mean_energy(frames: DataFrame, spans: DataFrame, key: Sequence[str], span_id: Sequence[str],
                hop: float = fixed.ENERGY_HOP, default: float = 0.5, name: str = "mean_energy",
                hot_rows: int | None = None) -> DataFrame:
    """Mean energy of the frames under each span (at least one frame); ``default`` when empty."""
    i0 = F.floor(F.col("start") / F.lit(hop))
    s = spans.withColumns({"_i0": i0, "_i1": F.greatest(i0 + 1, F.floor(F.col("end") / F.lit(hop)))})
    out = range_sums(frames, s, key, "frame", "energy", "_i0", "_i1", span_id, hot_rows)
    return out.withColumn(name, F.when(F.col("n") > 0, F.col("total") / F.col("n"))
                          .otherwise(F.lit(default))).drop("n", "total", "_i0", "_i1")


def sample_timeline(spans: DataFrame, hits: DataFrame, key: Sequence[str], step: float,
                    variants: int, hot_rows: int | None = None) -> DataFrame:
    """At every ``step``: the active span (the key's last one when none) and which variant shows.

    ``spans`` (key, span_index, start, end) do not overlap; ``hits`` (key, t) are absolute times.
    """
    key = list(key)
    ends = spans.groupBy(*key).agg(F.max("end").alias("_stop"),
                                   F.max(F.struct("span_index", "start", "end")).alias("_final"))
    n = F.greatest(F.lit(0), F.ceil(F.col("_stop") / F.lit(step)).cast("int") - 1)
    samples = ends.select(*key, "_final", F.explode(F.sequence(F.lit(0), n)).alias("sample"))
    samples = samples.withColumns({"_at": F.col("sample") * F.lit(step), "_k": F.lit(2)})
    # at equal times the span comes first, so a hit at its start counts for it
    s = spans.select(*key, F.col("start").cast("double").alias("_at"), F.lit(0).alias("_k"),
                     F.struct("span_index", "start", "end").alias("_span"))
    h = hits.select(*key, F.col("t").cast("double").alias("_at"), F.lit(1).alias("_k"),
                    F.lit(1).alias("_hit"))
    both = h.unionByName(s, allowMissingColumns=True).unionByName(samples, allowMissingColumns=True)
    both = scan(split_hot(both, key, "_at", hot_rows), key, ["_at", "_k"],
                {"_hits": ("count", "_hit"), "_cur": ("last", "_span")})
    both = both.withColumn("_base", F.when(F.col("_k") == 0, F.col("_hits")))
    both = scan(both, key, ["_at", "_k"], {"_from": ("last", "_base")})
    live = F.col("_cur").isNotNull() & (F.col("_at") < F.col("_cur.end"))
    return both.filter("_k = 2").select(
        *key, "sample", F.col("_at").alias("t"),
        F.when(live, F.col("_cur.span_index")).otherwise(F.col("_final.span_index"))
        .alias("span_index"),
        F.when(live, F.pmod(F.col("_hits") - F.col("_from"), F.lit(variants))).otherwise(0)
        .cast("int").alias("variant"))


# --- overlays and rescues ---------------------------------------------------------------------------

def apply_corrections(lines: DataFrame, edits: DataFrame, key: Sequence[str],
                      columns: Sequence[str] = ("corrected_text", "translation")) -> DataFrame:
    """Edits replace the stored values; an empty edit clears, a missing column is left alone.

    ``edits`` holds key and some of ``columns``; NULL in it means "not edited".
    """
    named = [c for c in columns if c in edits.columns]
    e = edits.select(*key, *[F.col(c).alias(f"_{c}") for c in named])
    out = lines.join(e, list(key), "left")
    for c in named:
        new = F.nullif(tx.strip(F.col(f"_{c}")), F.lit(""))
        out = out.withColumn(c, F.when(F.col(f"_{c}").isNotNull(), new).otherwise(F.col(c)))
    return out.drop(*[f"_{c}" for c in named])


def merge_fallback(aligned: DataFrame, seeds: DataFrame, key: Sequence[str],
                   min_confidence: float = 0.45) -> DataFrame:
    """Lines without a trustworthy time take the seed span, their words spread evenly.

    ``aligned``: key, start, end, confidence, words (array of text/start/end/confidence).
    ``seeds``: key, seed_start, seed_end. Adds ``rescued``.
    """
    df = aligned.join(seeds.select(*key, "seed_start", "seed_end"), list(key), "left")
    fb = F.lit(fixed.FALLBACK_CONFIDENCE)
    need = F.col("seed_start").isNotNull() & ~F.coalesce(
        (F.col("confidence") >= min_confidence) & F.col("start").isNotNull(), F.lit(False))
    a = F.col("seed_start")
    b = F.greatest(F.coalesce(F.nullif(F.col("seed_end"), F.lit(0.0)), a + 3.0), a + 0.8)
    df = df.withColumns({"rescued": need, "_a": a, "_b": b})
    step = (F.col("_b") - F.col("_a")) / F.greatest(F.size("words"), F.lit(1))
    spread = F.transform("words", lambda w, i: w.withField("start", F.bround(F.col("_a") + i * step, 3))
                         .withField("end", F.bround(F.col("_a") + (i + 1) * step, 3))
                         .withField("confidence", fb))
    df = df.withColumns({
        "start": F.when(need, F.col("_a")).otherwise(F.col("start")),
        "end": F.when(need, F.col("_b")).otherwise(F.col("end")),
        "confidence": F.when(need, fb).otherwise(F.col("confidence")),
        "words": F.when(need, spread).otherwise(F.col("words"))})
    return df.drop("_a", "_b", "seed_start", "seed_end")


def positional_join(rows: DataFrame, pasted: DataFrame, key: Sequence[str], order: str,
                    text: str = "text", name: str = "translation",
                    hot_rows: int | None = None) -> DataFrame:
    """The i-th pasted line goes to the i-th row of the key; a blank line clears it.

    Rows past the last pasted line keep what they have.
    """
    key = list(key)
    lines = pasted.select(*key, F.posexplode(tx.lines_of(text)).alias("_i", "_new"))
    df = scan(split_hot(rows, key, order, hot_rows), key, [order], {"_i": ("count", F.lit(1))})
    df = unsplit(df).withColumn("_i", F.col("_i").cast("int"))
    out = df.join(lines, [*key, "_i"], "left")
    old = F.col(name) if name in rows.columns else F.lit(None).cast("string")
    return out.withColumn(name, F.when(F.col("_new").isNotNull(), F.nullif("_new", F.lit("")))
                          .otherwise(old)).drop("_i", "_new")


# --- duplicates ---------------------------------------------------------------------------------------

def agreeing_bands(hashes: int, threshold: int, bits: int = 64, most: int = 6) -> int:
    """How many bands should agree so that joining ``hashes`` random hashes makes the fewest rows.

    A choice of ``agree`` out of ``threshold + agree`` bands is a key of some bits; every hash has a row for each choice
    and meets the hashes of its key. More bands mean more choices and longer keys, so the best number grows with the
    logarithm of the hashes and the rows for each of them hardly grow at all.
    """
    def rows(agree: int) -> float:
        bands = threshold + agree
        return math.comb(bands, agree) * (1 + hashes / 2 ** (bits // bands * agree))
    return min(range(1, most + 1), key=rows)


def near_duplicates(df: DataFrame, hash_col: str, threshold: int = fixed.DUPLICATE_BITS,
                    key: Sequence[str] = (), bits: int = 64, agree: int | None = None) -> DataFrame:
    """Pairs of **distinct** hashes within ``threshold`` bits, lossless.

    Copies with equal hashes count as one hash (see :func:`hash_groups`), so a large group of
    copies yields one row, not its square. The bits are cut into ``threshold + agree`` bands; two
    hashes this close agree on at least ``agree`` of them, so an equi-join on every choice of
    ``agree`` bands meets all pairs. A pair is kept only at the first choice it agrees on. How many should
    agree follows from an approximate count of the hashes (of the largest key), if it is not given.
    """
    key = list(key)
    h = F.col(hash_col)
    one = df.filter(h.isNotNull()).select(*key, h.alias("h")).distinct()
    if agree is None:
        size = one.groupBy(*key).agg(F.approx_count_distinct("h").alias("n")).agg(F.max("n")).first()[0]
        agree = agreeing_bands(size or 1, threshold, bits)
    bands = threshold + agree
    edges = [round(i * bits / bands) for i in range(bands + 1)]

    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    band = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    spark = df.sparkSession
    choices = spark.createDataFrame([(signed(sum(c)),) for c in itertools.combinations(band, agree)], "m long")

    def met(h: Column, m: Column) -> Column:
        return F.xxhash64(m, h.bitwiseAND(m))

    # a row for each choice: made by a join, as an expression for each would fill the driver, and by all tasks, as Spark
    # takes the rows for as few as the hashes are (for which it would broadcast them, too)
    keyed = (one.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h").crossJoin(F.broadcast(choices))
             .select(*key, "h", met(F.col("h"), F.col("m")).alias("b")))
    left = keyed.withColumnRenamed("h", "hash_a")
    right = keyed.withColumnRenamed("h", "hash_b")
    pairs = left.hint("merge").join(right, [*key, "b"]).filter("hash_a < hash_b")
    pairs = pairs.withColumn("distance", hamming("hash_a", "hash_b")).filter(
        F.col("distance") <= threshold)
    # the choice of the first bands that agree; other choices, and keys that clash, have another hash
    x = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    same = F.filter(F.array(*[F.lit(signed(m)).cast("long") for m in band]), lambda m: x.bitwiseAND(m) == 0)
    first = F.aggregate(F.slice(same, 1, agree), F.lit(0).cast("long"), lambda acc, m: acc.bitwiseOR(m))
    return pairs.filter(F.col("b") == met(F.col("hash_a"), first)).select(*key, "hash_a", "hash_b", "distance")


def hash_groups(df: DataFrame, hash_col: str, id_col: str, key: Sequence[str] = ()) -> DataFrame:
    """One row per distinct hash: its smallest id and how many copies share it."""
    return (df.filter(F.col(hash_col).isNotNull()).groupBy(*key, hash_col)
            .agg(F.min(id_col).alias("representative"), F.count(F.lit(1)).alias("copies")))


# --- tags, references, flags, rollups --------------------------------------------------------------------

def best_tag_match(df: DataFrame, key: Sequence[str], subjects: str, index: str,
                   library: dict[str, Sequence[str]] | None = None,
                   synonyms: dict[str, str] | None = None) -> DataFrame:
    """The library entry sharing most tags with the subjects; ties rotate by index; none is NULL.

    The library is a fixed small table, so scoring stays inside the row: no shuffle at all.
    """
    library = library or fixed.TAG_LIBRARY
    synonyms = fixed.TAG_SYNONYMS if synonyms is None else synonyms
    pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
    swap = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    subj = F.transform(F.coalesce(F.col(subjects), F.array().cast("array<string>")),
                       lambda s: F.coalesce(F.element_at(swap, F.lower(s)), F.lower(s)))
    df = df.withColumn("_s", subj)

    def shared(tags: Sequence[str]) -> Column:
        return F.size(F.filter("_s", lambda s: s.isin(list(tags))))

    scored = F.array(*[F.struct(shared(tags).alias("n"), F.lit(name).alias("name"))
                       for name, tags in sorted(library.items())])
    df = df.withColumn("_scored", scored)
    top = F.array_max(F.transform("_scored", lambda x: x["n"]))
    df = df.withColumn("_best", F.filter("_scored", lambda x: (x["n"] == top) & (x["n"] > 0)))
    pick = F.when(F.size("_best") > 0, F.element_at(
        "_best", (F.col(index) % F.greatest(F.size("_best"), F.lit(1)) + 1).cast("int"))["name"])
    return df.select(*key, pick.alias("best_tag"), F.when(F.size("_best") > 0, top).otherwise(0)
                     .alias("overlap"))


def anti_join_refs(df: DataFrame, *refs: DataFrame,
                   on: Sequence[str] = ("job_id", "provider", "provider_ref")) -> DataFrame:
    """Drop rows whose reference is in any of the given tables."""
    for r in refs:
        df = df.join(r.select(*on), list(on), "left_anti")
    return df


def existence_flags(df: DataFrame, key: Sequence[str], **tables: DataFrame) -> DataFrame:
    """One boolean per named table: does it hold the key?"""
    for name, t in tables.items():
        mark = t.select(*key).distinct().withColumn(name, F.lit(True))
        df = df.join(mark, list(key), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def nest_children(parent: DataFrame, child: DataFrame, key: Sequence[str], order: Sequence[str],
                  name: str = "children", page_rows: int = 10_000, descending: bool = False,
                  hot_rows: int | None = None) -> DataFrame:
    """Parents with their children as an ordered array, in pages of at most ``page_rows``.

    ``order`` may be of any type that can be sorted; equal children come in any order. (key, page) is the
    key of the result: nearly every parent is one row (``page`` 0), one with very many children continues on
    further rows instead of one array that no task could hold. Childless parents get an empty array.
    """
    key = list(key)
    rest = [c for c in child.columns if c not in key]
    c = scan(split_hot(child, key, order[0], hot_rows), key, order, {"_pos": ("count", F.lit(1))},
             reverse=descending)
    pages = unsplit(c).groupBy(*key, F.floor(F.col("_pos") / page_rows).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.struct(*rest).alias("v")))).alias("_v"))
    pages = pages.select(*key, "page", F.transform("_v", lambda x: x["v"]).alias(name))
    kind = pages.schema[name].dataType.simpleString()
    return (parent.join(pages, key, "left")
            .withColumns({name: F.coalesce(name, F.array().cast(kind)),
                          "page": F.coalesce("page", F.lit(0))}))


def token_overlap(a: Column, b: Column) -> Column:
    """Relevance of two token sets: shared tokens / 4, at most 1."""
    return F.least(F.lit(1.0), F.size(F.array_intersect(a, b)) / 4.0)
