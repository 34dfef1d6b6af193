"""Alignment of reference lines to a transcript.

Matching is a walk along one track, so it runs as one small Python function per track
(``cogroup().applyInArrow``); tracks are independent and spread over the cluster by key.
Everything before and after the walk is columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions import text as tx
from cuework.operators import aggregates as agg
from cuework.operators.joins import merge_fallback
from cuework.operators.ordered import skew_limit
from cuework.operators.windows import clamp_monotonic, interpolate_gaps
from cuework.session import checkpoint

WORD = "struct<text:string,start:double,end:double,confidence:double>"
ARROW_WORDS = pa.list_(pa.field("element", pa.struct([
    ("text", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("confidence", pa.float64())])))


@lru_cache(1 << 16)
def _norm(token: str) -> str:
    t = unicodedata.normalize("NFKD", token or "")
    return re.sub(r"\W+", "", "".join(c for c in t if not unicodedata.combining(c)).lower())


def _shared(want: list[str], norms: list[str], ids: np.ndarray, vocab: dict[str, int], first: int, stop: int,
            least: float) -> Iterator[tuple[int, float]]:
    """(start, share of the wanted words present) of every window that holds at least the share ``least``.

    ``ids`` are the places of ``norms`` in ``vocab``. How many words of a window are wanted at all, read off running
    totals, rules most windows out; only in the others every word is counted as often as it is wanted.
    """
    if first >= stop:
        return
    n, need = len(want), Counter(want)
    wanted = np.zeros(len(vocab) + 1, dtype=np.int64)
    wanted[[vocab.get(w, len(vocab)) for w in need]] = 1
    total = np.concatenate(([0], np.cumsum(wanted[ids[first:stop - 1 + n]])))
    for i in np.flatnonzero((total[n:] - total[:-n]) / n >= least).tolist():
        have = Counter(w for w in norms[first + i:first + i + n] if w in need)
        common = sum(min(c, need[w]) for w, c in have.items())
        if common / n >= least:
            yield first + i, common / n


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy()


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def align_tokens(tokens: DataFrame, asr: DataFrame, key: Sequence[str],
                 hot_rows: int | None = None) -> DataFrame:
    """Match tokens to the transcript by matching blocks, then fill the gaps between anchors.

    ``tokens``: key, line_index, word_index, raw, norm. ``asr``: key, pos, text, start, end, prob. The keys are counted
    in ``tokens``: counting matched rows would match everything twice.
    """
    key = list(key)
    hot_rows = skew_limit([tokens], key, hot_rows, growth=1)

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("line_index", "ascending"), ("word_index", "ascending")])
        right = right.sort_by("pos")
        took = {c: np.full(len(left), np.nan) for c in ("start", "end", "confidence")}
        given = {"start": _numbers(right["start"]), "end": _numbers(right["end"]),
                 "confidence": _numbers(right["prob"].fill_null(1.0))}
        m = SequenceMatcher(None, left["norm"].to_pylist(), [_norm(t) for t in right["text"].to_pylist()],
                            autojunk=False)
        for block in m.get_matching_blocks():
            for c, values in took.items():
                values[block.a:block.a + block.size] = given[c][block.b:block.b + block.size]
        out = left.append_column("pos", pa.array(np.arange(len(left), dtype=np.int64)))
        for c, values in took.items():
            out = out.append_column(c, pa.array(values))
        return out

    cols = [*key, "line_index", "word_index", "raw", "norm"]
    schema = _ddl(tokens, cols) + ", pos long, start double, end double, confidence double"
    found = (tokens.select(*cols).groupBy(*key)
             .cogroup(asr.select(*key, "pos", "text", "start", "end", "prob").groupBy(*key))
             .applyInArrow(match, schema))
    nan = {c: F.when(~F.isnan(c), F.col(c)) for c in ("start", "end", "confidence")}
    return interpolate_gaps(found.withColumns(nan), key, "pos", hot_rows=hot_rows)


def align_lyrics(lines: DataFrame, asr: DataFrame, key: Sequence[str], text: str = "text",
                 hot_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines with times and confidence, words, stats per track) from token alignment."""
    key = list(key)
    tokens = checkpoint(tx.tokenize_lines(lines, key, text, exact=True))
    words = checkpoint(align_tokens(tokens, asr, key, hot_rows))
    summary = agg.line_summary(words, [*key, "line_index"])
    out = (lines.select(*key, "line_index", F.col(text).alias("text"))
           .join(summary, [*key, "line_index"], "left").na.fill({"confidence": 0.0}))
    stats = lines.select(*key).distinct().join(agg.match_stats(words, key), key, "left").na.fill(
        {"matched_ratio": 0.0, "mean_confidence": 0.0})
    words = words.select(*key, "line_index", "word_index", F.col("raw").alias("text"), "start",
                         "end", F.bround("confidence", 3).alias("confidence"), "matched")
    return out, words, stats


def align_monotonic(lines: DataFrame, asr: DataFrame, key: Sequence[str], text: str = "text",
                    min_ratio: float = 0.45, good: float = 0.72, reach: int = 400) -> DataFrame:
    """Bind each line to the next place in the transcript that reads like it.

    The cursor only moves forward, so repeated lines take successive occurrences. Returns key,
    line_index, text, start, end, confidence, words.
    """
    key = list(key)

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("line_index")
        heard = right.sort_by("pos")
        norms = [_norm(t) for t in heard["text"].to_pylist()]
        vocab = {w: i for i, w in enumerate(dict.fromkeys(norms))}
        ids = np.fromiter((vocab[w] for w in norms), dtype=np.int64, count=len(norms))
        starts, ends = _numbers(heard["start"]), _numbers(heard["end"])
        cursor, rows = 0, []
        for line in left["text"].to_pylist():
            raws = [w for w in (line or "").split() if _norm(w)]
            want = [_norm(w) for w in raws]
            top, at = 0.0, None
            if want:
                stop = min(len(norms), cursor + reach) - len(want) + 1
                for j, most in _shared(want, norms, ids, vocab, cursor, stop, min_ratio):
                    # no window can reach more than the share of words it holds
                    if most <= top and most < good:
                        continue
                    r = SequenceMatcher(None, want, norms[j:j + len(want)], autojunk=False).ratio()
                    if r > top or r >= good:
                        top, at = r, j
                    if r >= good:
                        break
            if at is None or top < min_ratio:
                rows.append((None, None, 0.0, [
                    {"text": w, "start": None, "end": None, "confidence": 0.0} for w in raws]))
                continue
            took = list(range(at, at + len(want)))
            conf = round(top, 3)
            a = float(starts[at])
            b = max(float(max(ends[i] for i in took)), a + 0.5)
            rows.append((a, b, conf, [
                {"text": w, "start": float(starts[i]), "end": float(ends[i]), "confidence": conf}
                for w, i in zip(raws, took)]))
            cursor = at + len(took)
        out = left
        for c, i, kind in (("start", 0, pa.float64()), ("end", 1, pa.float64()), ("confidence", 2, pa.float64()),
                           ("words", 3, ARROW_WORDS)):
            out = out.append_column(c, pa.array([r[i] for r in rows], kind))
        return out

    src = lines.select(*key, "line_index", F.col(text).alias("text"))
    schema = _ddl(src, src.columns) + f", start double, end double, confidence double, " \
                                      f"words array<{WORD}>"
    out = (src.groupBy(*key).cogroup(asr.select(*key, "pos", "text", "start", "end").groupBy(*key))
           .applyInArrow(walk, schema))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("start", "end")})


def word_times(raws: Column, given: Column, start: Column, end: Column, confidence: Column) -> Column:
    """Words of a line with times: the given starts when there is one per word, else even spread.

    ``given`` is an array of structs (text, start), NULL when unknown.
    """
    def spread(v: Column) -> Column:
        ws, tags, conf = v["raws"], v["given"], v["confidence"]
        by_tag = F.transform(ws, lambda w, i: F.struct(
            w.alias("text"), F.bround(F.get(tags, i)["start"], 3).alias("start"),
            F.bround(F.greatest(F.coalesce(F.get(tags, i + 1)["start"], v["end"]),
                                F.get(tags, i)["start"] + 0.12), 3).alias("end"),
            conf.alias("confidence")))
        even = F.transform(ws, lambda w, i: F.struct(
            w.alias("text"), F.bround(v["start"] + i * v["step"], 3).alias("start"),
            F.bround(v["start"] + (i + 1) * v["step"], 3).alias("end"), conf.alias("confidence")))
        use = tags.isNotNull() & (F.size(tags) == F.size(ws)) & (F.size(ws) > 0)
        return F.when(use, by_tag).otherwise(even)

    parts = tx.let(F.struct(raws.alias("raws")), lambda v: F.struct(
        v["raws"].alias("raws"), given.alias("given"), start.cast("double").alias("start"),
        end.cast("double").alias("end"), confidence.alias("confidence"),
        ((end - start) / F.greatest(F.size(v["raws"]), F.lit(1))).cast("double").alias("step")))
    return tx.let(parts, spread).cast(f"array<{WORD}>")


def _sung_words(text: str) -> Column:
    return F.filter(tx.words_of(text), lambda w: tx.normalize_token(w) != "")


def align_from_spans(lines: DataFrame, spans: DataFrame, key: Sequence[str], text: str = "text",
                     word_spans: DataFrame | None = None,
                     confidence: float = fixed.FALLBACK_CONFIDENCE) -> DataFrame:
    """The whole timeline from given spans; lines without one stay untimed.

    ``spans``: key, line_index, start, end. ``word_spans``: key, line_index, words (array of
    text/start).
    """
    key = list(key)
    lk = [*key, "line_index"]
    df = lines.select(*lk, F.col(text).alias("text")).join(
        spans.select(*lk, F.col("start").alias("_a"), F.col("end").alias("_b")), lk, "left")
    if word_spans is not None:
        df = df.join(word_spans.select(*lk, F.col("words").alias("_ws")), lk, "left")
    else:
        df = df.withColumn("_ws", F.lit(None).cast("array<struct<text:string,start:double>>"))
    a = F.col("_a")
    b = F.greatest(F.coalesce(F.col("_b"), a + 3.0), a + 0.8)
    df = df.withColumns({"_raws": _sung_words("text"), "_end": b})
    timed = a.isNotNull()
    conf = F.lit(float(confidence))
    blank = F.transform("_raws", lambda w: F.struct(
        w.alias("text"), F.lit(None).cast("double").alias("start"),
        F.lit(None).cast("double").alias("end"), F.lit(0.0).alias("confidence"))).cast(
        f"array<{WORD}>")
    return df.select(
        *lk, "text", F.when(timed, F.bround(a, 3)).alias("start"),
        F.when(timed, F.bround("_end", 3)).alias("end"),
        F.when(timed, conf).otherwise(0.0).alias("confidence"),
        F.when(timed, word_times(F.col("_raws"), F.col("_ws"), a, F.col("_end"), conf))
        .otherwise(blank).alias("words"))


def align_hybrid(lines: DataFrame, spans: DataFrame, asr: DataFrame, key: Sequence[str],
                 text: str = "text", word_spans: DataFrame | None = None,
                 trust_min: float = fixed.TRUST_MIN, drift_tol: float = 3.0, max_mad: float = 4.0,
                 hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Transcript timing where it can be trusted, the given spans elsewhere.

    Returns (lines with times, confidence, words; stats per key with line_match_ratio,
    mean_confidence and mode: "transcript", "hybrid" or "spans"). The choice is one row per key,
    so every key takes its own way through the same plan.
    """
    key = list(key)
    lk = [*key, "line_index"]
    hot_rows = skew_limit([lines], key, hot_rows)
    # the walk is the costly step and is read several times below
    heard = checkpoint(align_monotonic(lines, asr, key, text))
    sp = spans.filter("start is not null").select(*lk, F.col("start").alias("span_start"),
                                                  F.col("end").alias("span_end"))
    df = heard.join(sp, lk, "left")
    usable = F.col("start").isNotNull() & (F.col("confidence") >= 0.45) & F.col(
        "span_start").isNotNull()
    df = df.withColumn("drift", F.when(usable, F.col("start") - F.col("span_start")))
    per = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_lines"), F.count("start").alias("_matched"),
        F.sum("confidence").alias("_conf"), F.count("span_start").alias("_spans"),
        F.count("drift").alias("_drifts"))
    drift = agg.robust_drift(df, key, "drift", max_mad=max_mad, hot_rows=hot_rows).select(
        *key, "drift_median", "mad")
    per = per.join(drift, key, "left")
    df = df.join(per, key)
    df = df.withColumn("_out", F.abs(F.col("drift") - F.col("drift_median")) > drift_tol)
    kept = df.groupBy(*key).agg(F.count_if(~F.col("_out")).alias("_kept"))
    need = F.greatest(F.lit(2), F.floor(F.col("_lines") * 0.25))
    mode = (F.when(F.col("_spans") == 0, "transcript")
            .when((F.col("_matched") / F.col("_lines") < trust_min) | (F.col("_drifts") < need)
                  | (F.col("mad") > max_mad) | (F.col("_kept") < need), "spans")
            .otherwise("hybrid"))
    choice = per.join(kept, key).withColumn("mode", mode)
    df = df.join(choice.select(*key, "mode", "_kept"), key)
    lost = F.col("_out") & (F.col("mode") == "hybrid")
    lost = F.coalesce(lost, F.lit(False))
    own = df.withColumns({
        "words": F.when(lost, F.transform("words", lambda w: w.withField(
            "start", F.lit(None).cast("double")).withField("end", F.lit(None).cast("double"))
            .withField("confidence", F.lit(0.0)))).otherwise(F.col("words")),
        "_s": F.when(~lost, F.col("start")), "_e": F.when(~lost, F.col("end")),
        "confidence": F.when(lost, 0.0).otherwise(F.col("confidence"))})
    own = own.withColumns({"start": F.col("_s"), "end": F.col("_e")})
    cols = [*lk, "text", "start", "end", "confidence", "words"]
    plain = own.filter("mode = 'transcript'").select(*cols)
    seeds = own.filter("mode = 'hybrid'").select(
        *lk, (F.col("span_start") + F.col("drift_median")).alias("seed_start"),
        (F.col("span_end") + F.col("drift_median")).alias("seed_end"))
    mixed = merge_fallback(own.filter("mode = 'hybrid'").select(*cols), seeds, lk)
    mixed = clamp_monotonic(mixed, key, ["line_index"], words="words", hot_rows=hot_rows)
    whole = align_from_spans(
        lines.join(choice.filter("mode = 'spans'").select(*key), key, "left_semi"), spans, key, text,
        word_spans)
    out = plain.unionByName(mixed.select(*cols)).unionByName(whole.select(*cols))
    timed = out.filter("start is not null").groupBy(*key).agg(
        F.count(F.lit(1)).alias("_t"), F.avg("confidence").alias("_m"))
    stats = choice.join(timed, key, "left")
    ratio = (F.when(F.col("mode") == "transcript", F.col("_matched"))
             .when(F.col("mode") == "hybrid", F.col("_kept"))
             .otherwise(F.coalesce("_t", F.lit(0)))) / F.col("_lines")
    mean = (F.when(F.col("mode") == "transcript", F.col("_conf") / F.col("_lines"))
            .when(F.col("mode") == "hybrid", F.coalesce("_m", F.lit(0.0)))
            .otherwise(F.lit(fixed.FALLBACK_CONFIDENCE) * F.coalesce("_t", F.lit(0))
                       / F.col("_lines")))
    stats = stats.select(*key, "mode", F.bround(ratio, 4).alias("line_match_ratio"),
                         F.bround(mean, 4).alias("mean_confidence"))
    return out, stats
