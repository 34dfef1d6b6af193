"""From requests to stored, timed and translated lyric lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions import predicates as pr
from cuework.functions import text as tx
from cuework.operators import aggregates as agg
from cuework.operators import align
from cuework.operators.joins import match_candidates
from cuework.operators.ordered import skew_limit
from cuework.operators.ranking import rank_candidates
from cuework.operators.windows import active_regions, infer_line_ends, pause_lines
from cuework.session import checkpoint
from cuework.sources.lrc import parse_lrc


def rank_names(requests: DataFrame) -> DataFrame:
    """Cleaned artist and title to rank against; an "Artist - Title" title is split when needed."""
    parsed = tx.split_artist_title("title")
    a, t = tx.clean_track_name("artist"), tx.clean_track_name("title")
    use = (a == "") & (parsed["artist"] != "") & (parsed["title"] != "")
    a2 = F.when(use, tx.clean_track_name(parsed["artist"])).otherwise(a)
    t2 = F.when(use, tx.clean_track_name(parsed["title"])).otherwise(t)
    return requests.withColumns({
        "_a": F.when(a2 != "", a2).otherwise(tx.text_or_empty("artist")),
        "_t": F.when(t2 != "", t2).otherwise(tx.text_or_empty("title")),
    }).withColumns({"artist": F.col("_a"), "title": F.col("_t")}).drop("_a", "_t")


def stored_lines(chosen: DataFrame, key: Sequence[str], duration: str = "track_duration"
                 ) -> tuple[DataFrame, DataFrame]:
    """Lines and words of the chosen candidates: timed text where there is some, else plain lines.

    Line ends use the track's length, or the candidate's where that is unknown.
    """
    key = list(key)
    synced = F.length(tx.strip(tx.text_or_empty("lrc_text"))) > 0
    src = chosen.withColumn("_dur", F.coalesce(F.col(duration), F.col("duration")))
    timed = parse_lrc(src.filter(synced), key, "lrc_text", keep_empty=False)
    timed = timed.join(src.select(*key, "_dur"), key)
    timed = infer_line_ends(timed, key, "start", "_dur", tie=["line_index"])
    plain = tx.plain_lines(src.filter(~synced), key, "plain_text").withColumns(
        {"start": F.lit(None).cast("double"), "end": F.lit(None).cast("double")})
    lines = timed.select(*key, "line_index", "text", "start", "end").unionByName(
        plain.select(*key, "line_index", "text", "start", "end"))
    words = (timed.select(*key, "line_index", F.posexplode("words").alias("word_index", "w"))
             .select(*key, "line_index", "word_index", F.col("w.text").alias("text"),
                     F.col("w.start").alias("start")))
    return lines, words


def resolve_lyrics(requests: DataFrame, candidates: DataFrame, key: Sequence[str],
                   asr: DataFrame | None = None, measure: str = "ratio", top: int = 5
                   ) -> dict[str, DataFrame]:
    """Rank the candidates of every request and store the best one.

    ``requests``: key, artist, title, duration. ``candidates``: key, provider fields, input_pos.
    Requests without a usable candidate fall back to the transcript's pause groups (at least two),
    when ``asr`` is given. Returns ranked (first ``top``), chosen, lines, words.
    """
    key = list(key)
    wanted = rank_names(requests)
    ranked = rank_candidates(match_candidates(wanted, candidates, key, measure), key, top)
    best = ranked.filter("rank = 1").join(
        requests.select(*key, F.col("duration").alias("track_duration")), key)
    cols = ["provider", "provider_ref", "artist", "title", "album", "duration", "plain_text",
            "lrc_text", "score", "track_duration"]
    best = best.select(*key, *cols)
    best = checkpoint(best)
    lines, words = stored_lines(best, key)
    if asr is not None:
        missing = requests.join(best.select(*key), key, "left_anti")
        heard = pause_lines(asr.join(missing.select(*key), key, "left_semi"), key, tie=["pos"])
        enough = heard.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
        heard = heard.join(enough.select(*key), key, "left_semi")
        empty = F.lit("")
        spare = missing.join(enough.select(*key), key, "left_semi").select(
            *key, F.lit("transcription").alias("provider"), empty.alias("provider_ref"),
            tx.text_or_empty("artist").alias("artist"), tx.text_or_empty("title").alias("title"),
            empty.alias("album"), F.lit(None).cast("double").alias("duration"),
            empty.alias("plain_text"), empty.alias("lrc_text"), F.lit(0.5).alias("score"),
            F.col("duration").alias("track_duration"))
        best = best.unionByName(spare)
        lines = lines.unionByName(heard.select(
            *key, F.col("line_index").cast("int").alias("line_index"), "text",
            F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end")))
    return {"ranked": ranked, "chosen": best, "lines": lines, "words": words}


def align_catalogue(lines: DataFrame, spans: DataFrame, asr: DataFrame, frames: DataFrame,
                    key: Sequence[str], text: str = "text", word_spans: DataFrame | None = None,
                    hop: float = fixed.ENERGY_HOP, hot_rows: int | None = None
                    ) -> dict[str, DataFrame]:
    """Time all lines of all tracks.

    The spans are first shifted onto the loud regions where that clearly helps, then the hybrid
    alignment runs, and lines and tracks get their flags. Returns offsets, regions, lines, tracks.
    """
    key = list(key)
    hot_rows = skew_limit([spans, frames], key, hot_rows)
    # one row per track, read by every later step
    offsets = checkpoint(agg.accept_offset(agg.estimate_offset(spans, frames, key, hop,
                                                              hot_rows=hot_rows)))
    moved = agg.apply_offset(spans.filter("start is not null"), offsets, key)
    if word_spans is not None:
        w = word_spans.join(offsets.select(*key, "applied"), key, "left")
        by = F.coalesce("applied", F.lit(0.0))
        word_spans = w.withColumn("words", F.transform("words", lambda x: x.withField(
            "start", x["start"] + by))).drop("applied")
    timed, stats = align.align_hybrid(lines, moved, asr, key, text, word_spans,
                                       hot_rows=hot_rows)
    timed = timed.withColumn("uncertain", pr.uncertain("confidence"))
    counts = timed.groupBy(*key).agg(F.count_if("uncertain").alias("uncertain_lines"),
                                     F.count(F.lit(1)).alias("line_count"))
    tracks = stats.withColumn("suspect", pr.suspect("mean_confidence")).join(counts, key)
    return {"offsets": offsets, "regions": active_regions(frames, key, hop=hop, hot_rows=hot_rows),
            "lines": timed,
            "tracks": tracks}


Translator = Callable[[str, str, str], str]


def backfill_translations(lines: DataFrame, translator: Translator, key: Sequence[str],
                          languages: DataFrame | None = None, target: str = "tr",
                          memo: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Translate lines that have none; keep the user's, skip failures and identical results.

    ``languages`` (key, language) is optional; tracks already in the target language are left
    alone. Every distinct (text, language) is translated once. ``memo`` (text, source, result)
    holds earlier results. Returns the lines and the new memo.
    """
    key = list(key)
    spark = lines.sparkSession
    memo_schema = "text string, source string, result string"
    memo = memo if memo is not None else spark.createDataFrame([], memo_schema)
    memo = memo.groupBy("text", "source").agg(F.min("result").alias("result"))
    df = lines
    if languages is not None:
        df = df.join(languages.select(*key, F.lower(F.left("language", F.lit(2))).alias("source")),
                     key, "left")
    else:
        df = df.withColumn("source", F.lit(None).cast("string"))
    df = df.withColumns({"source": F.coalesce("source", F.lit("en")),
                         "_text": tx.strip(F.coalesce("corrected_text", "text"))})
    todo = ((F.coalesce("translation", F.lit("")) == "") & (F.col("_text") != "")
            & (F.col("source") != target))
    wanted = df.filter(todo).select(F.col("_text").alias("text"), "source").distinct()
    fresh = wanted.join(memo.select("text", "source"), ["text", "source"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str, source: str) -> str | None:
            try:
                return (translator(text, source, target) or "").strip() or None
            except Exception:
                return None
        for b in batches:
            b["result"] = [one(t, s) for t, s in zip(b["text"], b["source"])]
            yield b[["text", "source", "result"]]

    # written down once: lines and memo must hold the same answers, and each costs a call
    table = memo.unionByName(checkpoint(fresh.mapInPandas(run, memo_schema)))
    # a failure is not remembered as an answer, so a later run tries it again
    table = table.filter("result is not null")
    out = df.withColumn("_todo", todo).join(
        table.select(F.col("text").alias("_text"), "source", "result"), ["_text", "source"], "left")
    good = F.col("_todo") & F.col("result").isNotNull() & (
        F.lower("result") != F.lower("_text"))
    out = out.withColumn("translation", F.when(F.coalesce(good, F.lit(False)), F.col("result"))
                         .otherwise(F.col("translation")))
    return out.select(*lines.columns), table


def track_languages(lines: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Language guess per track from counts over its lines (no track is ever put in one string)."""
    t = tx.text_or_empty(text)
    low = F.lower(t)
    words = tx.words_of(low)
    known = F.filter(words, lambda w: F.btrim(w, F.lit(".,!?'\"()")).isin(fixed.TURKISH_WORDS))

    def block(b: str):
        return F.sum(F.regexp_count(t, F.lit(f"[{b}]")))

    per = lines.groupBy(*key).agg(
        F.sum(F.length(low) - F.length(F.translate(low, fixed.TURKISH_CHARS, ""))).alias("_tc"),
        (F.sum(F.length(low)) + F.count(F.lit(1)) - 1).alias("_len"),
        F.sum(F.size(words)).alias("_w"), F.sum(F.size(known)).alias("_k"),
        F.sum(F.regexp_count(t, F.lit(r"\p{L}"))).alias("_letters"),
        block(fixed.ARABIC).alias("_ar"), block(fixed.ARABIC_FORMS).alias("_af"),
        block(fixed.CYRILLIC).alias("_ru"), block(fixed.GREEK).alias("_el"),
        block(fixed.GREEK_EXTENDED).alias("_ex"), block(fixed.HEBREW).alias("_he"))
    n = F.greatest(F.lit(1), F.col("_letters"))
    turkish = (F.col("_tc") >= F.greatest(F.lit(2.0), F.col("_len") * 0.005)) | (
        F.col("_k") / F.greatest(F.lit(1), F.col("_w")) >= 0.08)
    lang = (F.when(F.col("_w") == 0, F.lit(None).cast("string")).when(turkish, "tr")
            .when((F.col("_ar") / n > 0.3) | (F.col("_af") / n > 0.3), "ar")
            .when(F.col("_ru") / n > 0.3, "ru")
            .when((F.col("_el") / n > 0.3) | (F.col("_ex") / n > 0.3), "el")
            .when(F.col("_he") / n > 0.3, "he"))
    return per.select(*key, lang.alias("language"))
