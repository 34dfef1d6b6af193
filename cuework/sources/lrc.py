"""Timed-lyric (LRC) documents. A document is one row and is parsed inside it: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuework.functions.text import lines_of, positions, strip, tag_seconds

# fixed values: time tags, meta tags and inline word tags
TIME_TAG = r"\[(\d{1,3}):(\d{1,2})(?:[.:](\d{1,3}))?\]"
META_TAG = r"^\[([a-zA-Z#][a-zA-Z]*):(.*)\]$"
WORD_TAG = r"<(\d{1,3}):(\d{1,2})(?:[.:](\d{1,3}))?>"

_LEAD = r"^(?:\[\d{1,3}:\d{1,2}(?:[.:]\d{1,3})?\])+"
_ANY_WORD_TAG = r"<\d{1,3}:\d{1,2}(?:[.:]\d{1,3})?>"
_WORDS = "array<struct<start:double,text:string>>"
_WORD = rf"(?s){WORD_TAG}(.*?)(?={_ANY_WORD_TAG}|$)"


def _seconds_in(col: Column, pattern: str) -> Column:
    m, s, f = (F.regexp_extract_all(col, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(m.alias("m"), s.alias("s"), f.alias("f")),
                       lambda t: tag_seconds(t["m"], t["s"], t["f"]))


def _metas(raws: Column) -> Column:
    return F.transform(F.filter(raws, lambda r: r.rlike(META_TAG) & ~r.rlike(_LEAD)),
                       lambda r: F.struct(F.lower(F.regexp_extract(r, META_TAG, 1)).alias("name"),
                                          F.trim(F.regexp_extract(r, META_TAG, 2)).alias("value")))


def _shift(raws: Column) -> Column:
    """Seconds to add: a positive offset (in ms) moves the text earlier."""
    offsets = F.filter(_metas(raws), lambda m: m["name"] == "offset")
    ms = F.regexp_replace(F.try_element_at(offsets, F.lit(-1))["value"], r"\+", "").try_cast("int")
    return -F.coalesce(ms, F.lit(0)) / 1000.0


def _move(t: Column, shift: Column) -> Column:
    return F.when(shift != 0, F.greatest(F.lit(0.0), t + shift)).otherwise(t)


def parse_lrc_meta(df: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """Meta tags, the last one of a name winning."""
    metas = _metas(lines_of(col))
    rows = df.select(*key, F.posexplode(metas).alias("_p", "m"))
    return rows.groupBy(*key, "m.name").agg(F.max_by("m.value", "_p").alias("value"))


def parse_lrc(df: DataFrame, key: Sequence[str], col: str, keep_empty: bool = True) -> DataFrame:
    """Timed lines sorted by start: key, line_index, start, text, words (array of start/text).

    A line with several leading tags comes once per tag; untagged lines are dropped. With
    ``keep_empty`` off, lines without text go too and the index counts the rest.
    """
    df = df.select(*key, lines_of(col).alias("_raws")).withColumn("_shift", _shift(F.col("_raws")))
    tagged = F.filter(F.transform("_raws", lambda r, i: F.struct(
        i.alias("i"), F.regexp_extract(r, _LEAD, 0).alias("lead"), r.alias("raw"))),
        lambda x: x["lead"] != "")
    df = df.withColumn("_t", F.transform(tagged, lambda x: F.struct(
        x["i"].alias("i"), _seconds_in(x["lead"], TIME_TAG).alias("starts"),
        strip(F.substring(x["raw"], F.length(x["lead"]) + 1, F.length(x["raw"]))).alias("body"))))

    def clean(body: Column) -> Column:
        return F.regexp_replace(strip(F.regexp_replace(body, WORD_TAG, "")), r"\s{2,}", " ")

    def words(body: Column) -> Column:
        pairs = F.arrays_zip(_seconds_in(body, _WORD).alias("start"), F.transform(
            F.regexp_extract_all(body, F.lit(_WORD), F.lit(4)), strip).alias("text"))
        tagged = F.transform(F.filter(pairs, lambda w: w["text"] != ""), lambda w: F.struct(
            _move(w["start"], F.col("_shift")).alias("start"), w["text"].alias("text")))
        return F.when(body.contains("<"), tagged).otherwise(F.array().cast(_WORDS))

    lines = F.flatten(F.transform("_t", lambda x: F.transform(x["starts"], lambda s, j: F.struct(
        _move(s, F.col("_shift")).alias("start"), x["i"].alias("i"), j.alias("j"),
        clean(x["body"]).alias("text"), words(x["body"]).alias("words")))))
    if not keep_empty:
        lines = F.filter(lines, lambda x: x["text"] != "")
    return positions(df, key, F.array_sort(lines), "line_index", "x").select(
        *key, "line_index", "x.start", "x.text", "x.words")


def parse_lrc_words(df: DataFrame, key: Sequence[str], col: str, keep_empty: bool = True
                    ) -> DataFrame:
    """Inline word tags, one row per word."""
    lines = parse_lrc(df, key, col, keep_empty)
    return positions(lines, [*key, "line_index"], F.col("words"), "word_index", "w").select(
        *key, "line_index", "word_index", "w.start", "w.text")
