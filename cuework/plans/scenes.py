"""Scene plans: from timed lines and track analysis to one row per scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions import predicates as pr
from cuework.functions import text as tx
from cuework.operators import aggregates as agg
from cuework.operators.joins import extract_semantics, mean_energy, overlap_join, relative_points
from cuework.operators.ordered import skew_limit
from cuework.operators.ranking import top_n
from cuework.operators.windows import carve_spans, ordinal
from cuework.session import checkpoint

_BASE = ["archiveCollage", "doodleMemory"]


def _styles() -> dict[str, str]:
    """Every known style and the style whose tables it uses."""
    return {**{s: s for s in _BASE}, **{s: _BASE[0] for s in fixed.STYLE_ALIASES}}


def _by_style(style: Column, values: dict[str, Column]) -> Column:
    second = values[_BASE[1]]
    return F.when(style == _BASE[1], second).otherwise(values[_BASE[0]])


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def vocal_bounds(scenes: DataFrame, words: DataFrame, regions: DataFrame | None,
                 key: Sequence[str], min_overlap: float = 0.3, base: float = 1.0) -> DataFrame:
    """Where singing starts and stops in each scene, and whether there is none.

    ``scenes``: key, scene_index, line_index, start, end, lyric (absolute times). Word times tighten
    the scene; where sung regions are known their overlap wins, and a line without any is flagged.
    """
    key = list(key)
    w = words.groupBy(*key, "line_index").agg(F.min("start").alias("_ws"), F.max("end").alias("_we"))
    df = scenes.join(w, [*key, "line_index"], "left")
    df = df.withColumns({
        "vocal_start": F.greatest(F.col("start"), F.coalesce("_ws", "start")),
        "vocal_end": F.least(F.col("end"), F.coalesce("_we", "end")),
        "no_vocal": F.lit(False)}).drop("_ws", "_we")
    if regions is None:
        return df
    sung = tx.text_or_empty("lyric") != ""
    known = regions.select(*key).distinct().withColumn("_known", F.lit(True))
    df = overlap_join(df, regions, key, ["scene_index"], min_overlap, base).join(known, key, "left")
    gate = sung & F.coalesce("_known", F.lit(False))
    hit = F.col("overlap_start").isNotNull()
    return df.withColumns({
        "vocal_start": F.when(gate & hit, F.col("overlap_start")).otherwise(F.col("vocal_start")),
        "vocal_end": F.when(gate & hit, F.col("overlap_end")).otherwise(F.col("vocal_end")),
        "no_vocal": gate & ~hit}).drop("overlap_start", "overlap_end", "_known")


def song_queries(tracks: DataFrame, moods: DataFrame, subjects: DataFrame, lex: DataFrame,
                 key: Sequence[str], title: str = "title") -> DataFrame:
    """Fallback phrases of a track: title phrases (3), mood phrases, its first two subjects; 5 in all."""
    key = list(key)
    titles = tracks.select(F.col(title).alias("_title")).filter("_title <> ''").distinct()
    sem = extract_semantics(titles, ["_title"], "_title", lex).select(
        "_title", F.slice("queries", 1, 3).alias("_tq"))
    first = top_n(subjects, key, [F.col("at").asc(), F.col("subject").asc()], 2)
    two = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "subject")))
                                  .alias("_s"))
    empty = F.array().cast("array<string>")
    mood = F.create_map(*[x for k, v in fixed.EMOTION_QUERIES.items()
                          for x in (F.lit(k), _strings(v))])
    df = (tracks.select(*key, F.col(title).alias("_title")).join(sem, "_title", "left")
          .join(moods.select(*key, "emotion"), key, "left").join(two, key, "left"))
    parts = F.concat(F.coalesce("_tq", empty),
                     F.element_at(mood, F.coalesce("emotion", F.lit("neutral"))),
                     F.coalesce(F.transform("_s", lambda s: F.concat(
                         s["subject"], F.lit(" cinematic mood"))), empty))
    return df.select(*key, F.slice(F.array_distinct(parts), 1, 5).alias("song_queries"))


def text_id(col: str) -> Column:
    """Digest that stands for a text where whole texts would be moved; NULL for NULL."""
    return F.sha2(F.col(col), 256)


def in_reach(lines: DataFrame, segments: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines that lie, at least in part, in the segment of their key."""
    return (lines.join(segments.select(*key, "segment_start", "segment_end"), list(key))
            .filter((F.col("end") > F.col("segment_start")) & (F.col("start") < F.col("segment_end")))
            .select(*lines.columns))


def near_lines(lines: DataFrame, times: DataFrame, segments: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(lines in reach of their segment with ``text_id``, each of their texts once with it).

    ``times`` are the lines without their texts: they tell which lines count before any text is moved. A line that shares
    its number with one in reach comes along.
    """
    on = [*key, "line_index"]
    wanted = in_reach(times, segments, key).select(*on).distinct()
    a, b = lines.alias("a"), wanted.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    near = checkpoint(a.join(b, same, "left_semi").withColumn("text_id", text_id("text")))
    return near, checkpoint(near.select("text_id", "text").distinct())


def plan_scenes(lines: DataFrame, words: DataFrame, frames: DataFrame, beats: DataFrame,
                onsets: DataFrame, segments: DataFrame, tracks: DataFrame, lex: DataFrame,
                key: Sequence[str], regions: DataFrame | None = None,
                themes: DataFrame | None = None, semantics: DataFrame | None = None,
                hop: float = fixed.ENERGY_HOP, hot_rows: int | None = None
                ) -> dict[str, DataFrame]:
    """Plan every track's segment.

    ``lines``: key, line_index, text, translation, start, end, uncertain. ``tracks``: key, title,
    tempo_bpm, style. ``themes``: key, extra_queries. ``semantics``: text plus the columns of
    :func:`extract_semantics`, to be used before the lexicon. Returns scenes, header, and the long
    tables scene_beats and scene_onsets.
    """
    key = list(key)
    empty = F.array().cast("array<string>")
    hot_rows = skew_limit([lines, frames, words], key, hot_rows)
    times = lines.select(*key, "line_index", "start", "end")
    spans = carve_spans(times, segments, key, hot_rows=hot_rows)
    spans = ordinal(spans.withColumnsRenamed({"span_start": "start", "span_end": "end"}), key,
                    ["start", "end"], "scene_index", hot_rows)
    # scenes are far fewer than frames, words or events, and every step below starts from them
    spans = checkpoint(spans)

    # --- meaning, once per distinct text --------------------------------------------------------
    near, texts = near_lines(lines, times, segments, key)
    timed = in_reach(near, segments, key).select(*key, "line_index", "text_id", "start")
    rest = texts
    if semantics is not None:
        given = semantics.withColumn("text_id", text_id("text"))
        rest = texts.join(given, "text_id", "left_anti")
    sem = extract_semantics(rest, ["text_id"], "text", lex)
    if semantics is not None:
        sem = sem.unionByName(given.join(texts, "text_id", "left_semi").drop("text"))
    sem = checkpoint(sem)
    lined = timed.join(sem, "text_id")
    totals = lined.groupBy(*key).agg(*[F.sum(n).alias(n) for n in fixed.EMOTIONS])
    everyone = segments.select(*key)
    totals = everyone.join(totals, key, "left").na.fill(0.0, fixed.EMOTIONS)
    moods = agg.recommend_style(totals).withColumn("emotion", tx.dominant(fixed.EMOTIONS)).select(
        *key, "emotion", "recommended_style", "recommendation_confidence", "recommendation_reason")
    subjects = (lined.select(*key, "start", "line_index", F.posexplode("subjects").alias("p", "subject"))
                .groupBy(*key, "subject").agg(F.min(F.struct("start", "line_index", "p")).alias("at")))
    songs = song_queries(tracks, moods, subjects, lex, key)
    per_track = (tracks.select(*key, "style", "tempo_bpm").join(moods, key).join(songs, key))
    if themes is not None:
        per_track = per_track.join(themes.select(*key, "extra_queries"), key, "left")
    else:
        per_track = per_track.withColumn("extra_queries", empty)
    named = _styles()
    per_track = per_track.withColumn("style_key", F.when(
        F.col("style").isin(list(named)), F.col("style")).otherwise(F.col("recommended_style")))

    # --- scenes ---------------------------------------------------------------------------------
    # the digest stands for the text until the last steps, but for the empty one
    df = spans.join(near.select(*key, F.col("line_index").cast("long").alias("line_index"),
                                F.when(F.col("text") != "", F.col("text_id")).alias("lyric"), "translation", "uncertain"),
                    [*key, "line_index"], "left")
    df = mean_energy(frames, df, key, ["scene_index"], hop, name="energy", hot_rows=hot_rows)
    df = vocal_bounds(df, words, regions, key)
    # scenes without a line would all meet in one task, so each looks for a digest that no text has
    meaning = sem.join(texts, "text_id").select(
        "text_id", F.col("text").alias("lyric"), "subjects",
        F.when(F.size("matched") > 0, F.col("queries")).otherwise(empty).alias("own"))
    none = F.concat(F.lit("-"), F.xxhash64(*key, "scene_index").cast("string"))
    df = df.withColumn("text_id", F.coalesce("lyric", none)).drop("lyric").join(meaning, "text_id", "left")
    df = df.join(segments.select(*key, "segment_start"), key).join(per_track, key)
    base = F.when(F.col("style_key") == _BASE[1], _BASE[1]).otherwise(_BASE[0])
    i, energy = F.col("scene_index"), F.col("energy")
    df = df.withColumn("energy_band", pr.energy_band("energy"))
    band = F.col("energy_band")

    def seconds(style: str, n: int) -> Column:
        v = fixed.SCENE_SECONDS[style]
        return (F.when(band == "calm", v["calm"][n]).when(band == "normal", v["normal"][n])
                .otherwise(v["energetic"][n]))

    def motion(style: str) -> Column:
        ms = fixed.MOTIONS[style]
        return F.element_at(_strings(ms), ((i + F.floor(energy * 10)) % len(ms) + 1).cast("int"))

    def transition(style: str) -> Column:
        ts = fixed.TRANSITIONS[style]
        pick = tx.hashed_pick([*key, "scene_index"], len(ts)) + 1
        return F.struct(F.element_at(_strings([t for t, _ in ts]), pick).alias("type"),
                        F.element_at(F.array(*[F.lit(d) for _, d in ts]), pick).alias("duration"))

    each = {"lo": {s: seconds(s, 0) for s in _BASE}, "hi": {s: seconds(s, 1) for s in _BASE},
            "motion": {s: motion(s) for s in _BASE}, "tr": {s: transition(s) for s in _BASE},
            "ov": {s: _strings(fixed.OVERLAYS[s]) for s in _BASE}}
    tr = _by_style(base, each["tr"])
    subjects_col = F.coalesce("subjects", empty)
    origin = F.col("segment_start")
    extra = F.coalesce("extra_queries", empty)
    songs_col = F.array_distinct(F.concat(extra, F.col("song_queries")))
    scenes = df.withColumn("_tr", tr).select(
        *key, "scene_index", F.bround(F.col("start") - origin, 3).alias("start"),
        F.bround(F.col("end") - origin, 3).alias("end"),
        F.bround(F.col("vocal_start") - origin, 3).alias("vocal_start"),
        F.bround(F.col("vocal_end") - origin, 3).alias("vocal_end"), "no_vocal",
        F.bround(F.col("end") - F.col("start"), 3).alias("duration"),
        _by_style(base, each["lo"]).alias("target_min"), _by_style(base, each["hi"]).alias("target_max"),
        F.nullif(F.col("lyric"), F.lit("")).alias("lyric"), "line_index", "translation",
        F.coalesce("uncertain", F.lit(False)).alias("uncertain"),
        F.when(F.size(subjects_col) > 0, F.concat(
            F.col("emotion"), F.lit(" moment about "), F.array_join(F.slice(subjects_col, 1, 3), ", ")))
        .otherwise(F.concat(F.col("emotion"), F.lit(" passage — song-level imagery"))).alias("meaning"),
        "emotion", F.bround(energy, 3).alias("energy"), "energy_band",
        subjects_col.alias("subjects"),
        tx.rotate_queries(F.coalesce("own", empty), extra, i, songs_col).alias("queries"),
        pr.media_preference("style_key", "energy_band").alias("media_preference"),
        _by_style(base, each["motion"]).alias("motion_type"),
        F.bround(0.03 + 0.05 * energy, 3).alias("motion_amount"),
        F.col("_tr.type").alias("transition_type"),
        F.when(band == "energetic", F.bround(F.col("_tr.duration") * 0.7, 3))
        .otherwise(F.col("_tr.duration")).alias("transition_duration"),
        F.when((F.col("style_key") == _BASE[0]) & (i % 3 == 2), F.array_append(
            _by_style(base, each["ov"]), F.lit("dust_flicker")))
        .otherwise(_by_style(base, each["ov"])).alias("overlays"),
        tx.cyclic_pick(i, fixed.SUBTITLE_BANDS).alias("subtitle_band"))
    counts = spans.groupBy(*key).agg(F.count(F.lit(1)).alias("scene_count"),
                                     F.count("line_index").alias("lyric_scene_count"))
    header = per_track.join(segments.select(*key, "segment_start", "segment_end"), key).join(
        counts, key, "left").select(
        *key, F.col("style_key").alias("style"), "recommended_style", "recommendation_confidence",
        "recommendation_reason", F.bround("tempo_bpm", 2).alias("tempo_bpm"), "segment_start",
        "segment_end", "scene_count", "lyric_scene_count")
    bounds = spans.select(*key, "scene_index", "start", "end")
    return {"scenes": scenes, "header": header,
            "scene_beats": relative_points(beats, bounds, key, ["scene_index"]),
            "scene_onsets": relative_points(onsets, bounds, key, ["scene_index"])}


def requery(scenes: DataFrame, edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """New search phrases for single scenes, in front of the old ones.

    ``edits``: key, scene_index, query_text (typed phrase or NULL), fresh (array of phrases). A
    typed phrase wins; fresh phrases already tried are left out, at most three are taken. An edited
    scene loses its media.
    """
    on = [*key, "scene_index"]
    empty = F.array().cast("array<string>")
    df = scenes.join(edits.select(*on, "query_text", F.coalesce("fresh", empty).alias("_f"),
                                  F.lit(True).alias("_hit")), on, "left")
    new = F.slice(tx.ordered_except(F.col("_f"), F.col("queries")), 1, 3)
    typed = F.array(F.col("query_text"))
    q = (F.when(F.coalesce("query_text", F.lit("")) != "",
                F.concat(typed, tx.ordered_except(F.col("queries"), typed)))
         .when(F.col("_hit") & (F.size(new) > 0), F.concat(new, tx.ordered_except(F.col("queries"), new)))
         .otherwise(F.col("queries")))
    df = df.withColumn("_q", q)
    if "media" in scenes.columns:
        df = df.withColumn("media", F.when(F.col("_hit").isNull(), F.col("media")))
    return df.withColumn("queries", F.col("_q")).select(*scenes.columns)
