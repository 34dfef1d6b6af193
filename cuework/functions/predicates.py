"""Row predicates and classifications, all plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions.text import strip, text_or_empty
from cuework.operators.ordered import scan, split_hot, unsplit


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_parts(col: Column | str) -> Column:
    u = strip(_c(col))
    return F.struct(*[F.try_parse_url(u, F.lit(p)).alias(p.lower())
                      for p in ("PROTOCOL", "HOST", "PATH", "QUERY", "REF")])


def extract_video_id(col: Column | str) -> Column:
    """The 11-character id of a well-formed video URL, else NULL."""
    u = strip(_c(col))
    host = F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("HOST"))), r"^www\.", "")
    path = F.try_parse_url(u, F.lit("PATH"))
    by_path = F.nullif(F.regexp_extract(path, r"^/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})$", 1),
                       F.lit(""))
    found = (F.when(host.isin("youtube.com", "m.youtube.com", "music.youtube.com"),
                    F.when(path == "/watch", F.try_parse_url(u, F.lit("QUERY"), F.lit("v")))
                    .otherwise(by_path))
             .when(host == "youtu.be", F.nullif(F.regexp_extract(
                 path, r"^/([A-Za-z0-9_-]{11})$", 1), F.lit(""))))
    ok = (F.length(_c(col)) <= 2048) & F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin(
        "http", "https") & found.rlike(r"^[A-Za-z0-9_-]{11}$")
    return F.when(ok, found)


def classify_message(col: Column | str, rules: Sequence[tuple] = tuple(fixed.MESSAGE_RULES),
                     fallback: tuple[str, str] = fixed.MESSAGE_FALLBACK) -> Column:
    """Struct (code, text) by the first rule with a group of phrases that all occur in the message."""
    m = F.lower(text_or_empty(col))
    code, text = F.lit(fallback[0]), F.concat(F.lit(fallback[1]), text_or_empty(col))
    for rule_code, rule_text, groups in reversed(list(rules)):
        hit = F.lit(False)
        for group in groups:
            part = F.lit(True)
            for phrase in group:
                part = part & m.contains(phrase)
            hit = hit | part
        code = F.when(hit, rule_code).otherwise(code)
        text = F.when(hit, rule_text).otherwise(text)
    return F.struct(code.alias("code"), text.alias("text"))


def valid_key(col: Column | str) -> Column:
    return F.coalesce(_c(col).rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))


def reject_reason(scene_duration: Column | None = None, kind: str = "kind", width: str = "width",
                  height: str = "height", tags: str = "tags", duration: str = "duration") -> Column:
    """Why a media candidate must not be used; NULL when it may be."""
    k, w, h, d = F.col(kind), F.col(width), F.col(height), F.col(duration)
    size = F.concat(w.cast("string"), F.lit("x"), h.cast("string"))
    need = scene_duration if scene_duration is not None else F.lit(None).cast("double")
    return (
        F.when(text_or_empty(tags).rlike(fixed.BAD_TAGS), "looks watermarked/branded/text-heavy")
        .when((k == "photo") & (h > w) & ((w < 1080) | (h < 1600)),
              F.concat(F.lit("too small ("), size, F.lit(") — would need enlargement")))
        .when((k == "photo") & (h <= w) & (F.least(w, h) < 1400),
              F.concat(F.lit("too small for landscape adaptation ("), size, F.lit(")")))
        .when((k == "video") & (h < 1080),
              F.concat(F.lit("video below 1080 vertical ("), size, F.lit(")")))
        .when((k == "video") & (need > 0) & (d > 0) & (d < need * 0.8),
              F.format_string("video too short (%.1fs for a %.1fs scene)", d, need))
        .when(~k.isin("photo", "video"), F.concat(F.lit("unsupported kind '"), k, F.lit("'"))))


def uncertain(confidence: Column | str) -> Column:
    c = _c(confidence)
    return c.isNotNull() & (c < fixed.UNCERTAIN_BELOW)


def suspect(mean_confidence: Column | str) -> Column:
    c = _c(mean_confidence)
    return c.isNotNull() & (c < fixed.SUSPECT_BELOW)


def clip_to_segment(lines: DataFrame, segments: DataFrame, key: Sequence[str], start: str = "start",
                    end: str = "end", words: str | None = None) -> DataFrame:
    """Lines that overlap the key's segment, clipped to it, with times counted from its start."""
    lo, hi = F.col("segment_start"), F.col("segment_end")
    df = (lines.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
          .join(segments.select(*key, "segment_start", "segment_end"), list(key))
          .filter((F.col(end) > lo) & (F.col(start) < hi)))
    cols = {"_s": F.greatest(F.lit(0.0), F.col(start) - lo),
            "_e": F.least(hi - lo, F.col(end) - lo)}
    if words:
        cols[words] = F.transform(words, lambda w: w.withField(
            "start", F.when(w["start"].isNotNull(), F.greatest(F.lit(0.0), w["start"] - lo)))
            .withField("end", w["end"] - lo))
    df = df.withColumns(cols)
    return df.withColumns({start: F.col("_s"), end: F.col("_e")}).drop(
        "_s", "_e", "segment_start", "segment_end")


def shift_and_clamp(df: DataFrame, key: Sequence[str], offset: str, duration: str,
                    order: str = "scene_index", start: str = "start", end: str = "end",
                    inner: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Move every interval of a key by its offset, inside [0, duration]; the first starts at 0 and
    the last ends at the duration. Keys with a zero offset stay as they are."""
    off, dur = F.coalesce(F.col(offset), F.lit(0.0)), F.col(duration)
    d = split_hot(df, key, order, hot_rows)
    d = scan(d, key, [order], {"_i": ("count", F.lit(1))})
    d = scan(d, key, [order], {"_j": ("count", F.lit(1))}, reverse=True)
    d = d.withColumn("_s0", F.greatest(F.lit(0.0), F.least(dur, F.col(start) + off)))
    d = d.withColumn("_e0", F.greatest(F.col("_s0") + 0.1, F.least(dur, F.col(end) + off)))
    moved = off != 0
    cols = {
        "_s": F.when(~moved, F.col(start)).when(F.col("_i") == 0, 0.0).otherwise(F.col("_s0")),
        "_e": F.when(~moved, F.col(end)).when(F.col("_j") == 0, dur).otherwise(F.col("_e0")),
    }
    for c in inner:
        cols[c] = F.when(~moved | F.col(c).isNull(), F.col(c)).otherwise(
            F.greatest(F.col("_s0"), F.least(dur, F.col(c) + off)))
    d = d.withColumns(cols).withColumns({start: F.col("_s"), end: F.col("_e")})
    return unsplit(d.drop("_s", "_e", "_s0", "_e0", "_i", "_j"))


def energy_band(col: Column | str) -> Column:
    return F.when(_c(col) < 0.40, "calm").when(_c(col) < 0.70, "normal").otherwise("energetic")


def adaptation(width: Column | str, height: Column | str, style: Column | str) -> Column:
    """How to fit media into a portrait frame."""
    w, h = _c(width), _c(height)
    return (F.when(h >= w, "portrait_crop").when(_c(style) == "archiveCollage", "layered_frame")
            .when(h * 1.2 >= 1600, "subject_crop").otherwise("blur_fill"))


def is_drawn(provider: Column | str, file_path: Column | str) -> Column:
    name = F.element_at(F.split(text_or_empty(file_path), "/"), -1)
    return text_or_empty(provider).startswith("fal") & name.startswith("drawn_")


def visibility(scene_start: Column, scene_end: Column, vocal_start: Column, vocal_end: Column,
               no_vocal: Column) -> Column:
    """Struct (show_at, hide_at) of a caption; NULL when there is nothing sung."""
    hide = F.when(vocal_end.isNotNull(), F.least(scene_end, vocal_end + 1.0)).otherwise(scene_end)
    show = F.greatest(scene_start, F.coalesce(vocal_start, scene_start))
    return F.when(~F.coalesce(no_vocal, F.lit(False)),
                  F.struct(show.alias("show_at"), hide.alias("hide_at")))


def media_preference(style: Column | str, band: Column | str) -> Column:
    return F.when((_c(style) == "doodleMemory") & (_c(band) == "energetic"), "video").otherwise(
        "photo")


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split job requests into valid rows and rows with an ``error_code``.

    Columns: kind, source_job_id, target_seconds, style, privacy, title, url, authorized.
    """
    kind, target = F.col("kind"), F.col("target_seconds")

    def outside(lo: float, hi: float) -> Column:
        return ~F.coalesce(target.between(lo, hi), F.lit(False))

    def not_in(col: str, values: Sequence[str]) -> Column:
        return ~F.coalesce(F.col(col).isin(list(values)), F.lit(False))

    needs_source = kind.isin(*fixed.SOURCE_KINDS)
    code = (
        F.when(~F.coalesce(kind.isin(*fixed.SOURCE_KINDS, "download"), F.lit(False)),
               "invalid_request")
        .when(needs_source & ~valid_key("source_job_id"), "not_found")
        .when((kind == "publish_youtube") & not_in("privacy", fixed.PRIVACY_LEVELS),
              "invalid_request")
        .when((kind == "render") & not_in("style", fixed.RENDER_STYLES), "invalid_request")
        .when((kind == "plan") & (not_in("style", fixed.PLAN_STYLES) | outside(5, 120)),
              "invalid_request")
        .when((kind == "subtitle_preview") & (not_in("style", fixed.SUBTITLE_STYLES)
                                              | outside(5, 120)), "invalid_request")
        .when((kind == "lyrics") & (strip(text_or_empty("title")) == ""), "invalid_request")
        .when((kind == "analyze") & outside(10, 120), "invalid_request")
        .when((kind == "download") & F.col("url").isNull(), "invalid_url")
        .when((kind == "download") & ~F.coalesce(F.col("authorized"), F.lit(False)),
              "not_authorized")
        .when((kind == "download") & extract_video_id("url").isNull(), "invalid_url"))
    checked = df.withColumn("error_code", code)
    return (checked.filter(F.col("error_code").isNull()).drop("error_code"),
            checked.filter(F.col("error_code").isNotNull()))


def contract_report(df: DataFrame, key: Sequence[str], checks: dict[str, Column] | None = None
                    ) -> DataFrame:
    """One row per key and check with its outcome, plus ``all_passed`` of the key.

    A key is one row of ``df``, so the outcome needs no shuffle.
    """
    if checks is None:
        has_video = F.col("vcodec").isNotNull()
        checks = {
            "video stream present": has_video,
            "codec h264": F.col("vcodec") == "h264",
            "1080x1920": (F.col("width") == 1080) & (F.col("height") == 1920),
            "30 fps": F.col("frame_rate") == "30/1",
            "yuv420p": F.col("pix_fmt") == "yuv420p",
            "audio stream present (aac)": F.col("acodec") == "aac",
            "duration": F.col("expected").isNull()
            | (F.abs(F.col("duration") - F.col("expected")) < 0.25),
        }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed"))
                     for n, c in checks.items()])
    return (df.select(*key, rows.alias("_r"))
            .withColumn("all_passed", F.forall("_r", lambda r: r["passed"]))
            .select(*key, "all_passed", F.inline("_r")))
