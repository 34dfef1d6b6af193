"""Readers: text corpora, search-result JSON, media JSON, video metadata, pasted text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuework import schemas
from cuework.functions import fixed_values as fixed
from cuework.functions.text import strip, text_or_empty
from cuework.operators.aggregates import dedupe_first


def corpus_candidates(files: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Candidates from text files (path, body): only .lrc and .txt, the stem gives the names."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    at = F.instr(stem, " - ")
    title = F.substring(stem, at + 3, F.length(stem))
    both = (at > 0) & (title != "")
    timed = (suffix == ".lrc") | F.contains(F.left(F.col(body), F.lit(2000)), F.lit("[00:"))
    return files.filter(suffix.isin(".lrc", ".txt")).select(
        F.lit("local_file").alias("provider"), F.col(path).alias("provider_ref"),
        F.when(both, F.trim(F.substring(stem, F.lit(1), at - 1))).otherwise("").alias("artist"),
        F.trim(F.when(both, title).otherwise(stem)).alias("title"),
        F.when(timed, "").otherwise(F.col(body)).alias("plain_text"),
        F.when(timed, F.col(body)).otherwise("").alias("lrc_text"))


def read_text_corpus(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scan folders of .lrc / .txt files, one whole file per row."""
    files = (spark.read.format("text").option("wholetext", True)
             .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{lrc,txt,LRC,TXT}")
             .load(paths if isinstance(paths, str) else list(paths))
             .select(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
                     .alias("path"), F.col("value").alias("body")))
    return corpus_candidates(files)


def lyric_candidates_from_json(df: DataFrame, key: Sequence[str], col: str,
                               provider: str = "lrclib") -> DataFrame:
    """Search-result arrays to candidates; results without any text or flag are skipped."""
    rows = df.select(*key, F.posexplode(F.from_json(col, schemas.LYRIC_SEARCH_JSON))
                     .alias("input_pos", "r"))
    plain, synced = text_or_empty("r.plainLyrics"), text_or_empty("r.syncedLyrics")
    flag = F.coalesce("r.instrumental", F.lit(False))
    return rows.filter((plain != "") | (synced != "") | flag).select(
        *key, F.lit(provider).alias("provider"), text_or_empty("r.id").alias("provider_ref"),
        text_or_empty("r.artistName").alias("artist"), text_or_empty("r.trackName").alias("title"),
        text_or_empty("r.albumName").alias("album"), F.col("r.duration").alias("duration"),
        plain.alias("plain_text"), synced.alias("lrc_text"), flag.alias("instrumental"),
        "input_pos")


def _given(*cols: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def best_rendition(files: Column) -> Column:
    """Tallest file of at least 1080 lines, else the tallest, of those with a link and a height."""
    ok = F.filter(files, lambda f: (F.coalesce(f["link"], F.lit("")) != "")
                  & (F.coalesce(f["height"], F.lit(0)) > 0))
    # first of equals: the position breaks ties downwards
    keyed = F.transform(ok, lambda f, i: F.struct(f["height"].alias("h"), (-i).alias("i"),
                                                  f.alias("f")))
    return F.array_max(keyed)["f"]


def media_candidates_from_json(df: DataFrame, provider: str, kind: str, col: str = "payload",
                               query: str = "query", keep: Sequence[str] = ()) -> DataFrame:
    """One provider's search JSON to the common candidate schema; no download link, no row."""
    schema = schemas.MEDIA_JSON[(provider, kind)]
    top = schema.split(" ", 1)[0]
    rows = df.select(*keep, F.col(query).alias("query"), F.posexplode(
        F.from_json(col, schema)[top]).alias("result_pos", "r"))
    none = F.lit(None).cast("double")
    if (provider, kind) == ("pexels", "photo"):
        out = dict(width="r.width", height="r.height", page_url="r.url",
                   download_url=_given("r.src.original", "r.src.large2x"), thumb_url="r.src.medium",
                   creator="r.photographer", creator_url="r.photographer_url", tags="r.alt",
                   license=F.lit("Pexels License"), duration=none)
    elif (provider, kind) == ("pexels", "video"):
        rows = rows.withColumn("b", best_rendition(F.col("r.video_files")))
        out = dict(width="b.width", height="b.height", page_url="r.url", download_url="b.link",
                   thumb_url="r.image", creator="r.user.name", creator_url="r.user.url",
                   tags=F.lit(""), license=F.lit("Pexels License"),
                   duration=F.nullif(F.col("r.duration"), F.lit(0.0)))
    elif (provider, kind) == ("pixabay", "photo"):
        out = dict(width="r.imageWidth", height="r.imageHeight", page_url="r.pageURL",
                   download_url=_given("r.largeImageURL", "r.fullHDURL"), thumb_url="r.previewURL",
                   creator="r.user", tags="r.tags", license=F.lit("Pixabay Content License"),
                   creator_url=F.concat(F.lit("https://pixabay.com/users/"), text_or_empty("r.user"),
                                        F.lit("-"), text_or_empty("r.user_id"), F.lit("/")),
                   duration=none)
    elif (provider, kind) == ("pixabay", "video"):
        def tall(name: str) -> Column:
            v = F.col(f"r.videos.{name}")
            return F.when((text_or_empty(v["url"]) != "") & (v["height"] >= 1080), v)
        # below 1080 the medium one is taken when it is listed at all, the small one otherwise
        spare = F.coalesce("r.videos.medium", "r.videos.small")
        rows = rows.withColumn("b", F.coalesce(tall("large"), tall("medium"), spare))
        out = dict(width="b.width", height="b.height", page_url="r.pageURL", download_url="b.url",
                   thumb_url=F.lit(""), creator="r.user", creator_url=F.lit(""), tags="r.tags",
                   license=F.lit("Pixabay Content License"),
                   duration=F.nullif(F.col("r.duration"), F.lit(0.0)))
    else:
        out = dict(width="r.width", height="r.height", page_url="r.links.html",
                   download_url=_given("r.urls.raw", "r.urls.full"), thumb_url="r.urls.small",
                   creator="r.user.name", creator_url="r.user.links.html",
                   tags=F.concat_ws(" ", F.nullif(F.col("r.alt_description"), F.lit("")),
                                    F.nullif(F.col("r.description"), F.lit(""))),
                   license=F.lit("Unsplash License"), duration=none)
    col_of = {k: F.col(v) if isinstance(v, str) else v for k, v in out.items()}
    text = ("page_url", "thumb_url", "creator", "creator_url", "tags")
    return rows.filter(text_or_empty(col_of["download_url"]) != "").select(
        *keep, "result_pos", F.lit(provider).alias("provider"),
        text_or_empty("r.id").alias("provider_ref"), F.lit(kind).alias("kind"),
        F.coalesce(col_of["width"], F.lit(0)).alias("width"),
        F.coalesce(col_of["height"], F.lit(0)).alias("height"),
        col_of["download_url"].alias("download_url"), "query", col_of["license"].alias("license"),
        *[text_or_empty(col_of[c]).alias(c) for c in text], col_of["duration"].alias("duration"))


def tracks_from_info_json(df: DataFrame, col: str, url: str, keep: Sequence[str] = ()) -> DataFrame:
    r = F.from_json(col, schemas.INFO_JSON)
    return df.withColumn("r", r).select(
        *keep, F.lit(True).alias("valid"), F.col("r.id").alias("video_id"),
        F.col("r.title").alias("title"), _given("r.uploader", "r.channel").alias("uploader"),
        F.col("r.duration").alias("duration"), F.col("r.thumbnail").alias("thumbnail_url"),
        F.col(url).alias("original_url"))


def manual_candidates(df: DataFrame, key: Sequence[str], text: str = "text", artist: str = "artist",
                      title: str = "title") -> tuple[DataFrame, DataFrame]:
    """(candidates from pasted text, rows too short to take)."""
    df = df.withColumn("_b", strip(text_or_empty(text)))
    timed = F.col("_b").rlike(r"\[\d{1,3}:\d{2}")
    body = F.left("_b", F.lit(20000))
    ok = df.filter(F.length("_b") >= 10).select(
        *key, F.lit("manual").alias("provider"), F.left(text_or_empty(artist), F.lit(200))
        .alias("artist"), F.left(text_or_empty(title), F.lit(200)).alias("title"),
        F.when(timed, "").otherwise(body).alias("plain_text"),
        F.when(timed, body).otherwise("").alias("lrc_text"), F.lit(1.0).alias("score"))
    return ok, df.filter(F.length("_b") < 10).drop("_b")


def licensed_manifest(df: DataFrame, slug: str = "slug", col: str = "pages", query: str = "query",
                      min_width: int = 1200) -> DataFrame:
    """First acceptable picture per slug: accepted licence, wide enough, with a link."""
    rows = df.select(slug, query, F.explode(F.map_values(F.from_json(
        col, schemas.LICENSED_PAGES_JSON))).alias("p"))
    rows = rows.withColumns({"i": F.try_element_at("p.imageinfo", F.lit(1)),
                             "at": F.coalesce("p.index", F.lit(99))})
    licence = text_or_empty("i.extmetadata.LicenseShortName.value")
    ok = F.exists(F.array(*map(F.lit, fixed.ACCEPTED_LICENSES)), lambda a: F.contains(
        F.lower(licence), a))
    rows = rows.filter(ok & (F.coalesce("i.width", F.lit(0)) >= min_width)
                       & _given("i.thumburl", "i.url").isNotNull()).select(
        slug, query, F.col("p.title").alias("title"),
        F.coalesce("i.extmetadata.DescriptionUrl.value", "i.descriptionurl").alias("source_page"),
        F.left(F.coalesce(_given("i.extmetadata.Artist.value"), F.lit("unknown")), F.lit(200))
        .alias("author"), licence.alias("license"), F.col("i.width").alias("width"),
        F.col("i.height").alias("height"), "at")
    return dedupe_first(rows, [slug], ["at", "title"]).drop("at")
