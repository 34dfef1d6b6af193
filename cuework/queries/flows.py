"""Alignment, composite flows and streaming replays."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions import hashing as hs
from cuework.functions import text as tx
from cuework.operators import align, ranking as rk
from cuework.operators import joins as jn
from cuework.operators.windows import ordinal
from cuework.plans import lyrics, media, scenes
from cuework.queries.registry import DAY, E, EPOCH_US, QUERIES, SQL, of_type, query, r
from cuework.queries.texts import (MOVED_SQL, NOISY_SQL, PART_MEDIA_SQL, REJECT_SQL, SCRIPTS, TURKISH_SQL, noisy, part_media,
                                   sql_hash, sql_title, sql_token_set, sql_words)
from cuework.session import checkpoint
from cuework.sources.versions import read_buckets
from cuework.streaming import jobs

CONV = ["conv_id"]
LINES_SQL = """raw AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM conversations),
ln AS (SELECT conv_id, turn * 1000 + unnest(range(len(ls))) AS line_index, unnest(ls) AS text FROM raw)"""


def stored(fn):
    """Derived inputs stand for tables, so they are written down."""
    return lambda t: checkpoint(fn(t))


def conversation_lines(t) -> DataFrame:
    ln = tx.plain_lines(t("conversations"), ["conv_id", "turn"], "text")
    return ln.select("conv_id", (F.col("turn") * 1000 + F.col("line_index")).alias("line_index"), "text")


@stored
def conversation_asr(t) -> DataFrame:
    """The words of a conversation as heard: every seventh is missed, the rest follow each other."""
    w = conversation_lines(t).select("conv_id", "line_index", F.posexplode(tx.words_of("text")).alias("i", "text"))
    w = w.filter(F.col("i") % 7 != 3).withColumn("at", F.col("line_index") * 1000 + F.col("i"))
    w = ordinal(w, CONV, ["at"], "pos")
    return w.select("conv_id", "pos", "text", (F.col("pos") * 0.4).alias("start"),
                    (F.col("pos") * 0.4 + 0.3).alias("end"), F.lit(0.9).alias("prob"))


@stored
def conversation_spans(t) -> DataFrame:
    """Line times that run two seconds late, with every fifth line missing."""
    a = conversation_asr(t)
    ln = conversation_lines(t).withColumn("n", F.size(tx.words_of("text")))
    idx = ordinal(ln, CONV, ["line_index"], "seq")
    heard = a.groupBy("conv_id").agg(F.max("end").alias("stop"))
    total = ln.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    d = idx.join(heard, "conv_id").join(total, "conv_id").filter("seq % 5 <> 4")
    at = F.col("stop") * F.col("seq") / F.col("total")
    return d.select("conv_id", "line_index", (at + 2).alias("start"), (at + 4).alias("end"))


@query("m1_align_tokens")
def m1(t):
    lines, _, stats = align.align_lyrics(conversation_lines(t), conversation_asr(t), CONV)
    return lines.join(stats, "conv_id").select(
        "conv_id", "line_index", r("start", 3).alias("start_s"), r("end", 3).alias("end_s"),
        "confidence", "matched_ratio")


@query("m2_align_monotonic")
def m2(t):
    out = align.align_monotonic(conversation_lines(t), conversation_asr(t), CONV)
    return out.select("conv_id", "line_index", r("start", 3).alias("start_s"), "confidence",
                      F.size("words").alias("n_words"))


def marked_lines(t) -> DataFrame:
    """Conversation lines whose words carry their place, so that each can be heard at one place only."""
    ws = F.transform(tx.words_of("text"), lambda w, i: F.concat(w, F.lit("x"), (F.col("line_index") * 1000 + i).cast("string")))
    return conversation_lines(t).select("conv_id", "line_index", F.array_join(ws, " ").alias("text"))


def marked_asr(lines: DataFrame, heard) -> DataFrame:
    w = lines.select("conv_id", "line_index", F.posexplode(tx.words_of("text")).alias("i", "text")).filter(heard)
    w = ordinal(w.withColumn("at", F.col("line_index") * 1000 + F.col("i")), CONV, ["at"], "pos")
    return w.select("conv_id", "pos", F.concat("text", F.lit("!")).alias("text"), (F.col("pos") * 0.5).alias("start"),
                    (F.col("pos") * 0.5 + 0.25).alias("end"), F.lit(0.8713).alias("prob"))


MARKED_SQL = LINES_SQL + """, w AS (SELECT conv_id, line_index, unnest(range(len(ws))) AS i FROM (
  SELECT conv_id, line_index, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM ln))"""


@query("m1_align_marked", f"""WITH {MARKED_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY line_index, i) - 1 AS pos FROM w WHERE i % 7 <> 3),
o AS (SELECT conv_id, line_index, i, pos * 0.5 AS s, pos * 0.5 + 0.25 AS e, pos FROM w LEFT JOIN h USING (conv_id, line_index, i)),
g AS (SELECT *, lag(e) OVER x AS before, lead(s) OVER x AS after FROM o WINDOW x AS (PARTITION BY conv_id ORDER BY line_index, i)),
f AS (SELECT conv_id, line_index, pos IS NOT NULL AS ok, CASE WHEN pos IS NOT NULL THEN s WHEN after IS NOT NULL THEN before END AS s,
  CASE WHEN pos IS NOT NULL THEN e WHEN after IS NOT NULL THEN after END AS e,
  CASE WHEN pos IS NOT NULL THEN 0.8713 WHEN after IS NOT NULL THEN 0.2 ELSE 0 END AS c FROM g),
st AS (SELECT conv_id, round_even(avg(ok::INT), 4) AS matched_ratio FROM f GROUP BY 1)
SELECT conv_id, line_index, min(s)::DOUBLE AS start_s, max(e)::DOUBLE AS end_s, round_even(avg(c), 3)::DOUBLE AS confidence,
  any_value(matched_ratio)::DOUBLE AS matched_ratio FROM f JOIN st USING (conv_id) GROUP BY ALL""")
def m1_marked(t):
    """Every seventh word is not heard and has to be filled in between its neighbours."""
    ln = marked_lines(t)
    lines, _, stats = align.align_lyrics(ln, marked_asr(ln, F.col("i") % 7 != 3), CONV)
    return lines.join(stats, "conv_id").filter("text <> ''").select(
        "conv_id", "line_index", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "confidence", "matched_ratio")


@query("m2_align_marked", f"""WITH {MARKED_SQL}, v AS (SELECT *, line_index % 5 <> 2 AS sung FROM w),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY line_index, i) - 1 AS pos FROM v WHERE sung),
x AS (SELECT conv_id, line_index, sung, min(pos) * 0.5 AS s, max(pos) * 0.5 + 0.25 AS e, count(*) AS n FROM v LEFT JOIN h USING (conv_id, line_index, i, sung) GROUP BY ALL)
SELECT conv_id, line_index, s::DOUBLE AS start_s, CASE WHEN sung THEN greatest(e, s + 0.5) END::DOUBLE AS end_s, CASE WHEN sung THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
  CAST(n AS INTEGER) AS n_words FROM x""")
def m2_marked(t):
    """One line in five is not sung at all and stays without times; the others read as they stand."""
    ln = marked_lines(t)
    out = align.align_monotonic(ln, marked_asr(ln, F.col("line_index") % 5 != 2), CONV)
    return out.filter("text <> ''").select("conv_id", "line_index", F.col("start").alias("start_s"), F.col("end").alias("end_s"),
                                           "confidence", F.size("words").alias("n_words"))


@query("m3_align_from_spans", f"""WITH {LINES_SQL},
w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(lower(strip_accents(w)),
  '[^\\p{{L}}\\p{{N}}_]+', '', 'g') <> '')) AS n FROM ln)
SELECT conv_id, line_index, CASE WHEN line_index % 5 <> 4 THEN line_index * 2.0 END::DOUBLE AS start_s,
  CASE WHEN line_index % 5 <> 4 THEN line_index * 2.0 + CASE line_index % 3 WHEN 0 THEN 3 WHEN 1 THEN 0.8 ELSE 4 END END::DOUBLE AS end_s,
  CASE WHEN line_index % 5 <> 4 THEN 0.6 ELSE 0 END::DOUBLE AS confidence, n AS n_words FROM w""")
def m3(t):
    ln = conversation_lines(t)
    k = F.col("line_index")
    spans = ln.filter("line_index % 5 <> 4").select(
        "conv_id", "line_index", (k * 2.0).alias("start"),
        F.when(k % 3 == 1, k * 2.0 + 0.25).when(k % 3 == 2, k * 2.0 + 4).alias("end"))
    out = align.align_from_spans(ln, spans, CONV)
    return out.select("conv_id", "line_index", F.col("start").alias("start_s"), F.col("end").alias("end_s"),
                      "confidence", F.size("words").cast("long").alias("n_words"))


@query("m4_align_hybrid")
def m4(t):
    lines, stats = align.align_hybrid(conversation_lines(t), conversation_spans(t), conversation_asr(t), CONV)
    return lines.join(stats.select("conv_id", "mode"), "conv_id").select(
        "conv_id", "line_index", "mode", r("start", 3).alias("start_s"), "confidence")


@query("d2_resolve_lyrics", f"""WITH q AS (SELECT p_brand, min(p_name) AS want FROM part GROUP BY 1),
x AS (SELECT part.p_brand, p_partkey, want, {NOISY_SQL} AS title, p_size FROM part JOIN q USING (p_brand)),
n AS (SELECT *, {sql_title('title')} AS a, {sql_title('want')} AS b FROM x),
s AS (SELECT *, 0.35 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) + 0.25 * 1 + 0.20 * greatest(0, 1 - abs(p_size - 25) / 15)
  + 0.15 * (p_partkey % 2 = 0)::INT + 0.05 * 0.2 AS score FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 9) DESC, p_partkey) AS rn FROM s WHERE score >= 0.35)
SELECT p_brand, p_partkey::VARCHAR AS provider_ref, round(score, 5)::DOUBLE AS score, i AS line_index, ['first line', 'second line'][i + 1] AS text,
  CASE WHEN p_partkey % 2 = 0 THEN [1.0, 5.5][i + 1] END::DOUBLE AS start_s, CASE WHEN p_partkey % 2 = 0 THEN [5.5, 13.5][i + 1] END::DOUBLE AS end_s
FROM c, (SELECT unnest([0, 1])::INTEGER AS i) WHERE rn = 1""")
def d2(t):
    p, k = t("part"), F.col("p_partkey")
    req = p.groupBy("p_brand").agg(F.min("p_name").alias("n")).select(
        "p_brand", F.col("p_brand").alias("artist"), F.concat("n", F.lit(" (Official Video)")).alias("title"),
        F.lit(25.0).alias("duration"))
    even = k % 2 == 0
    cand = p.select(
        "p_brand", F.lit("catalogue").alias("provider"), k.cast("string").alias("provider_ref"),
        F.col("p_brand").alias("artist"), noisy().alias("title"), F.lit("").alias("album"),
        F.col("p_size").cast("double").alias("duration"),
        F.when(even, "").otherwise("first line\n\n second line ").alias("plain_text"),
        F.when(even, "[00:01.00]first line\n[00:05.50]second line").otherwise("").alias("lrc_text"),
        F.lit(False).alias("instrumental"), k.alias("input_pos"))
    out = lyrics.resolve_lyrics(req, cand, ["p_brand"], measure="levenshtein")
    return out["lines"].join(out["chosen"].select("p_brand", "provider_ref", "score"), "p_brand").select(
        "p_brand", "provider_ref", r("score", 5).alias("score"), "line_index", "text",
        F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query("d3_align_catalogue")
def d3(t):
    asr = conversation_asr(t)
    frames = asr.groupBy("conv_id", F.floor(F.col("start") / 0.5).alias("frame")).agg(
        F.count(F.lit(1)).cast("double").alias("energy"))
    out = lyrics.align_catalogue(conversation_lines(t), conversation_spans(t), asr, frames, CONV)
    return out["tracks"].join(out["offsets"].select("conv_id", "applied"), "conv_id", "left")


def scene_inputs(t) -> dict:
    """Users as tracks: an hour of the log is a second, purchases are sung lines of document text."""
    e = t("events").withColumn("s", F.col("t") / 3600)
    d = t("documents").select((F.col("doc_id")).alias("slot"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    docs = F.lit(max(1, t("documents").count()))
    lines = of_type(e, "purchase").withColumn("slot", F.col("event_id") % docs).join(d, "slot").select(
        "user_id", F.col("event_id").alias("line_index"), "text", F.lit(None).cast("string").alias("translation"),
        F.col("s").alias("start"), (F.col("s") + F.col("value") / 20).alias("end"),
        (F.col("value") < 20).alias("uncertain"))
    frames = e.groupBy("user_id", F.floor(F.col("s") / 0.5).alias("frame")).agg(F.max("value").alias("energy"))
    frames = frames.withColumn("energy", F.least(F.lit(1.0), F.col("energy") / 100))
    users = e.select("user_id").distinct()
    segs = users.select("user_id", (F.col("user_id") % 5 * 100.0).alias("segment_start"),
                        (F.col("user_id") % 5 * 100.0 + 90).alias("segment_end"))
    names = t("part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("title"))
    parts = F.lit(max(1, names.count()))
    tracks = users.withColumn("part", F.col("user_id") % parts).join(names, "part").select("user_id", "title", F.lit(96.0).alias("tempo_bpm"),
                          tx.cyclic_pick(F.col("user_id"), ["automatic", "doodleMemory", "minimalDark"]).alias("style"))
    words = lines.select("user_id", "line_index", (F.col("start") + 0.1).alias("start"), (F.col("end") - 0.1).alias("end"))
    regions = of_type(e, "signup").select("user_id", F.col("s").alias("start"), (F.col("s") + 20).alias("end"))
    themes = users.filter("user_id % 2 = 0").select("user_id", F.array(*map(F.lit, ["old harbour", "blue tram", "late snow"]))
                                                    .alias("extra_queries"))
    return dict(lines=lines, words=words, frames=frames, beats=of_type(e, "click").select("user_id", F.col("s").alias("t")),
                onsets=of_type(e, "view").select("user_id", F.col("s").alias("t")), segments=segs, tracks=tracks,
                lex=jn.lexicon(e.sparkSession), key=["user_id"], regions=regions, themes=themes)


@query("d4_plan_scenes")
def d4(t):
    out = scenes.plan_scenes(**scene_inputs(t))["scenes"]
    return out.withColumns({"subjects": F.array_join("subjects", "|"), "queries": F.array_join("queries", "|"),
                            "overlays": F.array_join("overlays", "|")})


@query("d4_plan_header")
def d4_header(t):
    return scenes.plan_scenes(**scene_inputs(t))["header"]


def ranked_media(t) -> DataFrame:
    """Every brand is a job with three scenes; its parts are the candidates of each of them."""
    k = F.col("p_partkey")
    h = t("embeddings").select((F.col("vec_id")).alias("slot"), hs.gradient_hash_long("embedding").alias("phash"))
    cand = part_media(t).withColumns({
        "provider": tx.cyclic_pick(k, ["pexels", "pixabay", "unsplash"]), "query": F.col("p_type"),
        "input_pos": k, "slot": k % F.lit(max(1, h.count()))}).join(h, "slot").select(
        "*", F.explode(F.array(*map(F.lit, range(3)))).alias("scene_index"))
    sc = t("part").select("p_brand").distinct().select(
        "p_brand", F.explode(F.array(*map(F.lit, range(3)))).alias("scene_index"))
    sc = sc.withColumns({"queries": F.array(tx.cyclic_pick(F.col("scene_index"), ["red ring", "cold gear", "small bolt"])),
                         "subjects": F.array(F.lit("widget")), "lyric": F.lit(""), "scene_duration": F.lit(5.0)})
    ok, _ = rk.rank_media(cand, sc, ["p_brand", "scene_index"])
    return ok.select(F.col("p_brand").alias("job_id"), "scene_index", "rank", "provider",
                     k.cast("string").alias("provider_ref"), "kind", "phash", "score", "width", "height")


@query("d5_assign_media", f"""WITH RECURSIVE m AS ({PART_MEDIA_SQL.replace('FROM part', ', p_brand, p_name, p_type FROM part')}),
h AS (SELECT vec_id, {sql_hash('embedding')} AS h FROM embeddings),
sc AS (SELECT unnest(range(3)) AS scene_index, unnest(['red ring', 'cold gear', 'small bolt']) AS q),
x AS (SELECT m.*, h, scene_index, {REJECT_SQL} AS reason, len(list_intersect({sql_token_set("q || ' widget'")}, {sql_token_set("tags || ' ' || p_type")})) AS ov
  FROM m, sc, h WHERE vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
y AS (SELECT *, least(width / 1080, height / 1920) AS head FROM x WHERE reason IS NULL AND kind = 'photo' AND p_partkey % 17 <> 0),
z AS (SELECT p_brand, scene_index, p_partkey, h, 0.45 * least(1, ov / 4) + 0.25 * CASE WHEN height > width THEN 1 WHEN height = width THEN 0.6 ELSE 0.35 END
  + 0.20 * least(1, greatest(0, (head - 0.8) / 1.2)) + 0.10 * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.85 END AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY scene_index, round(score, 9) DESC, p_partkey) AS n FROM z),
w AS (SELECT p_brand, 0::BIGINT AS n, -1::BIGINT AS scene_index, 0 AS slot, false AS ok, []::BIGINT[] AS used, []::BIGINT[] AS hashes, 0::BIGINT AS p_partkey, 0::BIGINT AS h, 0::DOUBLE AS score
    FROM (SELECT DISTINCT p_brand FROM r)
  UNION ALL SELECT p_brand, n, scene_index, taken, fits, CASE WHEN fits THEN list_append(used, p_partkey) ELSE used END,
    CASE WHEN fits THEN list_append(hashes, h) ELSE hashes END, p_partkey, h, score FROM (
    SELECT *, taken <= 2 AND NOT list_contains(used, p_partkey) AND len(list_filter(hashes, lambda o: bit_count(xor(o, h)) <= 8)) = 0 AS fits FROM (
      SELECT r.*, w.used, w.hashes, CASE WHEN r.scene_index <> w.scene_index THEN 0 WHEN w.ok THEN w.slot + 1 ELSE w.slot END AS taken
      FROM w JOIN r ON r.p_brand = w.p_brand AND r.n = w.n + 1)))
SELECT p_brand AS job_id, CAST(scene_index AS INTEGER) AS scene_index, CAST(slot AS INTEGER) AS slot, p_partkey::VARCHAR AS provider_ref, h AS phash,
  round(score, 6)::DOUBLE AS score FROM w WHERE ok""")
def d5(t):
    ranked = ranked_media(t)
    gone = ranked.filter("cast(provider_ref as bigint) % 17 = 0").select("job_id", "provider", "provider_ref").distinct()
    return media.assign_media(ranked, gone).select("job_id", "scene_index", "slot", "provider_ref", "phash",
                                                    rk.nearest("score", 6).alias("score"))


def tagging(text: str, source: str, target: str) -> str:
    if text.startswith("e") or text.startswith("E"):
        raise ValueError("cannot")
    return text if len(text) % 3 == 0 else f"{text} [{source}-{target}]"


@query("d6_backfill_translations", """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls, lang FROM documents),
x AS (SELECT doc_id, lang, CAST(unnest(range(len(ls))) AS INTEGER) AS line_index, unnest(ls) AS text FROM l)
SELECT doc_id, line_index, md5(CASE WHEN line_index % 4 = 0 THEN 'mine' WHEN lang = 'es' OR lower(text[1]) = 'e' OR length(text) % 3 = 0 THEN NULL
  ELSE text || ' [' || lang || '-es]' END) AS translation FROM x""")
def d6(t):
    d = t("documents")
    ln = tx.plain_lines(d, ["doc_id"], "text").withColumns({
        "corrected_text": F.lit(None).cast("string"),
        "translation": F.when(F.col("line_index") % 4 == 0, "mine")})
    langs = d.select("doc_id", F.col("lang").alias("language"))
    out, _ = lyrics.backfill_translations(ln, tagging, ["doc_id"], langs, target="es")
    return out.select("doc_id", "line_index", F.md5("translation").alias("translation"))


@query("d6_track_languages", f"""WITH m AS (SELECT conv_id, string_agg({MOVED_SQL.replace('doc_id', 'conv_id').replace('ELSE text', "ELSE coalesce(text, '')")},
    chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1),
b AS (SELECT conv_id, text, lower(text) AS t, length(lower(text)) - length(translate(lower(text), '{fixed.TURKISH_CHARS}', ''))
  AS hits, {sql_words('lower(text)')} AS ws, greatest(1, len(regexp_extract_all(text, '\\p{{L}}'))) AS n FROM m)
SELECT conv_id, CASE WHEN len(ws) = 0 THEN NULL WHEN {TURKISH_SQL} THEN 'tr'
  WHEN len(regexp_extract_all(text, '[{fixed.ARABIC}]')) / n > 0.3 THEN 'ar'
  WHEN len(regexp_extract_all(text, '[{fixed.CYRILLIC}]')) / n > 0.3 THEN 'ru'
  WHEN len(regexp_extract_all(text, '[{fixed.GREEK}]')) / n > 0.3 THEN 'el'
  WHEN len(regexp_extract_all(text, '[{fixed.HEBREW}]')) / n > 0.3 THEN 'he' END AS language FROM b""")
def d6_languages(t):
    """Conversations in five scripts in turn; a conversation's counts decide, whatever its single lines look like."""
    text = F.when(F.lit(False), F.col("text"))
    for k, (a, b) in SCRIPTS.items():
        text = text.when(F.col("conv_id") % 5 == k, F.translate("text", a, b))
    return lyrics.track_languages(t("conversations").withColumn("text", text.otherwise(F.col("text"))), CONV)


@query("d7_requery", """SELECT p_partkey, array_to_string(CASE p_partkey % 4 WHEN 0 THEN ['typed'] || list_filter(string_split(p_name, ' '), lambda x: x <> 'typed')
  WHEN 1 THEN [p_type, p_brand, 'x'] || string_split(p_name, ' ') ELSE string_split(p_name, ' ') END, '|') AS queries FROM part""")
def d7(t):
    k = F.col("p_partkey") % 4
    sc = t("part").select("p_partkey", F.lit(0).alias("scene_index"), F.split("p_name", " ").alias("queries"))
    ed = t("part").filter("p_partkey % 4 < 2").select(
        "p_partkey", F.lit(0).alias("scene_index"), F.when(k == 0, "typed").alias("query_text"),
        F.concat(F.slice(F.split("p_name", " "), 1, 1), F.array("p_type", "p_brand", F.lit("x"), F.lit("y"))).alias("fresh"))
    return scenes.requery(sc, ed, ["p_partkey"]).select("p_partkey", F.array_join("queries", "|").alias("queries"))


# --- streaming replays -------------------------------------------------------------------------------------------

def scratch(spark: SparkSession) -> str:
    """A folder every executor sees; a local one only for a local session without a shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if base is None and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="spark-")
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{base}/cuework-{uuid.uuid4().hex}"


DAYS = 5  # of a slice
DELAY = "12 days"
FILES = 4  # of a slice
#: Batch in which an event arrives: its slice, one later for some; the early ones among these again come last.
ARRIVAL = (f"CASE WHEN t < 2 * 86400 AND event_id % 10 = 7 THEN 6 ELSE least(5, CAST(floor(t / {DAYS * 86400}) AS INTEGER)) + "
           "CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END END")


def replay(name: str, sql: str, beat: bool = True):
    """Register a query that replays ``events`` as a stream: slices of five days in order of time, with a tenth of the
    rows one slice late and some far too late. With ``beat`` a last row much later moves the watermark past all others."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            folder = scratch(spark)
            events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
            t = (F.unix_micros("ts") - EPOCH_US) / 1e6
            sliced = events.withColumn("t", t).withColumn("arrival", F.expr(ARRIVAL))
            for i in range(7):
                sliced.where(F.col("arrival") == i).select(*events.columns).repartition(FILES).write.parquet(f"{folder}/in/n={i}")
            if beat:
                last = events.agg(F.max("ts").alias("ts")).select(F.expr("ts + interval 400 days").alias("ts"))
                empty = spark.createDataFrame([], events.schema)
                empty.unionByName(last, allowMissingColumns=True).write.parquet(f"{folder}/in/n=7")
            src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in/n=*")
            return fn(spark, src, folder)
        QUERIES[name] = run
        SQL[name] = sql
        return fn
    return add


def run_to_folder(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream to its end; every batch writes a folder, again if it is repeated. Adds the batch number ``b``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/b={batch_id}")

    q = (df.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema.add("b", "long")).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


# what a watermark of 12 days lets in
IN_TIME = f"{E}, i AS (SELECT * FROM e WHERE NOT (t < 2 * 86400 AND event_id % 10 = 7))"


@replay("str1_job_state", f"""WITH {IN_TIME}, j AS (SELECT *, user_id % 50 * 10 + CAST(floor(day(ts) / 4) AS INTEGER) AS job_id,
  CASE event_type WHEN 'purchase' THEN 'done' ELSE event_type END AS state FROM i),
s AS (SELECT job_id, ts, state, row_number() OVER (PARTITION BY job_id ORDER BY (state IN ('done', 'error')) DESC,
  CASE WHEN state IN ('done', 'error') THEN epoch_us(ts) ELSE -epoch_us(ts) END, state) AS rn FROM j)
SELECT job_id, epoch_us(ts) AS at_us, state FROM s WHERE rn = 1""")
def str1(spark, src, folder):
    """The last row the stream gives for a job is its state; states of finished jobs are dropped on the way."""
    j = src.withColumns({
        "job_id": F.col("user_id") % 50 * 10 + F.floor(F.dayofmonth("ts") / 4),
        "state": F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type"))})
    out = run_to_folder(jobs.job_state_stream(j.select("job_id", "ts", "state"), delay=DELAY, keep_seconds=4 * DAY), folder, "update")
    return out.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max_by(F.struct("ts", "state"), "b").alias("r")).select(
        "job_id", F.unix_micros("r.ts").alias("at_us"), "r.state")


@replay("str2_pause_sessions", f"""WITH {IN_TIME}, g AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM i),
k AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS isl FROM g)
SELECT user_id, round(min(t), 3) AS start_s, round(max(t), 3) AS end_s, count(*) AS items FROM k GROUP BY user_id, isl""")
def str2(spark, src, folder):
    out = run_to_folder(jobs.pause_sessions(src, ["user_id"], gap_seconds=43200.0, delay=DELAY), folder, "append")
    sec = lambda c: r((F.unix_micros(c) - EPOCH_US) / 1e6, 3)
    return out.where("user_id IS NOT NULL").select("user_id", sec("start").alias("start_s"), sec("end").alias("end_s"), "items")


@replay("str2_pause_groups", f"""WITH {IN_TIME}, l AS (SELECT *, t + round(value * 200, 6) AS f FROM i),
g AS (SELECT *, lag(f) OVER w AS p FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t)),
h AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS isl FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY t) - 1 AS n FROM h)
SELECT user_id, round(min(t), 3) AS start_s, round(max(f), 3) AS end_s, CAST(count(*) AS INTEGER) AS items,
  string_agg(event_type, ' ' ORDER BY t) AS text FROM k GROUP BY user_id, isl, n // 8""")
def str2_groups(spark, src, folder):
    """Every event lasts as long as its value says; a pause is counted from its end."""
    src = src.withColumn("length", F.col("value") * 200)
    out = run_to_folder(jobs.pause_groups(src, ["user_id"], "ts", "event_type", 21600.0, 8, DELAY, "length"), folder, "append")
    sec = lambda c: r((F.unix_micros(c) - EPOCH_US) / 1e6, 3)
    return out.where("user_id IS NOT NULL").select("user_id", sec("start").alias("start_s"), sec("end").alias("end_s"), "items", "text")


@replay("str3_ttl_dedupe", f"""WITH RECURSIVE {IN_TIME},
f AS (SELECT user_id, event_type, min(epoch_us(ts)) AS at_us FROM i GROUP BY ALL
  UNION ALL SELECT f.user_id, f.event_type, min(epoch_us(i.ts)) FROM f JOIN i ON f.user_id = i.user_id AND f.event_type = i.event_type
    AND epoch_us(i.ts) > f.at_us + 7 * 86400 * 1000000::BIGINT GROUP BY f.user_id, f.event_type, f.at_us)
SELECT * FROM f""")
def str3(spark, src, folder):
    out = run_to_folder(jobs.ttl_dedupe(src.select("user_id", "event_type", "ts"), ["user_id", "event_type"], delay=DELAY), folder, "append")
    return out.where("user_id IS NOT NULL").select("user_id", "event_type", F.unix_micros("ts").alias("at_us"))


@replay("str4_upsert_stream", f"""WITH {E}, a AS (SELECT *, {ARRIVAL} AS b FROM e),
f AS (SELECT user_id, max(epoch_us(ts)) AS created_us FROM (SELECT * FROM a QUALIFY b = min(b) OVER (PARTITION BY user_id)) GROUP BY 1)
SELECT user_id, event_id, round(value, 4) AS value, created_us FROM a JOIN f USING (user_id)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""", beat=False)
def str4(spark, src, folder):
    """Seven batches, late rows in all but the first; a key keeps the time of the first batch that had it."""
    rows = src.select("user_id", "event_id", "value", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    q = jobs.upsert_stream(rows, f"{folder}/table", ["user_id"], ["event_id", "value"], "updated_at", f"{folder}/checkpoint", 16)
    q.trigger(availableNow=True).start().awaitTermination()
    return read_buckets(spark, f"{folder}/table", rows.schema).select(
        "user_id", "event_id", r("value", 4).alias("value"), F.unix_micros("created_at").alias("created_us"))
