"""Sources, table upkeep, rollup joins and unions over the driver tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from cuework.functions import text as tx
from cuework.operators import joins as jn
from cuework.operators import ranking as rk
from cuework.operators import tables as tb
from cuework.queries.registry import E, of_type, query, r
from cuework.sources import documents as docs
from cuework.sources import lrc, sinks

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# --- sources ---------------------------------------------------------------------------------------------

@query("src1_text_corpus", """WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || ' - ' || source || '.lrc'
  WHEN 1 THEN lang || '.txt' WHEN 2 THEN lang || ' - ' || source || '.TXT' ELSE lang || '.pdf' END AS name, text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN split_part(name, ' - ', 1) ELSE '' END AS artist,
  CASE WHEN doc_id % 2 = 0 THEN regexp_replace(split_part(name, ' - ', 2), '\\.[^.]*$', '') ELSE regexp_replace(name, '\\.[^.]*$', '') END AS title,
  CASE WHEN doc_id % 4 = 0 OR contains(left(text, 2000), '[00:') THEN length(text) ELSE 0 END AS timed_chars,
  CASE WHEN doc_id % 4 = 0 OR contains(left(text, 2000), '[00:') THEN 0 ELSE length(text) END AS plain_chars FROM f WHERE doc_id % 4 <> 3""")
def src1(t):
    k = F.col("doc_id") % 4
    two = F.concat("lang", F.lit(" - "), "source")
    name = (F.when(k == 0, F.concat(two, F.lit(".lrc"))).when(k == 1, F.concat("lang", F.lit(".txt")))
            .when(k == 2, F.concat(two, F.lit(".TXT"))).otherwise(F.concat("lang", F.lit(".pdf"))))
    files = t("documents").select(F.concat(F.lit("/data/"), "doc_id", F.lit("/"), name).alias("path"),
                                  F.col("text").alias("body"))
    c = docs.corpus_candidates(files)
    return c.select(F.split("provider_ref", "/")[2].cast("long").alias("doc_id"), "artist", "title",
                    F.length("lrc_text").cast("long").alias("timed_chars"),
                    F.length("plain_text").cast("long").alias("plain_chars"))


def lrc_docs(t):
    """Documents as timed text: line i carries a tag at 2.5 i + 1 s; every fifth line carries a second
    one 1000 s on, and words of even documents are tagged; an offset moves all of it."""
    lines = F.filter(tx.lines_of("text"), lambda x: x != "")

    def stamp(sec):
        ms = F.format_string("%02d", F.floor(sec % 1 * 100).cast("int"))
        return F.concat(F.format_string("%02d:%02d", F.floor(sec / 60).cast("int"),
                                        F.floor(sec % 60).cast("int")), F.lit("."), ms)

    def one(x, i):
        sec = i * 2.5 + 1
        tags = F.concat(F.lit("["), stamp(sec), F.lit("]"), F.when(
            i % 5 == 0, F.concat(F.lit("["), stamp(sec + 1000), F.lit("]"))).otherwise(""))
        return F.concat(tags, F.when(F.col("doc_id") % 2 == 0, F.concat(
            F.lit("<"), stamp(sec + 0.25), F.lit(">"))).otherwise(""), x)

    return t("documents").select("doc_id", F.concat(
        F.lit("[ar:"), "source", F.lit("]\n[offset:+500]\ncredits without a tag\n"),
        F.array_join(F.transform(lines, one), "\r\n")).alias("lrc"))


LRC_SQL = """l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
    lambda x: x <> '') AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM l),
y AS (SELECT doc_id, i, 0 AS j, i * 2.5 + 0.5 AS s, raw FROM x UNION ALL SELECT doc_id, i, 1, i * 2.5 + 1000.5, raw FROM x WHERE i % 5 = 0),
z AS (SELECT doc_id, i, s::DOUBLE AS s, regexp_replace(raw, '\\s{2,}', ' ', 'g') AS txt, row_number() OVER (PARTITION BY doc_id ORDER BY s, i, j) - 1 AS li FROM y)"""


@query("src2_parse_lrc", f"WITH {LRC_SQL} SELECT doc_id, CAST(li AS INTEGER) AS line_index, s AS start_s, md5(txt) AS text FROM z")
def src2(t):
    return lrc.parse_lrc(lrc_docs(t), ["doc_id"], "lrc").select(
        "doc_id", "line_index", r("start", 3).alias("start_s"), F.md5("text").alias("text"))


@query("src2_parse_lrc_words", f"""WITH {LRC_SQL} SELECT doc_id, CAST(li AS INTEGER) AS line_index, 0 AS word_index,
  (i * 2.5 + 0.75)::DOUBLE AS start_s FROM z WHERE doc_id % 2 = 0""")
def src2_words(t):
    return lrc.parse_lrc_words(lrc_docs(t), ["doc_id"], "lrc").select(
        "doc_id", "line_index", "word_index", r("start", 3).alias("start_s"))


@query("src2_parse_lrc_meta", """SELECT doc_id, 'ar' AS name, source AS value FROM documents UNION ALL
SELECT doc_id, 'offset', '+500' FROM documents""")
def src2_meta(t):
    m = lrc.parse_lrc_meta(lrc_docs(t), ["doc_id"], "lrc")
    return m.filter(F.col("name").isin("ar", "offset"))


@query("src3_lyric_json", """SELECT c_custkey, 'lrclib' AS provider, CAST(c_custkey * 10 + i AS VARCHAR) AS provider_ref, c_name AS artist, c_mktsegment AS title,
  CASE WHEN i = 0 THEN 'plain ' || c_name ELSE '' END AS plain_text, i = 2 AS instrumental, i AS input_pos
FROM customer, (SELECT unnest([0, 2])::INTEGER AS i)""")
def src3(t):
    def item(i):
        return F.struct(
            (F.col("c_custkey") * 10 + i).alias("id"), F.col("c_name").alias("artistName"),
            F.col("c_mktsegment").alias("trackName"), F.col("c_acctbal").alias("duration"),
            (F.concat(F.lit("plain "), "c_name") if i == 0 else F.lit("")).alias("plainLyrics"),
            F.lit(None).cast("string").alias("syncedLyrics"), F.lit(i == 2).alias("instrumental"))
    df = t("customer").select("c_custkey", F.to_json(F.array(item(0), item(1), item(2))).alias("payload"))
    c = docs.lyric_candidates_from_json(df, ["c_custkey"], "payload")
    return c.select("c_custkey", "provider", "provider_ref", "artist", "title", "plain_text",
                    "instrumental", "input_pos")


def _media_payloads(t):
    p = t("part")
    k, w = F.col("p_partkey"), (700 + F.col("p_size") * 30).cast("int")
    link = F.when(k % 5 != 0, F.concat(F.lit("http://x/"), k))
    s = F.struct

    def rendition(h, ok=True):
        return s((F.concat(F.lit("http://v/"), k, F.lit(f"/{h}")) if ok else F.lit("")).alias("link"),
                 F.lit(h // 2).alias("width"), F.lit(h).alias("height"))

    def small(h):
        return s(F.concat(F.lit("http://v/"), k, F.lit(f"/{h}")).alias("url"), F.lit(h // 2).alias("width"),
                 F.lit(h).alias("height"))
    user = s(F.col("p_brand").alias("name"), F.lit("http://u").alias("url"),
             s(F.lit("http://h").alias("html")).alias("links"))
    files = F.when(k % 3 == 0, F.array(rendition(720), rendition(2160), rendition(1080))).when(
        k % 3 == 1, F.array(rendition(480), rendition(720))).otherwise(F.array(rendition(1080, False)))
    none = F.lit(None).cast("struct<url:string,width:int,height:int>")
    videos = s(F.when(k % 3 == 0, small(1440)).otherwise(none).alias("large"),
               F.when(k % 3 == 1, small(720)).otherwise(none).alias("medium"), small(360).alias("small"))
    box = lambda name, *cols: F.to_json(s(F.array(s(k.alias("id"), *cols)).alias(name)))
    name, price = F.col("p_name"), F.lit(2000)
    return p.select(
        k.alias("part"), name.alias("query"),
        box("photos", w.alias("width"), price.alias("height"), F.lit("http://p").alias("url"),
            F.col("p_brand").alias("photographer"), name.alias("alt"),
            s(F.lit("").alias("original"), link.alias("large2x")).alias("src")).alias("pexels_photo"),
        box("videos", user.alias("user"), F.lit(0.0).alias("duration"), files.alias("video_files")).alias("pexels_video"),
        box("hits", w.alias("imageWidth"), price.alias("imageHeight"), link.alias("largeImageURL"),
            F.col("p_brand").alias("user"), name.alias("tags")).alias("pixabay_photo"),
        box("hits", F.lit(7.0).alias("duration"), F.col("p_brand").alias("user"), videos.alias("videos")).alias("pixabay_video"),
        box("results", w.alias("width"), price.alias("height"), s(F.lit(None).cast("string").alias("raw"), link.alias("full")).alias("urls"),
            user.alias("user"), name.alias("alt_description"), F.col("p_type").alias("description")).alias("unsplash_photo"))


@query("src4_src5_media_json", """WITH p AS (SELECT *, CAST(700 + p_size * 30 AS INTEGER) AS w, p_partkey % 3 AS m FROM part)
SELECT p_partkey AS part, 'pexels' AS provider, 'photo' AS kind, w AS width, 2000 AS height, 'http://x/' || p_partkey AS download_url, p_brand AS creator, p_name AS tags FROM p WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'pixabay', 'photo', w, 2000, 'http://x/' || p_partkey, p_brand, p_name FROM p WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'unsplash', 'photo', w, 2000, 'http://x/' || p_partkey, p_brand, p_name || ' ' || p_type FROM p WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'pexels', 'video', CASE m WHEN 0 THEN 1080 ELSE 360 END, CASE m WHEN 0 THEN 2160 ELSE 720 END,
  'http://v/' || p_partkey || CASE m WHEN 0 THEN '/2160' ELSE '/720' END, p_brand, '' FROM p WHERE m <> 2
UNION ALL SELECT p_partkey, 'pixabay', 'video', CASE m WHEN 0 THEN 720 WHEN 1 THEN 360 ELSE 180 END, CASE m WHEN 0 THEN 1440 WHEN 1 THEN 720 ELSE 360 END,
  'http://v/' || p_partkey || CASE m WHEN 0 THEN '/1440' WHEN 1 THEN '/720' ELSE '/360' END, p_brand, '' FROM p""")
def src4(t):
    p = _media_payloads(t)
    out = None
    for provider, kind in (("pexels", "photo"), ("pexels", "video"), ("pixabay", "photo"),
                           ("pixabay", "video"), ("unsplash", "photo")):
        one = docs.media_candidates_from_json(p, provider, kind, f"{provider}_{kind}", keep=["part"])
        out = one if out is None else out.unionByName(one)
    return out.select("part", "provider", "kind", "width", "height", "download_url", "creator", "tags")


@query("src6_info_json", """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS video_id, c_name AS title,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'channel' END AS uploader, c_acctbal AS duration FROM customer""")
def src6(t):
    k = F.col("c_custkey")
    df = t("customer").select("c_custkey", F.concat(F.lit("u"), k).alias("url"), F.to_json(F.struct(
        k.alias("id"), F.col("c_name").alias("title"), F.when(k % 2 == 0, F.col("c_mktsegment"))
        .otherwise("").alias("uploader"), F.lit("channel").alias("channel"),
        F.col("c_acctbal").alias("duration"))).alias("payload"))
    return docs.tracks_from_info_json(df, "payload", "url", ["c_custkey"]).select(
        "c_custkey", "video_id", "title", "uploader", "duration")


@query("src7_manual_candidates", """WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[01:23] ' || text WHEN 1 THEN left(text, 9) ELSE text END AS b FROM documents),
s AS (SELECT doc_id, regexp_replace(b, '^\\s+|\\s+$', '', 'g') AS b FROM m)
SELECT doc_id, least(20000, length(b)) AS chars, regexp_matches(b, '\\[\\d{1,3}:\\d{2}') AS timed FROM s WHERE length(b) >= 10""")
def src7(t):
    k = F.col("doc_id") % 3
    df = t("documents").select("doc_id", F.lit("a").alias("artist"), F.lit("b").alias("title"), F.when(
        k == 0, F.concat(F.lit("[01:23] "), "text")).when(k == 1, F.left("text", F.lit(9)))
        .otherwise(F.col("text")).alias("text"))
    ok, _ = docs.manual_candidates(df, ["doc_id"])
    return ok.select("doc_id", F.length(F.concat("plain_text", "lrc_text")).cast("long").alias("chars"),
                     (F.col("lrc_text") != "").alias("timed"))


@query("src8_licensed_manifest", """WITH x AS (SELECT p_brand, p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CC BY-SA' WHEN 1 THEN 'Public domain' WHEN 2 THEN 'CC0 1.0' ELSE '' END AS lic,
  1000 + p_size * 10 AS w FROM part)
SELECT p_brand AS slug, arg_min(p_partkey, p_partkey) AS picked, CAST(arg_min(w, p_partkey) AS INTEGER) AS width FROM x WHERE p_partkey % 4 IN (1, 2) AND w >= 1200 AND p_partkey % 5 <> 0 GROUP BY 1""")
def src8(t):
    k = F.col("p_partkey")
    lic = F.when(k % 4 == 0, "CC BY-SA").when(k % 4 == 1, "Public domain").when(k % 4 == 2, "CC0 1.0")
    page = F.struct(
        k.cast("int").alias("index"), k.cast("string").alias("title"),
        F.array(F.struct(F.when(k % 5 != 0, "http://f").alias("url"),
                         (1000 + F.col("p_size") * 10).alias("width"), F.lit(900).alias("height"),
                         F.struct(F.struct(lic.alias("value")).alias("LicenseShortName"))
                         .alias("extmetadata"))).alias("imageinfo"))
    pages = t("part").select(F.col("p_brand").alias("slug"), F.col("p_brand").alias("query"),
                             F.to_json(F.create_map(k.cast("string"), page)).alias("pages"))
    m = docs.licensed_manifest(pages)
    return m.select("slug", F.col("title").cast("long").alias("picked"), "width")


# --- sinks --------------------------------------------------------------------------------------------------

@query("snk1_replace_keys", """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, l_quantity * 2 FROM lineitem WHERE l_orderkey % 10 = 0""")
def snk1(t):
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    new = li.filter("l_orderkey % 10 = 0").withColumn("l_quantity", F.col("l_quantity") * 2)
    return sinks.replace_keys(li, new, ["l_orderkey"])


@query("snk2_plan_documents", """SELECT o_orderkey, count(l_orderkey) AS scenes, min(l_partkey) AS low, o_orderstatus AS status
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def snk2(t):
    scenes = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    d = sinks.plan_documents(scenes, t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"],
                             "l_partkey")
    back = F.from_json("document", "o_orderstatus string, scenes array<struct<l_partkey:bigint,l_linenumber:int>>")
    return d.select("o_orderkey", back.alias("d")).select(
        "o_orderkey", F.size("d.scenes").cast("long").alias("scenes"),
        F.get("d.scenes", F.lit(0))["l_partkey"].alias("low"), F.col("d.o_orderstatus").alias("status"))


@query("snk3_attribution", """SELECT p_brand AS job_id, p_partkey AS scene_index, p_type AS provider, p_name AS creator, 'L' AS license, 'http://p/' || p_partkey AS page_url FROM part""")
def snk3(t):
    a = t("part").select(F.col("p_brand").alias("job_id"), F.col("p_partkey").alias("scene_index"),
                         F.col("p_type").alias("provider"), F.col("p_name").alias("creator"),
                         F.lit("L").alias("license"),
                         F.concat(F.lit("http://p/"), "p_partkey").alias("page_url"), "p_size")
    return sinks.attribution(a)


@query("snk4_append_history", """WITH k AS (SELECT o_custkey AS j, max(epoch_us(o_orderdate)) AS m, min(epoch_us(o_orderdate)) AS f FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS j, c_name AS title, 757382400000000 AS c FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(p.j, k.j) AS job_id, title, coalesce(c, f) // 1000000 AS created_s, greatest(c, m) // 1000000 AS updated_s FROM p FULL JOIN k ON p.j = k.j""")
def snk4(t):
    base = F.lit("1994-01-01").cast("timestamp")
    parents = t("customer").filter("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("job_id"), F.col("c_name").alias("title"), base.alias("created_at"),
        base.alias("updated_at"))
    new = t("orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("file_path"),
                             F.col("o_orderdate").cast("timestamp").alias("created_at"))
    _, out = sinks.append_history(new.filter(F.lit(False)), parents, new, "job_id")
    return out.select("job_id", "title", F.unix_seconds("created_at").alias("created_s"),
                      F.unix_seconds("updated_at").alias("updated_s"))


# --- joins ---------------------------------------------------------------------------------------------------

@query("j8_apply_corrections", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_mktsegment) || '!' ELSE 'old' END AS display,
  CASE WHEN c_custkey % 4 = 1 THEN 'new' WHEN c_custkey % 4 = 3 THEN NULL ELSE 'keep' END AS translation FROM customer""")
def j8(t):
    k = F.col("c_custkey")
    lines = t("customer").select("c_custkey", F.col("c_name").alias("text"), F.lit("old").alias("corrected_text"),
                                 F.lit("keep").alias("translation"))
    edits = t("customer").filter("c_custkey % 4 <> 2").select(
        "c_custkey", F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit("! ")))
        .alias("corrected_text"), F.when(k % 4 == 1, "new").when(k % 4 == 3, "").alias("translation"))
    out = jn.apply_corrections(lines, edits, ["c_custkey"])
    return out.select("c_custkey", tx.display_text().alias("display"), "translation")


@query("j9_merge_fallback", f"""WITH {E}, x AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN t END AS s, t + 2 AS en, value / 100 AS c, t + 5 AS sa,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN t + 5.1 ELSE t + 9 END AS sb, event_id % 4 <> 0 AS has FROM e),
y AS (SELECT *, has AND NOT (c >= 0.45 AND s IS NOT NULL) AS need, greatest(coalesce(sb, sa + 3), sa + 0.8) AS b FROM x)
SELECT event_id, need AS rescued, round(CASE WHEN need THEN sa ELSE s END, 6) AS start_s, round(CASE WHEN need THEN b ELSE en END, 6) AS end_s,
  round(CASE WHEN need THEN 0.6 ELSE c END, 5) AS confidence, round(CASE WHEN need THEN (b - sa) / 2 ELSE 1 END, 2) AS word_len FROM y""")
def j9(t):
    k = F.col("event_id")
    word = lambda n: F.struct(F.lit(n).alias("text"), F.lit(1.0).alias("start"), F.lit(2.0).alias("end"),
                              F.lit(0.5).alias("confidence"))
    al = t("events").select("event_id", F.when(k % 3 != 0, F.col("t")).alias("start"), (F.col("t") + 2).alias("end"),
                            (F.col("value") / 100).alias("confidence"), F.array(word("a"), word("b")).alias("words"))
    seeds = t("events").filter("event_id % 4 <> 0").select(
        "event_id", (F.col("t") + 5).alias("seed_start"),
        F.when(k % 5 == 1, F.col("t") + 5.1).when(k % 5 != 0, F.col("t") + 9).alias("seed_end"))
    o = jn.merge_fallback(al, seeds, ["event_id"])
    w = F.element_at("words", 2)
    return o.select("event_id", "rescued", r("start").alias("start_s"), r("end").alias("end_s"),
                    r("confidence", 5).alias("confidence"), r(w["end"] - w["start"], 2).alias("word_len"))


@query("j11_positional_join", """WITH p AS (SELECT conv_id, string_split(text, chr(10)) AS ls FROM conversations WHERE turn = 1),
c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT c.conv_id, turn, CASE WHEN ls IS NULL OR i > len(ls) THEN 'kept' ELSE nullif(trim(ls[i]), '') END AS translation FROM c LEFT JOIN p USING (conv_id)""")
def j11(t):
    c = t("conversations")
    rows = c.select("conv_id", "turn", F.lit("kept").alias("translation"))
    return jn.positional_join(rows, c.filter("turn = 1").select("conv_id", "text"), ["conv_id"], "turn")


@query("j13_anti_join_refs", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0)""")
def j13(t):
    li = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return jn.anti_join_refs(t("orders").select("o_orderkey"), li.filter("l_returnflag = 'R'"),
                             li.filter("l_discount = 0"), on=["o_orderkey"])


@query("j14_existence_flags", """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_order,
  c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS has_big FROM customer""")
def j14(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return jn.existence_flags(t("customer").select("c_custkey"), ["c_custkey"], has_order=o,
                              has_big=o.filter("o_totalprice > 450000"))


@query("j15_nest_children", """SELECT c_custkey, 0 AS page, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey DESC), '') AS newest
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def j15(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    out = jn.nest_children(t("customer").select("c_custkey"), o, ["c_custkey"], ["o_orderdate", "o_orderkey"],
                           "orders", descending=True)
    return out.select("c_custkey", F.col("page").cast("int").alias("page"), F.size("orders").cast("long").alias("n"),
                      F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",")
                      .alias("newest"))


# --- unions --------------------------------------------------------------------------------------------------

@query("u1_union_providers", """WITH a AS (SELECT user_id, event_id, list_position(['view', 'click', 'error', 'purchase', 'signup'], event_type) AS p, event_type
  FROM events WHERE NOT (event_type = 'click' AND event_id >= 500))
SELECT user_id, event_id % 7 AS slot, event_type AS source, event_id FROM a QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY p, event_id) = 1""")
def u1(t):
    e = t("events").select("user_id", (F.col("event_id") % 7).alias("slot"), "event_id", "event_type")
    parts = [(n, of_type(e, n).drop("event_type")) for n in ("view", "click", "error", "purchase", "signup")]
    broke = t("events").filter("event_type = 'click'").select(
        F.lit("click").alias("provider"), F.lit(500).alias("failed_at")).distinct()
    out = rk.union_providers(parts, ["user_id", "slot"], ["event_id"], broke)
    return out.select("user_id", "slot", "source", "event_id")


@query("u3_keep_set", """SELECT c_custkey AS job_id FROM customer WHERE c_custkey % 2 = 0 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def u3(t):
    return rk.keep_set(t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("job_id")),
                       t("orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("job_id")),
                       key="job_id")


# --- table upkeep ----------------------------------------------------------------------------------------------

@query("st1_upsert", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 3 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS created_at, CASE WHEN o_orderkey % 10 < 3 THEN 2 ELSE 1 END AS updated_at, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS style FROM orders""")
def st1(t):
    o, k = t("orders"), F.col("o_orderkey")
    base = o.filter("o_orderkey % 10 <> 0").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("created_at"),
                                                   F.lit(1).alias("updated_at"), F.col("o_orderpriority").alias("style"))
    new = o.filter("o_orderkey % 10 < 3").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"),
                                                 F.lit(2).alias("created_at"), F.lit(2).alias("updated_at"))
    return tb.upsert(base, new, ["o_orderkey"], ["price"])


@query("st2_patch", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'changed' ELSE c_name END AS title,
  CASE WHEN c_custkey % 4 = 2 THEN NULL WHEN c_custkey % 4 = 1 THEN 'm' ELSE c_mktsegment END AS note FROM customer""")
def st2(t):
    k = F.col("c_custkey") % 4
    base = t("customer").select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("note"))
    ch = t("customer").filter("c_custkey % 4 > 0").select(
        "c_custkey", F.when(k == 1, "changed").alias("title"), F.when(k == 1, "m").alias("note"), (k <= 2).alias("set_note"))
    return tb.patch(base, ch, ["c_custkey"], {"note": "set_note"})


@query("st3_ttl_lookup", f"""WITH c AS (SELECT user_id, event_type, max(ts) AS seen, max(event_id) AS payload FROM events GROUP BY ALL),
k AS (SELECT DISTINCT user_id, event_type FROM events UNION ALL SELECT DISTINCT user_id, 'absent' FROM events)
SELECT user_id, event_type, coalesce((epoch_us(TIMESTAMP '{NOW}') - epoch_us(seen)) / 1e6 <= 259200, false) AS hit,
  CASE WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(seen)) / 1e6 <= 259200 THEN payload END AS payload FROM k LEFT JOIN c USING (user_id, event_type)""")
def st3(t):
    e = t("events")
    cache = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("fetched_at"), F.max("event_id").alias("payload"))
    keys = e.select("user_id", "event_type").distinct()
    keys = keys.unionByName(e.select("user_id", F.lit("absent").alias("event_type")).distinct())
    return tb.ttl_lookup(keys, cache, ["user_id", "event_type"], now(), ttl=3 * 86400).select(
        "user_id", "event_type", "hit", "payload")


def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"k": b["k"], "v": b["text"].str.len().astype(str)})


@query("st4_memo_enrich", """WITH m AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN m.text IS NOT NULL THEN 'memo' ELSE CAST(length(d.text) AS VARCHAR) END AS v FROM documents d LEFT JOIN m ON m.text = d.text""")
def st4(t):
    from cuework.functions.hashing import content_key
    d = t("documents").select("doc_id", "text")
    memo = d.filter("doc_id % 2 = 0").select(content_key("text").alias("k"), F.lit("memo").alias("v")).distinct()
    out, _ = tb.memo_enrich(d, ["text"], lengths, memo)
    return out.select("doc_id", "v")


@query("st5_exclude", """WITH x AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.09)
SELECT 'asset' AS kind, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM x)
UNION ALL SELECT 'excluded', k FROM (SELECT l_orderkey AS k FROM x UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0)""")
def st5(t):
    refs = t("lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    a, x = tb.exclude(t("orders").select("o_orderkey"), t("orders").filter("o_orderkey % 50 = 0"), refs, ["o_orderkey"])
    return a.select(F.lit("asset").alias("kind"), "o_orderkey").unionByName(
        x.select(F.lit("excluded").alias("kind"), "o_orderkey"))


@query("st6_cascade_delete", """WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'orders' AS t, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey NOT IN (SELECT k FROM g)
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM g)
UNION ALL SELECT 'history', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem""")
def st6(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    left = tb.cascade_delete({"orders": t("orders").select("o_orderkey"), "lineitem": li, "history": li},
                             t("orders").filter("o_orderstatus = 'P'"), "o_orderkey", keep=["history"])
    out = None
    for n, df in left.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(n).alias("t"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("st7_plan_cleanup", f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'old preview' ELSE 'orphan' END AS why FROM events
WHERE (event_type IN ('click', 'error') AND user_id % 3 <> 0 AND user_id % 5 <> 0)
  OR (event_type = 'view' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 604800000000)""")
def st7(t):
    e = t("events")
    kind = F.when(F.col("event_type") == "click", "job").when(F.col("event_type") == "error", "media").when(
        F.col("event_type") == "view", "preview").otherwise("output")
    items = e.select(F.col("event_id").alias("path"), F.col("user_id").alias("job_id"), kind.alias("kind"),
                     F.col("ts").alias("mtime"))
    ids = e.select(F.col("user_id").alias("job_id")).distinct()
    out = tb.plan_cleanup(items, ids.filter("job_id % 3 = 0"), ids.filter("job_id % 5 = 0"), now())
    return out.select(F.col("path").alias("event_id"), "why")


@query("st8_apply_alignment", f"""WITH {E} SELECT event_id AS line_index, round(CASE WHEN event_type = 'click' THEN t + 1 ELSE t END, 6) AS start_s,
  CASE WHEN event_type = 'click' THEN 'new' ELSE 'old' END AS word FROM e""")
def st8(t):
    e = t("events")
    lines = e.select("user_id", F.col("event_id").alias("line_index"), F.col("t").alias("start"),
                     (F.col("t") + 1).alias("end"), F.lit(None).cast("double").alias("confidence"))
    words = lines.select("user_id", "line_index", F.lit(0).alias("word_index"), F.lit("old").alias("text"))
    al = of_type(e, "click").select("user_id", F.col("event_id").alias("line_index"), (F.col("t") + 1).alias("start"),
                                    (F.col("t") + 2).alias("end"), F.lit(0.9).alias("confidence"))
    al = al.unionByName(al.withColumn("line_index", -1 - F.col("line_index")))
    stats = e.select("user_id").distinct().select("user_id", F.lit(0.5).alias("matched_ratio"), F.lit(0.4).alias("mean_confidence"))
    tracks = stats.select("user_id", *[F.lit(None).cast(k).alias(c) for c, k in (
        ("matched_ratio", "double"), ("mean_confidence", "double"), ("aligned_at", "timestamp"))])
    ln, wd, _ = tb.apply_alignment(lines, words, al, al.select("user_id", "line_index", F.lit(0).alias("word_index"),
                                   F.lit("new").alias("text")), stats, tracks, ["user_id"], now())
    return ln.join(wd, ["user_id", "line_index"]).select("line_index", r("start").alias("start_s"), F.col("text").alias("word"))
