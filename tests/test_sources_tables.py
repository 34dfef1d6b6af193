"""Sources, text functions, table upkeep and plans on hand-made rows."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cuework.functions import hashing as hs
from cuework.functions import predicates as pr
from cuework.functions import text as tx
from cuework.operators import joins as J
from cuework.operators import tables as tb
from cuework.plans import lyrics, scenes
from cuework.sources import documents as docs
from cuework.sources import lrc, sinks

LRC = ("[ar:Some Artist]\n[ti:Some Song]\n[offset:+500]\n[00:12.00]first line\n"
       "[00:15.50][01:20.25]  repeated   line \n[00:14]<00:14.00>one <00:14.80>two\nuntagged credit\n[01:02.123]\n")


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first().x


def test_lrc(spark):
    df = spark.createDataFrame([("a", LRC), ("junk", "no tags at all\n<html>"), ("none", None)], "k string, doc string")
    got = [(r.k, r.line_index, r.start, r.text) for r in lrc.parse_lrc(df, ["k"], "doc").orderBy("k", "line_index").collect()]
    assert got == [("a", 0, 11.5, "first line"), ("a", 1, 13.5, "one two"), ("a", 2, 15.0, "repeated line"),
                   ("a", 3, pytest.approx(61.623), ""), ("a", 4, 79.75, "repeated line")]
    words = [(r.line_index, r.start, r.text) for r in lrc.parse_lrc_words(df, ["k"], "doc").collect()]
    assert words == [(1, 13.5, "one"), (1, pytest.approx(14.3), "two")]
    meta = {r.name: r.value for r in lrc.parse_lrc_meta(df, ["k"], "doc").collect()}
    assert meta == {"ar": "Some Artist", "ti": "Some Song", "offset": "+500"}
    assert lrc.parse_lrc(df, ["k"], "doc", keep_empty=False).count() == 4


def test_corpus_files(spark):
    with tempfile.TemporaryDirectory() as d:
        for name, body in {"Band - Tune.lrc": "[00:01.00]x", "loose.txt": "plain", "b - c.txt": "[00:02.00]y", "skip.md": "z"}.items():
            with open(os.path.join(d, name), "w") as fh:
                fh.write(body)
        got = sorted((r.artist, r.title, r.plain_text, r.lrc_text) for r in docs.read_text_corpus(spark, d).collect())
    assert got == [("", "loose", "plain", ""), ("Band", "Tune", "", "[00:01.00]x"), ("b", "c", "", "[00:02.00]y")]


def test_urls_and_keys(spark):
    vid = "dQw4w9WgXcQ"
    good = [f"https://www.youtube.com/watch?v={vid}", f"http://youtube.com/watch?list=x&v={vid}", f"https://youtu.be/{vid}?t=3",
            f"https://m.youtube.com/shorts/{vid}", f"  https://music.youtube.com/watch?v={vid}  ", f"HTTPS://YOUTUBE.com/embed/{vid}"]
    bad = ["", None, "ftp://youtube.com/watch?v=" + vid, f"https://youtube.com.evil.io/watch?v={vid}", "https://youtu.be/short",
           f"https://youtube.com/watch?v={vid}x", f"https://www.youtube.com/watch?v={vid}&p=" + "x" * 2100, "not a url", f"https://youtube.com/playlist?v={vid}"]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    got = [r.x for r in df.select(pr.extract_video_id("u").alias("x")).collect()]
    assert got == [vid] * len(good) + [None] * len(bad)
    assert one(spark, pr.valid_key("k"), k="0" * 32) and not one(spark, pr.valid_key("k"), k="../" + "0" * 32)


def test_titles(spark):
    cases = {"Song (Official Video) [4K]": "Song", "Band - Song | Channel": "Band - Song", "Song feat. Someone": "Song",
             "“Song” Official Music Video": "Song", "Song - Lyric Video HD": "Song"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r.x for r in df.select(tx.clean_track_name("t").alias("x")).collect()] == list(cases.values())
    assert one(spark, tx.normalize_title("t"), t="Café (Live) — Official HD") == "cafe"
    assert one(spark, tx.split_artist_title("t"), t="A - B - C") == ("A", "B - C")
    assert one(spark, tx.guess_artist_title("t", "c"), t="Just Song", c="Band - Topic") == ("Band", "Just Song")
    for raw, norm in {"Hold,": "hold", "don’t": "dont", "café!": "cafe", "—": ""}.items():
        assert one(spark, tx.normalize_token("t"), t=raw) == norm == one(spark, tx.normalize_token_exact("t"), t=raw)
    q = tx.expand_queries(spark.createDataFrame([(1, "", "Band - Tune (Official Video)", 200.0)], "k int, artist string, title string, duration double"), ["k"])
    assert [(r.kind, r.artist, r.title, r.query) for r in q.orderBy("query_index").collect()] == [
        ("exact", "Band", "Tune", None), ("search", None, None, "Band Tune"), ("search", None, None, "Tune"),
        ("search", None, None, "Band - Tune (Official Video)")]


def wrapped(text, width):
    lines, cur = [], ""
    for w in text.split():
        if cur and len(cur) + 1 + len(w) > width:
            lines.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}".strip()
        broken = len(cur) > width
        while broken and len(cur) > width - 1:
            lines.append(cur[:width - 1] + "-")
            cur = cur[width - 1:]
    return lines + ([cur] if cur else [])


def measured(text, room, widths, default):
    size = lambda x: sum(widths.get(c, default) for c in x)
    lines, cur = [], ""
    for w in text.split():
        if cur and size(f"{cur} {w}") > room:
            lines.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}".strip()
        if size(cur) > room:
            piece = ""
            for c in cur:
                if piece and size(piece + c + "-") > room:
                    lines.append(piece + "-")
                    piece = c
                else:
                    piece += c
            cur = piece
    return lines + ([cur] if cur else [])


def test_wrap_by_a_measure(spark):
    rng = random.Random(4)
    widths = {"i": 1, "l": 1, " ": 3, "-": 2, "m": 9}
    texts = ["", "short", "m", "mmmm im", "-" * 30] + [" ".join("".join(rng.choices("ilm-xé", k=rng.randint(1, 14)))
                                                                 for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for room, default in ((20, 4), (8, 4), (5, 6)):
        got = {r.t: r.x for r in df.select("t", tx.wrap_measured("t", room, widths, default).alias("x")).collect()}
        assert got == {t: measured(t, room, widths, default) for t in texts}
    assert one(spark, tx.wrap_measured("t", 3, {}, 1), t="ab cd") == ["ab", "cd"]


def test_wrap_and_language(spark):
    for text in ["short", "the quick brown fox jumps", "x" * 37 + " end", "", "aaaa " + "b" * 25 + " cc"]:
        assert one(spark, tx.wrap_text("t", 10), t=text) == wrapped(text, 10)
    langs = {"привет мир как дела": "ru", "γειά σου κόσμε": "el", "שלום עולם": "he", "مرحبا بالعالم": "ar",
             "seni çok seviyorum bu gece": "tr", "hello world again": None, "   ": None}
    df = spark.createDataFrame([(k,) for k in langs], "t string")
    assert [r.x for r in df.select(tx.guess_language("t").alias("x")).collect()] == list(langs.values())


def test_hashes(spark):
    df = spark.createDataFrame([("ffffffffffffffff",), ("8000000000000000",), ("1f",)], "h string")
    vals = [r.x for r in df.select(hs.hash_from_hex("h").alias("x")).collect()]
    assert vals == [-1, -(1 << 63), 31]
    assert one(spark, hs.hamming("a", "b"), a=-1, b=0) == 64
    px = [float(i % 5) for i in range(72)]
    bits = 0
    for r in range(8):
        for c in range(8):
            bits = bits << 1 | (px[r * 9 + c] > px[r * 9 + c + 1])
    got = spark.createDataFrame([(px,)], "p array<double>").select(hs.gradient_hash("p", 9, 8).alias("x")).first().x
    assert got & (2 ** 64 - 1) == bits


def test_media_json_and_rules(spark):
    photo = {"photos": [{"id": 1, "width": 3000, "height": 4500, "url": "p", "photographer": "x", "alt": "rain", "src": {"large2x": "d"}},
                        {"id": 2, "src": {}}]}
    video = {"videos": [{"id": 7, "duration": 0, "video_files": [{"link": "a", "height": 720, "width": 406}, {"link": "b", "height": 1920, "width": 1080}]}]}
    df = spark.createDataFrame([("q", json.dumps(photo), json.dumps(video))], "query string, p string, v string")
    p = docs.media_candidates_from_json(df, "pexels", "photo", "p").collect()
    assert [(r.provider_ref, r.download_url, r.height) for r in p] == [("1", "d", 4500)]
    v = docs.media_candidates_from_json(df, "pexels", "video", "v").first()
    assert (v.download_url, v.height, v.duration) == ("b", 1920, None)
    c = spark.createDataFrame([("photo", 800, 1200, "", None), ("photo", 3000, 4500, "city watermark", None), ("video", 406, 720, "", 30.0),
                               ("video", 1080, 1920, "", 2.0), ("photo", 4500, 3000, "", None), ("gif", 9, 9, "", None)],
                              "kind string, width int, height int, tags string, duration double")
    why = [r.x for r in c.select(pr.reject_reason(F.lit(6.0)).alias("x")).collect()]
    assert "enlargement" in why[0] and "watermark" in why[1] and "1080" in why[2] and "too short" in why[3]
    assert why[4] is None and why[5] == "unsupported kind 'gif'"


def test_contract_and_messages(spark):
    row = ("f.mp4", "h264", "yuv420p", "30/1", "aac", 1080, 1920, 20.1, 20.0)
    ddl = ("path string, vcodec string, pix_fmt string, frame_rate string, acodec string, width int, height int, "
           "duration double, expected double")
    bad = ("g.mp4", "vp9", "yuv420p", "30/1", None, 1080, 1920, 21.0, 20.0)
    r = pr.contract_report(spark.createDataFrame([row, bad], ddl), ["path"]).collect()
    assert {x.path: x.all_passed for x in r} == {"f.mp4": True, "g.mp4": False}
    assert sorted(x.check for x in r if not x.passed) == ["audio stream present (aac)", "codec h264", "duration"]
    for m, code in {"ERROR: Sign in to confirm your age": "restricted", "geo restriction": "restricted", "blocked in your region": "restricted",
                    "Private video": "unavailable", "Unable to download webpage": "network", "unsupported url: x": "invalid_url",
                    "weird": "ytdlp_failed"}.items():
        assert one(spark, pr.classify_message("m")["code"], m=m) == code


def test_tables(spark):
    base = spark.createDataFrame([("a", "t", 1, 1), ("b", "t", 1, 1)], "k string, title string, created_at int, updated_at int")
    new = spark.createDataFrame([("b", "u", 5, 5), ("c", "v", 5, 5)], "k string, title string, created_at int, updated_at int")
    got = sorted(map(tuple, tb.upsert(base, new, ["k"], ["title"]).collect()))
    assert got == [("a", "t", 1, 1), ("b", "u", 1, 5), ("c", "v", 5, 5)]
    calls = spark.sparkContext.accumulator(0)

    def fn(batches):
        for b in batches:
            calls.add(len(b))
            yield b.assign(v=b["x"].str.upper())[["k", "v"]]
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "x string")
    memo = df.filter("x = 'a'").select(hs.content_key("x").alias("k"), F.lit("old").alias("v"))
    out, _ = tb.memo_enrich(df, ["x"], fn, memo)
    assert sorted(r.v for r in out.collect()) == ["B", "B", "old"] and calls.value == 1
    hist = spark.createDataFrame([("a", "f1", 3)], "job_id string, file_path string, created_at int")
    par = spark.createDataFrame([("a", 1, 1)], "job_id string, created_at int, updated_at int")
    h, p = sinks.append_history(hist, par, spark.createDataFrame([("a", "f2", 9), ("z", "f3", 8)], hist.schema), "job_id")
    assert h.count() == 3 and sorted(map(tuple, p.collect())) == [("a", 1, 9), ("z", 8, 8)]
    with tempfile.TemporaryDirectory() as d:
        path = sinks.write_version(p, f"{d}/projects", ["job_id"])
        assert spark.read.parquet(path).count() == 2


def test_resolve_with_transcript_fallback(spark):
    req = spark.createDataFrame([("a", "Band", "Tune", 100.0), ("b", "X", "Y", 50.0), ("c", "X", "Z", 50.0)],
                                "k string, artist string, title string, duration double")
    cand = spark.createDataFrame([("a", "p", "1", "Band", "Tune (Official Video)", "", 101.0, "", LRC, False, 0)],
                                 "k string, provider string, provider_ref string, artist string, title string, album string, duration double, "
                                 "plain_text string, lrc_text string, instrumental boolean, input_pos int")
    asr = spark.createDataFrame([("b", i, w, s, s + .2, .9) for i, (w, s) in enumerate([("one", 0.), ("two", .5), ("three", 4.)])]
                                + [("c", 0, "solo", 0.0, 0.2, 0.9)], "k string, pos int, text string, start double, end double, prob double")
    out = lyrics.resolve_lyrics(req, cand, ["k"], asr)
    got = {(r.k, r.line_index): r for r in out["lines"].collect()}
    assert got["a", 0].text == "first line" and got["a", 0].end == 13.5 and got["a", 3].end == pytest.approx(87.75)
    assert got["b", 0].text == "one two" and got["b", 1].text == "three" and got["b", 0].start is None
    assert {(r.k, r.provider) for r in out["chosen"].collect()} == {("a", "p"), ("b", "transcription")}


def test_translations(spark):
    ln = spark.createDataFrame([("a", 0, "hello", None, None), ("a", 1, "hello", None, "mine"), ("a", 2, "boom", None, None),
                                ("a", 3, "same", None, None), ("t", 0, "hello", None, None)],
                               "k string, line_index int, text string, corrected_text string, translation string")

    def tr(text, src, dst):
        if text == "boom":
            raise RuntimeError("no")
        return text.upper() if text == "same" else f"{dst}:{text}"
    langs = spark.createDataFrame([("a", "en"), ("t", "tr")], "k string, language string")
    out, memo = lyrics.backfill_translations(ln, tr, ["k"], langs)
    assert {(r.k, r.line_index): r.translation for r in out.collect()} == {
        ("a", 0): "tr:hello", ("a", 1): "mine", ("a", 2): None, ("a", 3): None, ("t", 0): None}
    assert {r.text for r in memo.collect()} == {"hello", "same"}


def test_scene_plan_invariants(spark):
    from cuework.queries.flows import scene_inputs
    from cuework.queries.registry import table
    t = lambda n: table(spark, "/root/testdata/sf0.001", n)
    args = scene_inputs(t)
    plans = [scenes.plan_scenes(**args)] + [scenes.plan_scenes(**{**args, "hot_rows": 20})]
    a, b = [sorted(map(str, p["scenes"].collect())) for p in plans]
    assert a == b
    per = {}
    for r in plans[0]["scenes"].collect():
        per.setdefault(r.user_id, []).append(r)
    heads = {r.user_id: r for r in plans[0]["header"].collect()}
    for user, ss in per.items():
        ss.sort(key=lambda r: r.scene_index)
        assert [s.scene_index for s in ss] == list(range(len(ss))) and ss[0].start == 0.0
        assert ss[-1].end == 90.0 and heads[user].scene_count == len(ss)
        assert heads[user].lyric_scene_count == sum(s.lyric is not None for s in ss)
        for s in ss:
            assert 1 <= len(s.queries) <= 5 and s.vocal_start >= s.start - 1e-6 and s.end > s.start
            assert s.lyric is None or s.line_index is not None
            assert not (s.no_vocal and s.lyric is None)
            assert s.duration <= 8.0 or s.lyric is not None
    beats = plans[0]["scene_beats"].collect()
    assert beats and all(r.rel >= 0 for r in beats)


def test_requery_and_corrections(spark):
    sc = spark.createDataFrame([("a", 0, ["x", "y"]), ("a", 1, ["z"]), ("a", 2, ["w"])], "k string, scene_index int, queries array<string>")
    ed = spark.createDataFrame([("a", 0, "y", None), ("a", 1, None, ["z", "n1", "n2", "n3", "n4"])],
                               "k string, scene_index int, query_text string, fresh array<string>")
    got = {r.scene_index: r.queries for r in scenes.requery(sc, ed, ["k"]).collect()}
    assert got == {0: ["y", "x"], 1: ["n1", "n2", "n3", "z"], 2: ["w"]}
    ln = spark.createDataFrame([(0, "t", "old", "tr"), (1, "t", "old", "tr")], "i int, text string, corrected_text string, translation string")
    ed = spark.createDataFrame([(0, "")], "i int, corrected_text string")
    out = {r.i: (r.corrected_text, r.translation) for r in J.apply_corrections(ln, ed, ["i"]).collect()}
    assert out == {0: (None, "tr"), 1: ("old", "tr")}
