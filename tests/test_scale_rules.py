"""Results don't depend on size: large lexicons, long spans, hot keys of any order type, late rows, one call per key."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuework.functions import text as tx
from cuework.operators import joins as J
from cuework.operators import ordered as O
from cuework.operators import tables as tb
from cuework.plans import lyrics
from cuework.plans.media import assign_media, coverage
from cuework.sources.versions import read_buckets
from cuework.streaming import jobs


def test_lexicon_size_changes_nothing(spark):
    long = "abcdefghijklmnopqrstuvwxyzabcd"
    docs = spark.createDataFrame([(1, f"zzz rain {long}er bee rain bees"), (2, "nothing"), (3, None)], "k int, text string")
    small = [("rain",), (long,), ("bee",)]
    want = None
    for more in (0, 2100):
        lex = spark.createDataFrame(small + [(f"qqq{i}",) for i in range(more)], "stem string")
        got = sorted(map(tuple, J.lexicon_match(docs, lex, ["k"], "text").select("k", "stem", "pos").collect()))
        want = want or got
        assert got == want
    assert want == [(1, long, 1), (1, "bee", 2), (1, "rain", 0)] or sorted(want) == sorted(
        [(1, "rain", 0), (1, long, 1), (1, "bee", 2)])


def test_spans_of_any_length(spark):
    p = spark.createDataFrame([("a", float(i)) for i in range(0, 5000, 7)], "k string, t double")
    s = spark.createDataFrame([("a", 0.0, 1.0), ("a", 3.0, 4000.0), ("a", 10.0, 10.5)], "k string, start double, end double")
    n = J.points_in_spans(p, s, ["k"]).count()
    assert n == sum(1 for i in range(0, 5000, 7) for a, b in ((0, 1), (3, 4000), (10, 10.5)) if a <= i < b)


def test_rotate_keeps_all_own(spark):
    own = [f"own{i}" for i in range(9)]
    row = spark.range(1).select(tx.rotate_queries(F.array(*map(F.lit, own)), F.array(F.lit("t0"), F.lit("t1")), F.lit(0),
                                                  F.array(F.lit("song"))).alias("q")).first()
    assert row.q == ["own0", "t0", *own[1:], "t1"]


VALUES = {
    "outlier": ("double", [float(i) for i in range(999)] + [1e12]),
    "string": ("string", [f"{i:05d}" for i in range(1000)]),
    "timestamp": ("timestamp", [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * i) for i in range(1000)]),
    "date": ("date", [dt.date(1990, 1, 1) + dt.timedelta(days=i) for i in range(1000)]),
}


@pytest.mark.parametrize("name", VALUES)
def test_chunks_hold_as_many_rows(spark, name):
    kind, values = VALUES[name]
    df = spark.createDataFrame([("hot", v) for v in values] + [("cold", values[3]), ("hot", None)], f"k string, o {kind}")
    split = O.split_hot(df, ["k"], "o", hot_rows=100)
    sizes = {(r.k, r[O.CHUNK]): r["count"] for r in split.groupBy("k", O.CHUNK).count().collect()}
    assert max(sizes.values()) <= 200 and sizes["hot", -1] == 1 and len(sizes) >= 10
    ranks = O.unsplit(O.scan(split, ["k"], ["o"], {"n": ("count", F.lit(1))})).filter("k = 'hot' AND o IS NOT NULL")
    assert [r.n for r in ranks.orderBy("o").collect()] == list(range(1, 1001))


@pytest.mark.parametrize("hot", [None, 3])
@pytest.mark.parametrize("name", ["string", "timestamp"])
def test_newest_first(spark, name, hot):
    kind, values = VALUES[name]
    kids = spark.createDataFrame([("a", v) for v in values[:10]], f"k string, o {kind}")
    par = spark.createDataFrame([("a",), ("z",)], "k string")
    got = {r.k: [c.o for c in r.children] for r in J.nest_children(par, kids, ["k"], ["o"], descending=True, hot_rows=hot).collect()}
    assert got == {"a": values[:10][::-1], "z": []}


def test_many_scenes(spark):
    rows = [("j", s, r, "p", f"r{s}-{r}", "photo", None, 1.0) for s in (0, 1, 999, 1000, 1001, 1010) for r in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "job_id string, scene_index int, rank int, provider string, provider_ref string, "
                                     "kind string, phash long, score double")
    got = assign_media(df, df.limit(0).select("job_id", "provider", "provider_ref"))
    keys = [(r.scene_index, r.slot) for r in got.collect()]
    assert len(set(keys)) == len(keys) == 18
    cov = coverage(df.select("job_id", "scene_index").distinct(), got).first()
    assert (cov.fetched_count, cov.scene_count) == (6, 6)


def test_memo_pays_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(batches):
        for b in batches:
            calls.add(len(b))
            yield b.assign(v=b["x"].str.upper())[["k", "v"]]
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "x string")
    known = df.filter("x = 'a'").select(tb.content_key("x").alias("k"), F.lit("old").alias("v"))
    out, memo = tb.memo_enrich(df, ["x"], fn, known.union(known))
    assert sorted(r.v for r in out.collect()) == ["B", "B", "C", "old"] and memo.count() == 3 and out.count() == 4
    assert calls.value == 2


def test_translator_pays_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def translate(text, source, target):
        calls.add(1)
        return f"{text}!"
    lines = spark.createDataFrame([(1, i, t, None, None) for i, t in enumerate(["x", "y", "x"])],
                                  "k int, line_index int, text string, corrected_text string, translation string")
    out, memo = lyrics.backfill_translations(lines, translate, ["k"])
    assert sorted(r.translation for r in out.collect()) == ["x!", "x!", "y!"] and memo.count() == 2
    assert calls.value == 2


def test_equal_values_are_cut_along_the_ties(spark):
    """A hot key of one score, or without any, is cut by the columns that come next in the order."""
    rows = ([("same", 1.0, i) for i in range(1000)] + [("null", None, i) for i in range(900)] + [("null", 0.5, i) for i in range(50)]
            + [("mixed", float(i % 3 == 0), i) for i in range(900)] + [("small", 1.0, 1)])
    df = spark.createDataFrame(rows, "k string, o double, tie int")
    split = O.split_hot(df, ["k"], "o", 100, ["tie"])
    sizes = split.groupBy("k", O.CHUNK).count().collect()
    assert max(r["count"] for r in sizes) <= 200
    whole = O.split_hot(df, ["k"], "o", 100)
    assert whole.groupBy("k", O.CHUNK).count().agg({"count": "max"}).first()[0] == 1000
    for cut in (split, whole, df):
        got = O.scan(cut, ["k"], ["o", "tie"], {"n": ("count", F.lit(1))})
        want, seen = {}, {}
        for k, o, tie in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
            want[k, o, tie] = seen[k] = seen.get(k, -1) + 1
        assert {(r.k, r.o, r.tie): r.n for r in got.collect()} == want


def test_ttl_refills(spark):
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(days=d) for d in (0, 3, 8, 9, 70)]
    df = spark.createDataFrame([("a", t) for t in at], "k string, ts timestamp")
    got = sorted(r.ts for r in jobs.ttl_dedupe(df, ["k"], "ts", 7 * 86400).collect())
    assert got == [at[0], at[2], at[4]]


def test_late_rows_do_not_overwrite(spark, tmp_path):
    schema = "k string, v int, created_at timestamp, updated_at timestamp"
    day = lambda d: dt.datetime(2024, 1, d)
    batches = [[("a", 1, day(1), day(1)), ("b", 1, day(2), day(2))], [("a", 2, day(20), day(20))],
               [("a", 9, day(5), day(5)), ("b", 3, day(6), day(6)), ("c", 4, day(1), day(1))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={i}"))
        for part in (tmp_path / "in" / f"f={i}").glob("part-*"):
            part.rename(tmp_path / f"{i}.parquet")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))
    q = jobs.upsert_stream(src, str(tmp_path / "table"), ["k"], ["v"], "updated_at", str(tmp_path / "check"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    rows = read_buckets(spark, str(tmp_path / "table"), src.schema).collect()
    assert {r.k: (r.v, r.created_at) for r in rows} == {"a": (2, day(1)), "b": (3, day(2)), "c": (4, day(1))}


def test_fold_equals_decomposition(spark):
    import unicodedata
    words = ["Tiếng Việt", "Ａbc ﬁn ﬀ", "Ĳsland", "Ǆ", "cafe\u0301", "ẞ ø đ ł", "naïve İstanbul", "日本"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", tx.fold("w").alias("f"), tx.normalize_title("w").alias("t")).collect():
        latin = "".join(c for c in unicodedata.normalize("NFKD", r.w) if not unicodedata.combining(c))
        assert r.f == latin, r


def test_compose(spark):
    import unicodedata
    words = ["yağmur", "Tiếng Việt", "café crème", "", None, "e\u0301\u0301 \u0301x", "日本", "a\u0323\u0302"]
    rows = [(unicodedata.normalize("NFD", w) if w else w,) for w in words]
    df = spark.createDataFrame(rows, "w string")
    for r in df.select("w", tx.compose("w").alias("c"), tx.semantic_norm("w").alias("n")).collect():
        assert r.c == unicodedata.normalize("NFC", r.w or ""), r
    lex = spark.createDataFrame([("yağmur",)], "stem string")
    docs = spark.createDataFrame([(1, unicodedata.normalize("NFD", "bir yağmurlu gün"))], "k int, text string")
    assert [r.stem for r in J.lexicon_match(docs, lex, ["k"], "text").collect()] == ["yağmur"]
