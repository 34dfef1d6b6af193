"""Joins and ranking against brute force, with and without hot-key chunks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cuework.operators import aggregates as A
from cuework.operators import joins as J
from cuework.operators import ordered as O
from cuework.operators import ranking as R
from cuework.plans.media import assign_media
from cuework.plans.segments import select_segments

HOT = [None, 5]


def rows_of(seed, keys=4, n=25, top=60):
    rnd = random.Random(seed)
    return [(f"k{k}", i, round(rnd.random() * top, 2)) for k in range(keys) for i in range(n if k else 3 * n)]


@pytest.mark.parametrize("hot", HOT)
def test_nearest_and_asof(spark, hot):
    left, right = rows_of(1), [r for r in rows_of(2) if r[0] != "k3"]
    a = spark.createDataFrame(left, "k string, i int, t double")
    b = spark.createDataFrame(right, "k string, j int, t double")
    near = {(r.k, r.i): r.nearest for r in J.nearest_join(a, b, ["k"], tol=0.6, hot_rows=hot).collect()}
    asof = {(r.k, r.i): r.asof for r in J.asof_join(a, b, ["k"], "t", "t", ["j"], hot_rows=hot).collect()}
    for k, i, t in left:
        vals = sorted(r[2] for r in right if r[0] == k)
        best = min(vals, key=lambda v: abs(v - t)) if vals else None
        if best is None or abs(best - t) > 0.6:
            assert near[k, i] is None
        else:
            assert abs(near[k, i].t - t) == pytest.approx(abs(best - t))
        past = [v for v in vals if v <= t]
        assert (asof[k, i].t if asof[k, i] else None) == (max(past) if past else None)


@pytest.mark.parametrize("hot", HOT)
def test_range_sums(spark, hot):
    pts, sp = rows_of(3), [(k, i, t, t + (i % 7)) for k, i, t in rows_of(4)]
    p = spark.createDataFrame(pts, "k string, j int, t double").withColumn("v", F.col("t") * 2)
    s = spark.createDataFrame(sp, "k string, i int, lo double, hi double")
    got = {(r.k, r.i): r for r in O.range_sums(p, s, ["k"], "t", "v", "lo", "hi", ["i"], hot).collect()}
    assert len(got) == len(sp)
    for k, i, lo, hi in sp:
        hit = [x[2] for x in pts if x[0] == k and lo <= x[2] < hi]
        assert got[k, i].n == len(hit) and got[k, i].total == pytest.approx(2 * sum(hit))
        assert got[k, i].lo == lo and got[k, i].hi == hi


def test_points_and_overlaps_with_very_long_spans(spark):
    rnd = random.Random(6)
    sp = [(f"k{k}", i, rnd.random() * 50, rnd.choice([0.2, 3.0, 40.0, 5000.0])) for k in range(3) for i in range(20)]
    sp = [(k, i, s, s + n) for k, i, s, n in sp]
    pts, rg = rows_of(7), [(k, t, t + 2.5) for k, _, t in rows_of(8, n=10)]
    s = spark.createDataFrame(sp, "k string, i int, start double, end double")
    p = spark.createDataFrame(pts, "k string, j int, t double")
    got = sorted((r.k, r.i, r.j) for r in J.points_in_spans(p, s, ["k"]).collect())
    assert got == sorted((k, i, j) for k, i, a, b in sp for q, j, t in pts if q == k and a <= t < b)
    r = spark.createDataFrame(rg, "k string, start double, end double")
    hull = {(x.k, x.i): (x.overlap_start, x.overlap_end) for x in J.overlap_join(s, r, ["k"], ["i"]).collect()}
    for k, i, a, b in sp:
        os = [(max(a, c), min(b, d)) for q, c, d in rg if q == k and min(b, d) - max(a, c) >= 0.3]
        assert hull[k, i] == ((min(o[0] for o in os), max(o[1] for o in os)) if os else (None, None))


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_near_duplicates_lossless(spark, agree):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(12)]
    hs = []
    for b in base:
        hs.append(b)
        for flips in (0, 3, 8, 9, 20):
            x = b
            for bit in rnd.sample(range(64), flips):
                x ^= 1 << bit
            hs.append(x)
    hs += [0, 1, (1 << 63), (1 << 63) | 1]
    signed = [h - (1 << 64) if h >> 63 else h for h in hs]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(signed)], "id int, h long")
    got = sorted((r.hash_a, r.hash_b) for r in J.near_duplicates(df, "h", agree=agree).collect())
    u = sorted(set(signed))
    want = sorted((a, b) for a, b in itertools.combinations(u, 2)
                  if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 8)
    assert got == want and len(got) > 20


def test_lexicon_both_ways(spark):
    lex = J.lexicon(spark)
    df = spark.createDataFrame([(1, "Windows and doors; elim ELI el, windowsill! night-train"), (2, "xyz"),
                                (3, "Yollarda yağmur, gözyaşı gözlerin")], "id int, text string")
    a = {(r.id, r.stem) for r in J.lexicon_match(df, lex, ["id"], "text").collect()}
    b = {(r.id, r.stem) for r in J.lexicon_join(J.text_tokens(df, ["id"], "text"), lex, ["id"]).collect()}
    assert a == b == {(1, "window"), (1, "door"), (1, "el"), (1, "night"), (1, "train"),
                      (3, "yol"), (3, "yağmur"), (3, "gözyaş"), (3, "göz")}
    sem = {r.id: r for r in J.extract_semantics(df, ["id"], "text", lex).collect()}
    assert sem[1].subjects == ["window", "door", "hands", "night", "train", "journey"]
    assert sem[1].queries[0] == "person by window light" and len(sem[1].queries) == 5
    assert sem[2].queries[0] == "soft abstract light texture" and sem[2].matched == []
    assert sem[1].longing == 0.375


def test_ranking_and_reasons(spark):
    req = spark.createDataFrame([("a", "Band", "Right Song", 200.0)], "k string, artist string, title string, duration double")
    body = "la " * 40
    c = spark.createDataFrame([
        ("a", 0, "Other", "Wrong Tune", 290.0, "", "[00:01.00] x" + body, False),
        ("a", 1, "Band", "Right Song (Official Video)", 202.0, body, "", False),
        ("a", 2, "Band", "Right Song", 202.0, body, "[00:01.00] x", False),
        ("a", 3, "Band", "Right Song", 202.0, body, "", True),
        ("a", 4, "Band", "Right Song", 202.0, body, "[00:01.00] x", False)],
        "k string, input_pos int, artist string, title string, duration double, plain_text string, lrc_text string, instrumental boolean")
    out = R.rank_candidates(J.match_candidates(req, c, ["k"]), ["k"]).orderBy("rank").collect()
    assert [r.input_pos for r in out][:3] == [2, 4, 1] and 3 not in [r.input_pos for r in out]
    assert out[0].score == pytest.approx(0.35 + 0.25 + 0.2 * (1 - 2 / 15) + 0.15 + 0.05)
    assert "has synchronized (LRC) timings" in out[0].reasons


def test_assign_media_equals_walk(spark):
    rnd = random.Random(11)
    rows = []
    for j in range(6):
        hs = [rnd.getrandbits(64) for _ in range(5)]
        for s in range(4):
            for rank in range(1, 9):
                ref = f"r{rnd.randrange(14)}"
                h = hs[rnd.randrange(5)] ^ (1 << rnd.randrange(64)) if rnd.random() < .8 else rnd.getrandbits(64)
                rows.append((f"j{j}", s, rank, "p", ref, "photo" if rnd.random() < .9 else "video",
                             h - (1 << 64) if h >> 63 else h, 1.0 / rank))
    df = spark.createDataFrame(rows, "job_id string, scene_index int, rank int, provider string, provider_ref string, "
                                     "kind string, phash long, score double")
    gone = spark.createDataFrame([("j0", "p", "r1"), ("j1", "p", "r2")], "job_id string, provider string, provider_ref string")
    got = sorted((r.job_id, r.scene_index, r.slot, r.provider_ref) for r in assign_media(df, gone).collect())
    want = []
    for j in range(6):
        used, hashes = set(), []
        for s in range(4):
            mine = sorted(r for r in rows if r[0] == f"j{j}" and r[1] == s and r[5] == "photo")
            for n in range(3):
                pick = next((r for r in mine if (r[0], r[3], r[4]) not in {("j0", "p", "r1"), ("j1", "p", "r2")}
                             and r[4] not in used and all(bin((r[6] ^ h) & (2 ** 64 - 1)).count("1") > 8 for h in hashes)), None)
                if pick is None:
                    break
                used.add(pick[4])
                hashes.append(pick[6])
                want.append((f"j{j}", s, n, pick[4]))
    assert got == sorted(want)


@pytest.mark.parametrize("hot", HOT)
def test_segments(spark, hot):
    def track(k, dur, loud):
        n = int(dur / .5)
        frames = [(k, i, 1.0 if loud[0] <= i * .5 < loud[1] else 0.1) for i in range(n)]
        beats = [(k, i * 0.5) for i in range(n)]
        ons = [(k, round(i * (0.1 if loud[0] <= i < loud[1] else 1.0), 2)) for i in range(int(dur))]
        secs = [(k, i, x, rep) for i, (x, rep) in enumerate([(0.0, .2), (loud[0], 1.0), (loud[1], .3)])]
        return (k, dur), frames, beats, ons, secs
    tracks = [track("a", 180.0, (60.0, 100.0)), track("b", 20.0, (5.0, 10.0)), track("c", 120.0, (30.0, 60.0))]
    mk = lambda i, ddl: spark.createDataFrame([r for t in tracks for r in t[i]], ddl)
    tr = spark.createDataFrame([(*t[0], 47.3 if t[0][0] == "c" else None) for t in tracks], "k string, duration double, want double")
    out = {r.k: r for r in select_segments(
        tr, mk(1, "k string, frame int, energy double"), mk(2, "k string, t double"), mk(3, "k string, t double"),
        mk(4, "k string, idx int, t double, repetition double"), ["k"], 30.0, "want", hot_rows=hot).collect()}
    assert out["b"].start == 0.0 and out["b"].end == 20.0 and out["b"]["mode"] == "whole"
    assert out["c"].start == 47.5 and out["c"]["mode"] == "override"
    assert 55.0 <= out["a"].start <= 70.0 and out["a"].start % 0.5 == 0 and out["a"].end == out["a"].start + 30


@pytest.mark.parametrize("hot", HOT)
def test_timeline_order_and_positions(spark, hot):
    sp = spark.createDataFrame([("a", 0, 0.0, 4.0), ("a", 1, 4.0, 8.0), ("b", 0, 1.0, 3.0)], "k string, span_index int, start double, end double")
    hits = spark.createDataFrame([("a", 1.5), ("a", 4.0), ("a", 5.0), ("a", 6.5)], "k string, t double")
    got = {(r.k, r.t): (r.span_index, r.variant) for r in J.sample_timeline(sp, hits, ["k"], 1.0, 3, hot).collect()}
    assert got["a", 1.0] == (0, 0) and got["a", 2.0] == (0, 1) and got["a", 4.0] == (1, 1)
    assert got["a", 5.0] == (1, 2) and got["a", 7.0] == (1, 0) and got["b", 0.0] == (0, 0)
    df = spark.createDataFrame([("a", i) for i in range(9)], "k string, i int")
    picks = spark.createDataFrame([("a", 7, 0), ("a", 2, 1)], "k string, i int, pick_pos int")
    out = R.order_with_override(df, picks, ["k"], "i", "i", hot_rows=hot).orderBy("place").collect()
    assert [r.i for r in out] == [7, 2, 0, 1, 3, 4, 5, 6, 8]
    kids = spark.createDataFrame([("a", i, i * 2) for i in range(9)], "k string, o int, v int")
    par = spark.createDataFrame([("a",), ("z",)], "k string")
    nest = J.nest_children(par, kids, ["k"], ["o"], page_rows=4, hot_rows=hot).collect()
    pages = {(r.k, r.page): [c.v for c in r.children] for r in nest}
    assert pages == {("a", 0): [0, 2, 4, 6], ("a", 1): [8, 10, 12, 14], ("a", 2): [16], ("z", 0): []}


def test_dedupe_and_distinct(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "x", 0), ("b", "x", 2)], "k string, v string, o int")
    assert sorted(map(tuple, A.dedupe_first(df, ["k", "v"], ["o"]).collect())) == [("a", "x", 0), ("a", "y", 1), ("b", "x", 2)]
    assert [(r.v, r["rank"]) for r in A.ordered_distinct(df, ["k"], "v", "o").filter("k='a'").orderBy("rank").collect()] == [("x", 0), ("y", 1)]
