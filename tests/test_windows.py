"""Window operators against plain folds, with and without hot-key chunks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cuework.operators import aggregates as A
from cuework.operators import windows as W

HOT = [None, 7]


def make(spark, seed=1, keys=6, n=40):
    rnd = random.Random(seed)
    rows = []
    for k in range(keys):
        t = 0.0
        for i in range(n if k else 3 * n):
            t += rnd.choice([0.1, 0.4, 0.9, 1.3, 4.0])
            timed = rnd.random() > 0.4
            rows.append((f"k{k}", i, round(t, 3), round(t + rnd.choice([0.1, 0.3]), 3),
                         round(rnd.random(), 2), timed))
    return rows, spark.createDataFrame(rows, "k string, i int, s double, e double, v double, timed boolean")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("hot", HOT)
def test_line_ends(spark, hot):
    rows, df = make(spark)
    got = {(r.k, r.i): r.end for r in W.infer_line_ends(df, ["k"], "s", hot_rows=hot).collect()}
    for k, rs in by_key(rows).items():
        for a, r in enumerate(rs):
            nxt = rs[a + 1][2] if a + 1 < len(rs) else r[2] + 8.0
            assert got[k, r[1]] == pytest.approx(max(r[2] + 0.5, min(nxt, r[2] + 8.0)))


@pytest.mark.parametrize("hot", HOT)
def test_pause_groups(spark, hot):
    rows, df = make(spark)
    out = W.pause_lines(df.withColumn("text", F.col("i").cast("string")), ["k"], "text", "s", "e",
                        hot_rows=hot)
    got = {}
    for r in out.collect():
        got.setdefault(r.k, {})[r.line_index] = r.text
    for k, rs in by_key(rows).items():
        groups, cur = [], []
        for r in rs:
            if cur and (r[2] - cur[-1][3] > 0.9 or len(cur) == 8):
                groups.append(cur)
                cur = []
            cur.append(r)
        groups.append(cur)
        assert got[k] == {i: " ".join(str(r[1]) for r in g) for i, g in enumerate(groups)}


@pytest.mark.parametrize("hot", HOT)
def test_interpolate(spark, hot):
    rows, df = make(spark)
    df = df.select("k", "i", *[F.when(F.col("timed"), F.col(c)).alias(c) for c in "sev"])
    got = {(r.k, r.i): r for r in W.interpolate_gaps(df, ["k"], "i", "s", "e", "v",
                                                     hot_rows=hot).collect()}
    for k, rs in by_key(rows).items():
        timed = [a for a, r in enumerate(rs) if r[5]]
        for a, r in enumerate(rs):
            g = got[k, r[1]]
            if r[5]:
                assert g.matched and g.s == r[2]
                continue
            before = [b for b in timed if b < a]
            after = [b for b in timed if b > a]
            if not before or not after:
                assert g.s is None and g.v == 0.0
                continue
            lo, hi = before[-1], after[0]
            n, t0, t1 = hi - lo - 1, rs[lo][3], rs[hi][2]
            if t1 <= t0:
                t1 = t0 + 0.08 * n
            want = t0 + (a - lo - 1) * (t1 - t0) / n
            assert g.s == pytest.approx(want) and g.v == 0.2 and g.e >= g.s + 0.08 - 1e-9


@pytest.mark.parametrize("hot", HOT)
def test_clamp_and_monotonic(spark, hot):
    rows, df = make(spark)
    got = {(r.k, r.i): r for r in W.clamp_monotonic(df.withColumn("e", F.col("v") + 1), ["k"], ["i"],
                                                    "v", "e", hot_rows=hot).collect()}
    mono = {r.k: r.monotonic for r in W.is_monotonic(df, ["k"], ["i"], "v", hot_rows=hot).collect()}
    for k, rs in by_key(rows).items():
        top, prev, ok = None, None, True
        for r in rs:
            if prev is not None and r[4] < prev - 0.05:
                ok = False
            prev = r[4]
            top = r[4] if top is None else max(top, r[4])
            assert got[k, r[1]].v == pytest.approx(top)
            assert got[k, r[1]].e - got[k, r[1]].v == pytest.approx(1)
        assert mono[k] == ok


@pytest.mark.parametrize("hot", HOT)
def test_regions(spark, hot):
    rnd = random.Random(3)
    rows = [(f"k{k}", f, rnd.choice([0.0, 0.0, 0.02, 0.5, 1.0])) for k in range(4)
            for f in range(60)]
    df = spark.createDataFrame(rows, "k string, frame int, energy double")
    got = {}
    for r in W.active_regions(df, ["k"], hot_rows=hot).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    for k in {r[0] for r in rows}:
        es = [r[2] for r in rows if r[0] == k]
        peak, merged = max(es), []
        for f, e in enumerate(es):
            if e > 0.12 * peak:
                if merged and f * 0.5 - merged[-1][1] <= 1.2:
                    merged[-1][1] = (f + 1) * 0.5
                else:
                    merged.append([f * 0.5, (f + 1) * 0.5])
        assert sorted(got[k]) == [tuple(m) for m in merged if m[1] - m[0] >= 0.5]


@pytest.mark.parametrize("hot", HOT)
def test_thin(spark, hot):
    for seed in range(3):
        rows, df = make(spark, seed)
        got = {}
        for r in W.thin_events(df, ["k"], "s", gap=1.7, hot_rows=hot).collect():
            got.setdefault(r.k, []).append(r.s)
        for k, rs in by_key(rows).items():
            kept = []
            for r in rs:
                if not kept or r[2] - kept[-1] >= 1.7:
                    kept.append(r[2])
            assert sorted(got[k]) == kept


@pytest.mark.parametrize("hot", HOT)
def test_carve_tiles_the_segment(spark, hot):
    rnd = random.Random(5)
    lines, segs = [], []
    for k in range(12):
        t, lo, hi = rnd.random() * 10, 5.0, 5.0 + rnd.choice([10, 40, 90])
        segs.append((f"k{k}", lo, hi))
        for i in range(rnd.choice([0, 1, 5, 20])):
            t += rnd.choice([0.7, 1.5, 3.0, 9.0])
            lines.append((f"k{k}", i, t, t + rnd.choice([0.2, 1.0, 2.5])))
    ldf = spark.createDataFrame(lines, "k string, line_index long, start double, end double")
    sdf = spark.createDataFrame(segs, "k string, segment_start double, segment_end double")
    got = {}
    for r in W.carve_spans(ldf, sdf, ["k"], hot_rows=hot).collect():
        got.setdefault(r.k, []).append((r.span_start, r.span_end, r.line_index))
    for k, lo, hi in segs:
        spans, cursor, n = [], lo, 0
        for _, i, s, e in [x for x in lines if x[0] == k and x[3] > lo and x[2] < hi]:
            a = max(lo, s)
            if a - cursor >= 3:
                parts = max(1, round((a - cursor) / 6 + 0.4))
                spans += [(cursor + j * (a - cursor) / parts,
                           cursor + (j + 1) * (a - cursor) / parts, None) for j in range(parts)]
            elif a > cursor and spans:
                spans[-1] = (spans[-1][0], a, spans[-1][2])
            elif a > cursor:
                a = cursor
            cursor = max(min(hi, e), a + 0.5)
            spans.append((a, cursor, i))
        if hi - cursor >= 3:
            parts = max(1, round((hi - cursor) / 6 + 0.4))
            spans += [(cursor + j * (hi - cursor) / parts,
                       cursor + (j + 1) * (hi - cursor) / parts, None) for j in range(parts)]
        elif spans:
            spans[-1] = (spans[-1][0], hi, spans[-1][2])
        key = lambda x: (x[0], x[1])
        a, b = sorted(got[k], key=key), sorted(spans, key=key)
        assert [x[2] for x in a] == [x[2] for x in b]
        assert [y for x in a for y in x[:2]] == pytest.approx([y for x in b for y in x[:2]])


@pytest.mark.parametrize("hot", HOT)
def test_median(spark, hot):
    rows, df = make(spark)
    got = {r.k: r for r in A.median(df, ["k"], "v", hot_rows=hot).collect()}
    for k, rs in by_key(rows).items():
        assert got[k].median == pytest.approx(statistics.median(r[4] for r in rs))
