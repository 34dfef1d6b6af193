"""Medians of hot keys by selection, and the offset search against a walk over all shifts."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from cuework.operators import aggregates as agg
from cuework.operators import ranking


def test_median_of_hot_keys(spark):
    rng = random.Random(3)
    values = {"ties": [7.0] * 900 + [rng.uniform(-5, 20) for _ in range(101)], "spread": [rng.uniform(-1e300, 1e300) for _ in range(1500)],
              "even": [float(i) for i in range(1000)], "two": [1.0] * 500 + [2.0] * 500, "small": [3.0, 1.0], None: [float(i % 17) for i in range(800)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("small", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for hot in (None, 100):
        got = {r.k: (r.m, r.m_n) for r in agg.median(df, ["k"], "v", "m", hot).collect()}
        assert got == {k: (statistics.median(vs), len(vs)) for k, vs in values.items()}


def test_selection_needs_few_rounds(spark):
    """No task and no group holds the values of a hot key: only counts of ranges leave a scan."""
    df = spark.range(60_000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    out = agg.median(df, ["k"], "v", "m", 1000)
    assert [tuple(r) for r in out.collect()] == [("k", 29999.5, 60_000)]


def walk(energy, hop, spans, search, step, share=0.15):
    loud = energy > energy.max() * share

    def score(shift):
        act = np.zeros(len(loud), bool)
        for s, e in spans:
            a, b = (max(0, min(len(loud), int(round((x + shift) / hop)))) for x in (s, e))
            act[a:b] = True
        return float((act & loud).sum() / act.sum()) if act.sum() else 0.0
    zero = score(0.0)
    best = (zero, 0.0)
    steps = int(round(search / step))
    for k in range(-steps, steps + 1):
        sc = score(round(k * step, 2))
        if sc > best[0]:
            best = (sc, round(k * step, 2))
    return best[1], round(best[0], 3), round(zero, 3)


def test_offset_search_with_silent_frames(spark):
    rng = np.random.default_rng(4)
    spans, frames, want = [], [], {}
    for k in range(12):
        n = int(rng.integers(20, 200))
        energy = np.where(rng.random(n) < 0.5, 0.0, rng.random(n))
        mine = [(float(np.round(a, 2)), float(np.round(a + rng.uniform(0, 6), 2))) for a in rng.uniform(-3, n * 0.5 + 3, int(rng.integers(1, 25)))]
        if k == 3:
            mine += mine[:1] * 50
        kept = [i for i in range(n) if energy[i] > 0 or i == n - 1]  # rows of silent frames are missing
        frames += [(k, i, float(energy[i])) for i in kept]
        spans += [(k, a, b) for a, b in mine] + [(k, None, 1.0)]
        want[k] = walk(energy, 0.5, mine, 8.0, 0.1)
    spans.append((99, 1.0, 2.0))
    want[99] = (0.0, 0.0, 0.0)
    got = agg.estimate_offset(spark.createDataFrame(spans, "k int, start double, end double"),
                              spark.createDataFrame(frames, "k int, frame int, energy double"), ["k"])
    assert {r.k: (r.offset, r.best_score, r.zero_score) for r in got.collect()} == want


def test_offset_rows_do_not_depend_on_the_step(spark):
    spans = spark.createDataFrame([(1, 3.0, 7.0), (1, 20.0, 21.0)], "k int, start double, end double")
    frames = spark.createDataFrame([(1, i, float(i % 3)) for i in range(100)], "k int, frame int, energy double")

    def widest(step):
        out = agg.estimate_offset(spans, frames, ["k"], step=step)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        return plan.count("Window") , plan.count("Exchange")
    assert widest(0.1) == widest(0.01)


def test_near_duplicates_for_every_number_of_bands(spark):
    from cuework.operators.joins import agreeing_bands, near_duplicates
    rng = random.Random(6)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for h in hashes[:20]:
        for _ in range(3):
            hashes.append(h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 8))))
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(h,) for h in signed], "h long")
    want = {(a, b, bin((a ^ b) & (1 << 64) - 1).count("1"))
            for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 6}
    for agree in (1, 2, 3, None):
        assert {tuple(r) for r in near_duplicates(df, "h", 6, agree=agree).collect()} == want
    assert len(want) > 20
    # rows for each hash, if hashes are random: at most doubled from a thousand to a hundred million
    import math
    rows = lambda n, a: math.comb(6 + a, a) * (1 + n / 2 ** (64 // (6 + a) * a))
    each = [rows(n, agreeing_bands(n, 6)) for n in (10**3, 10**4, 10**5, 10**6)]
    assert max(each) < 8 * min(each) and agreeing_bands(10**8, 6) > agreeing_bands(10**3, 6)


def test_media_scores_that_differ_by_noise_are_ties(spark):
    """0.45 / 4 + 0.25 * 0.35 + ... and 0.25 * 0.6 + ... are the same number, but not the same double."""
    scenes = spark.createDataFrame([("s", ["ring"], ["gear"], "", 5.0)],
                                   "k string, queries array<string>, subjects array<string>, lyric string, scene_duration double")
    cand = spark.createDataFrame(
        [("s", 1, "photo", 2304, 2304, "none", "", "pixabay", 0.0), ("s", 2, "photo", 1928, 1728, "ring", "", "pixabay", 0.0)],
        "k string, input_pos int, kind string, width int, height int, tags string, query string, provider string, duration double")
    ok, _ = ranking.rank_media(cand, scenes, ["k"])
    assert [r.input_pos for r in ok.orderBy("rank").collect()] == [1, 2]
    got = spark.createDataFrame([(0.493125,), (0.25,), (0.0,), (0.614687499999,)], "x double").select(ranking.nearest("x", 5).alias("x"))
    assert [r.x for r in got.collect()] == [0.49313, 0.25, 0.0, 0.61469]


def test_near_duplicates_keep_their_rows_out_of_the_driver(spark):
    """Every hash has a row for each of hundreds of choices, whatever Spark estimates: they are merged, and the choices
    are a table rather than an expression each."""
    from cuework.operators.joins import near_duplicates

    df = spark.createDataFrame([(1,), (3,), (-1,), (1 << 62,)], "h long")
    out = near_duplicates(df, "h", 8, agree=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert len(plan) < 20_000
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3, 1), (1, 1 << 62, 2), (3, 1 << 62, 3)]
