"""Alignment operators against a plain walk and on hand-made tracks."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cuework.operators import align

ASR = "k string, pos int, text string, start double, end double, prob double"
LINES = "k string, line_index int, text string"
SPANS = "k string, line_index int, start double, end double"


def asr(spark, **tracks):
    rows = [(k, i, w, s, e, p) for k, ws in tracks.items() for i, (w, s, e, p) in enumerate(ws)]
    return spark.createDataFrame(rows, ASR)


def lines(spark, **tracks):
    return spark.createDataFrame([(k, i, x) for k, xs in tracks.items() for i, x in enumerate(xs)], LINES)


def spans(spark, **tracks):
    return spark.createDataFrame([(k, i, a, b) for k, xs in tracks.items() for i, (a, b) in xs.items()], SPANS)


def heard(*triples):
    return [(w, s, s + 0.3, p) for w, s, p in triples]


def by_line(df):
    return {(r.k, r.line_index): r for r in df.collect()}


def test_align_lyrics_gaps(spark):
    ls = lines(spark, a=["hold me very close now"], b=["intro words here yes"], c=["nothing at all"])
    ws = asr(spark, a=heard(("hold", 1.0, 0.9), ("me", 1.4, 0.9), ("now", 4.0, 0.9)),
             b=heard(("here", 5.0, 0.9), ("yes", 5.5, 0.9)))
    out, words, stats = align.align_lyrics(ls, ws, ["k"])
    w = {(r.k, r.word_index): r for r in words.collect()}
    assert not w["a", 2].matched and w["a", 2].confidence == 0.2
    assert 1.7 <= w["a", 2].start < w["a", 3].start and w["a", 3].end <= 4.0 + 1e-6
    assert w["b", 0].start is None and w["b", 0].confidence == 0.0 and w["b", 2].matched
    o = by_line(out)
    assert o["a", 0].start == 1.0 and o["a", 0].end == pytest.approx(4.3)
    assert o["c", 0].start is None and o["c", 0].confidence == 0.0
    s = {r.k: r for r in stats.collect()}
    assert s["a"].matched_ratio == 0.6 and s["b"].matched_ratio == 0.5 and s["c"].matched_ratio == 0.0


def test_monotonic_equals_plain_walk(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    texts, toks = {}, {}
    for k in range(8):
        texts[f"t{k}"] = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 6))) for _ in range(25)]
        said = [w for x in texts[f"t{k}"] for w in x.split() if rnd.random() > 0.25]
        toks[f"t{k}"] = [(w, i * 0.5, i * 0.5 + 0.3, 0.9) for i, w in enumerate(said)]
    got = by_line(align.align_monotonic(lines(spark, **texts), asr(spark, **toks), ["k"]))
    for k, xs in texts.items():
        cursor = 0
        for li, x in enumerate(xs):
            want, best, at = x.split(), 0.0, None
            names = [w[0] for w in toks[k]]
            for j in range(cursor, min(len(names), cursor + 400) - len(want) + 1):
                r = SequenceMatcher(None, want, names[j:j + len(want)], autojunk=False).ratio()
                if r > best or r >= 0.72:
                    best, at = r, j
                if r >= 0.72:
                    break
            g = got[k, li]
            if at is None or best < 0.45:
                assert g.start is None and g.confidence == 0.0
            else:
                assert g.start == toks[k][at][1] and g.confidence == pytest.approx(round(best, 3))
                cursor = at + len(want)


def test_repeated_lines_take_successive_places(spark):
    ls = lines(spark, a=["la la la", "la la la"])
    ws = asr(spark, a=heard(*[("la", float(i), 0.9) for i in range(6)]))
    got = by_line(align.align_monotonic(ls, ws, ["k"]))
    assert (got["a", 0].start, got["a", 1].start) == (0.0, 3.0)


def test_from_spans(spark):
    ls = lines(spark, a=["a b", "c d", "e f"])
    sp = spans(spark, a={0: (10.0, 14.0), 2: (20.0, None)})
    tags = spark.createDataFrame([("a", 0, [("a", 10.5), ("b", 12.25)]), ("a", 2, [("e", 20.0)])],
                                 "k string, line_index int, words array<struct<text:string,start:double>>")
    got = by_line(align.align_from_spans(ls, sp, ["k"], word_spans=tags))
    assert [(w.start, w.end) for w in got["a", 0].words] == [(10.5, 12.25), (12.25, 14.0)]
    assert got["a", 1].start is None and [w.text for w in got["a", 1].words] == ["c", "d"]
    assert [w.start for w in got["a", 2].words] == [20.0, 21.5] and got["a", 2].end == 23.0


def test_hybrid_modes(spark):
    texts = ["hold on tight", "silent gap line", "let it go"]
    good = [("hold", 10.5, 10.9, .9), ("on", 10.9, 11.2, .9), ("tight", 11.2, 11.8, .9),
            ("let", 15.0, 15.2, .9), ("it", 15.2, 15.4, .9), ("go", 15.4, 15.9, .9)]
    pairs = ["one two", "three four", "five six", "seven eight"]
    far = [(w, s, s + .4, .9) for w, s in zip(" ".join(pairs).split(),
                                              [56.2, 56.6, 24.0, 24.4, 30.0, 30.4, 99.0, 99.4])]
    ls = lines(spark, good=texts, scattered=pairs, weak=["x1", "x2", "x3", "x4"], bare=["hold on tight"])
    sp = spans(spark, good={0: (10.0, 12.5), 1: (12.5, 14.5), 2: (14.5, 17.0)},
               scattered={i: (56.0 + 5 * i, 61.0 + 5 * i) for i in range(4)},
               weak={i: (5.0 + 2 * i, 7.0 + 2 * i) for i in range(4)})
    ws = asr(spark, good=good, scattered=far, weak=heard(("totally", 2.0, .9), ("different", 40.0, .9)),
             bare=good[:3])
    out, stats = align.align_hybrid(ls, sp, ws, ["k"], trust_min=0.3)
    o, s = by_line(out), {r.k: r for r in stats.collect()}
    assert {k: r["mode"] for k, r in s.items()} == {
        "good": "hybrid", "scattered": "spans", "weak": "spans", "bare": "transcript"}
    assert o["good", 0].words[0].start == 10.5 and o["good", 2].words[0].start == 15.0
    assert o["good", 0].start <= o["good", 1].start <= o["good", 2].start
    assert o["good", 1].start == pytest.approx(13.0) and o["good", 1].confidence == 0.6
    assert [o["scattered", i].start for i in range(4)] == [56.0, 61.0, 66.0, 71.0]
    assert o["weak", 3].start == 11.0 and s["bare"].line_match_ratio == 1.0
    assert s["good"].line_match_ratio == pytest.approx(0.6667)


def test_offset_recovered(spark):
    from cuework.operators.aggregates import accept_offset, estimate_offset
    loud = lambda ranges: [0.02 if not any(a <= i * 0.5 < b for a, b in ranges) else 1.0 for i in range(60)]
    rows = [(k, i, e) for k, rs in (("a", [(12, 15), (18, 21)]), ("b", [(10, 13), (16, 19)]))
            for i, e in enumerate(loud(rs))]
    frames = spark.createDataFrame(rows, "k string, frame int, energy double")
    sp = spans(spark, a={0: (10.0, 13.0), 1: (16.0, 19.0)}, b={0: (10.0, 13.0), 1: (16.0, 19.0)}, c={0: (1.0, 2.0)})
    for hot in (None, 9):
        got = {r.k: r for r in accept_offset(estimate_offset(sp, frames, ["k"], hot_rows=hot)).collect()}
        assert abs(got["a"].offset - 2.0) <= 0.6 and got["a"].best_score > got["a"].zero_score
        assert got["a"].applied == got["a"].offset
        assert got["b"].offset == 0.0 and got["b"].best_score == got["b"].zero_score == 1.0
        assert got["c"].offset == got["c"].best_score == 0.0
    # exactly what sliding the pattern frame by frame gives
    e = [r[2] for r in rows if r[0] == "a"]
    best = (0.0, 0.0)
    for k in range(-80, 81):
        sh, act = round(k * 0.1, 2), set()
        for a, b in ((10.0, 13.0), (16.0, 19.0)):
            act |= set(range(max(0, min(60, round((a + sh) / 0.5))), max(0, min(60, round((b + sh) / 0.5)))))
        score = sum(e[i] > 0.15 for i in act) / len(act) if act else 0.0
        if k == -80:
            zero = sum(e[i] > 0.15 for i in (*range(20, 26), *range(32, 38))) / 12
            best = (zero, 0.0)
        if score > best[0]:
            best = (score, sh)
    assert got["a"].offset == pytest.approx(best[1]) and got["a"].best_score == round(best[0], 3)


def test_tracks_are_matched_once(spark, monkeypatch):
    """Keys are counted before the matching: counting matched rows would run it again."""
    from cuework.operators import align as A
    from cuework.operators.ordered import NO_SPLIT
    seen, fill = [], A.interpolate_gaps
    monkeypatch.setattr(A, "interpolate_gaps", lambda *a, **k: seen.append(k["hot_rows"]) or fill(*a, **k))
    lines = spark.createDataFrame([(1, 0, "la le li")], "k int, line_index int, text string")
    asr = spark.createDataFrame([(1, i, w, i * 1.0, i + 0.5, 0.9) for i, w in enumerate(["la", "li"])],
                                "k int, pos int, text string, start double, end double, prob double")
    words = A.align_lyrics(lines, asr, ["k"])[1]
    assert [r.matched for r in words.orderBy("word_index").collect()] == [True, False, True]
    assert seen == [NO_SPLIT]


def test_shares_of_windows():
    import random
    from collections import Counter

    import numpy as np

    from cuework.operators.align import _shared
    rnd = random.Random(1)
    for _ in range(200):
        norms = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        want = [rnd.choice("abcx") for _ in range(rnd.randint(1, 6))]
        vocab = {w: i for i, w in enumerate(dict.fromkeys(norms))}
        first, stop = rnd.randint(0, 5), len(norms) - len(want) + 1
        share = [(j, sum((Counter(norms[j:j + len(want)]) & Counter(want)).values()) / len(want)) for j in range(first, stop)]
        ids = np.array([vocab[w] for w in norms], dtype=np.int64)
        assert list(_shared(want, norms, ids, vocab, first, stop, 0.45)) == [x for x in share if x[1] >= 0.45]
