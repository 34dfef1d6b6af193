"""Near-duplicate operators and the pipeline against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuework.llm import QUERIES, SQL, compact_windows, jaccard_join, textkernel
from cuework.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def corpus(seed=7):
    """Copies, near copies at several distances, a passage that many share, short and odd texts."""
    rng = random.Random(seed)
    shared = " ".join(word(rng) for _ in range(25))
    texts = [None, "", "  \n ", "One", "one", "ONE two three", "one two three", "É é", "é É"]
    for _ in range(12):
        base = [word(rng) for _ in range(rng.randint(30, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                other[rng.randrange(len(other))] = word(rng)
            texts.append("\n".join(other) if rng.random() < 0.3 else " ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    for _ in range(15):
        texts.append(" ".join(word(rng) for _ in range(rng.randint(5, 60))) + " " + shared)
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(int(i), texts[j]) for i, j in enumerate(order)]


def groups_by_force(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            n = len(x & y)
            if a < b and n and 100 * n >= percent * (len(x) + len(y) - n):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_kernel_matches_plain_words():
    texts = [t for _, t in corpus(3)] + ["x" * 5000, "\x1c a\x1cb", "日本 語"]
    w = textkernel.Words(pa.array(texts, pa.string()), textkernel.LOWER)
    seen = {}
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").translate(LOWER))
        own = w.hashes[w.at[i]:w.at[i + 1]].tolist()
        assert len(own) == len(words)
        for x, h in zip(words, own):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced = textkernel.Words(pa.array(texts, pa.string())[4:9], textkernel.LOWER)
    assert sliced.hashes.tolist() == w.hashes[w.at[4]:w.at[9]].tolist()
    for k in (1, 4, 5):
        values, at = w.shingles(k)
        sets, cut = textkernel.distinct_sets(values, at)
        for i, t in enumerate(texts):
            assert cut[i + 1] - cut[i] == len(shingle_set(t, k))


@pytest.mark.parametrize("seed,k,percent", [(7, 4, 85), (8, 5, 80)])
def test_jaccard_groups(spark, seed, k, percent):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(
        frame(spark, rows).withColumn("n", F.lit("mine")).repartition(3), k, percent).collect()}
    assert got == groups_by_force(rows, k, percent)


def test_every_text_of_a_repeated_id_is_compared(spark):
    rng = random.Random(5)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, near(c)), (5, " ".join(c))]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in jaccard_join.similar_groups(frame(spark, order), 4, 80).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_the_middle_of_a_group_is_found_first(spark, monkeypatch):
    # copies with two changed words each are similar to their original only
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    texts = [base]
    for i in range(150):
        other = list(base)
        for at in rng.sample(range(5, 145), 2):
            other[at] = f"x{rng.randrange(10**9)}"
        texts.append(other)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rest, left = jaccard_join._rest, []
    monkeypatch.setattr(jaccard_join, "STARS", 2)
    monkeypatch.setattr(jaccard_join, "_rest", lambda t, p: (left.append(rest(t, p).count()), rest(t, p))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, rows), 4, 85).collect()}
    assert got == groups_by_force(rows, 4, 85)
    assert left[0] <= 150


def test_few_tables_are_written(spark, monkeypatch):
    # the driver keeps the plan of each: with many its memory doesn't last through the pipeline
    made, stored = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: (made.append(name), stored(df, name))[1])
    jaccard_join.similar_groups(frame(spark, [(1, "a b c d e f"), (2, "g h i j k l")]))
    assert len(made) <= 30


def test_bounds_from_common_hubs_hold(spark):
    rng = random.Random(6)
    hubs = [set(rng.sample(range(60), 30)) for _ in range(3)]
    sets = [set(rng.sample(range(60), rng.randint(20, 40))) for _ in range(25)]
    answers = spark.createDataFrame([(i, 100 + h, len(s), len(hub), len(s & hub)) for i, s in enumerate(sets)
                                     for h, hub in enumerate(hubs) if rng.random() < 0.7], jaccard_join.ANSWERS)
    pairs = spark.createDataFrame([(i, j, len(sets[i]), len(sets[j])) for i in range(25) for j in range(i)], "a long, b long, an int, bn int")
    seen = 0
    for r in jaccard_join.derive(pairs, answers).collect():
        if r.low is not None:
            seen += 1
            assert r.low <= len(sets[r.a] & sets[r.b]) <= r.high
    assert seen > 50


def test_bit_maps_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 400)))) for _ in range(2))
        most = jaccard_join.most_shared(jaccard_join.bit_map(a), jaccard_join.bit_map(b), len(a), len(b))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
    other = rng.integers(0, 2**63, 300).astype(np.uint64)
    assert jaccard_join.most_shared(jaccard_join.bit_map(pool[:300]), jaccard_join.bit_map(other), 300, 300) < 120


def test_jaccard_edge_cases(spark):
    assert jaccard_join.similar_groups(frame(spark, []).limit(0)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "A B C D E F"), (9, ""), (9, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, rows)).collect()),
                 key=str)
    assert got == sorted([(None, 2, None), (3, 2, 1), (3, 2, 1), (1, 2, 1), (9, 0, 9), (9, 0, 9)], key=str)
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 9, None]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (10, 11), (11, 12), (12, 10), (7, 7), (None, 1), (5, 4), (20, 4)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 20: 2, 10: 10, 11: 10, 12: 10}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_windows_cover_every_stretch_once():
    rng = np.random.default_rng(2)
    for _ in range(20):
        h, t = rng.integers(0, 30, 40).astype(np.uint64), int(rng.integers(2, 9))
        found = compact_windows.windows(h, t)
        for i in range(len(h)):
            for j in range(i + t - 1, len(h)):
                over = [m for l, m, r in found if l <= i <= m <= j <= r]
                assert over == [i + int(h[i:j + 1].argmin())]


def test_passages(spark):
    rng = random.Random(9)
    text = lambda n: [word(rng) for _ in range(n)]
    passage, near = text(70), text(90)
    changed = list(near)
    changed[45] = "changed"
    rows = [(1, text(40) + passage + text(30)), (2, text(100) + passage), (3, text(200)), (4, passage[:20] + text(50)),
            (5, near + text(10)), (6, text(5) + changed), (7, text(60)), (8, None), (9, []), (None, passage)]
    for i in range(20, 40):
        rows.append((i, text(30) + passage + text(20)))
    rows = [(i, None if t is None else " ".join(t)) for i, t in rows]
    got = compact_windows.repeated_passages(frame(spark, rows).withColumn("key", F.lit("mine")).repartition(4)).collect()
    flagged = {r.doc_id for r in got} | {r.with_doc_id for r in got}
    assert flagged == {1, 2, 5, 6, *range(20, 40)}
    sets = dict(rows)
    for r in got:
        assert r.with_doc_id < r.doc_id and r.similarity >= 0.8 and r.end - r.start >= 40
        a = shingle_set(" ".join(WORD.findall(sets[r.doc_id])[r.start:r.end]), 5)
        b = shingle_set(" ".join(WORD.findall(sets[r.with_doc_id])[r.with_start:r.with_end]), 5)
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-5
    pair = next(r for r in got if (r.doc_id, r.with_doc_id) == (2, 1))
    assert (pair.start, pair.end, pair.with_start, pair.with_end) == (100, 170, 40, 110)
    assert compact_windows.repeated_passages(frame(spark, []).limit(0)).count() == 0


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "secret_scans", "mix_sources",
                                                      "pack_sequences"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    clean = [" ".join(word(rng) for _ in range(60)) for _ in range(30)]
    rows = list(enumerate(clean)) + [(100, clean[3]), (101, clean[4] + " more"), (102, "too short"), (103, None),
                                     (104, clean[5][:200] + " password=abcdefgh1 " + " ".join(word(rng) for _ in range(40)))]
    docs = frame(spark, rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = at.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == columns
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at.collect()
    good = {r.doc_id for r in seen["quality_rules"]}
    assert good == {*range(30), 100, 101, 104}
    assert {r.doc_id for r in seen["jaccard_join"]} == {*range(30), 104}
    hidden = {r.doc_id: r.text for r in seen["secret_scans"]}
    assert "[SECRET]" in hidden[104] and hidden[7] == clean[7]
    mixed = [r.doc_id for r in seen["mix_sources"]]
    assert set(mixed) <= set(hidden)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(set(r.doc_id for r in packed)) == sorted(set(mixed))
    assert sum(1 for r in packed if r.start == 0) == len(mixed)


def test_passages_with_a_phrase_that_stands_twice():
    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)

    def shingles(w):
        return textkernel.Words(pa.array([" ".join(map(str, w.tolist()))])).shingles(5)[0]
    title = new(8)
    passage = np.concatenate([new(26), title, new(26)])
    one, two = shingles(np.concatenate([title, new(100), passage])), shingles(passage)
    assert compact_windows.passages(one, two, 46, 80) == [(108, 164, 0, 56, 1.0)]
    assert compact_windows.passages(two, one, 46, 80) == [(0, 56, 108, 164, 1.0)]
    # an insertion, and the passage in changed order of parts
    changed = np.concatenate([new(9), passage[:30], new(1), passage[30:], new(9)])
    assert [p[:4] for p in compact_windows.passages(one, shingles(changed), 46, 80)] == [(108, 164, 9, 66)]
    p, q = new(70), new(80)
    got = compact_windows.passages(shingles(np.concatenate([p, q])), shingles(np.concatenate([q, p])), 46, 80)
    assert [x[:4] for x in got] == [(70, 146, 0, 76), (0, 66, 80, 146)]
    same = shingles(np.zeros(20_000, np.uint64))
    assert compact_windows.passages(same, same, 46, 80) == [(0, 19996, 0, 19996, 1.0)]


def test_passage_that_the_first_of_its_list_has_in_part(spark):
    rng = random.Random(12)
    text = lambda n: [word(rng) for _ in range(n)]
    rows = []
    for i in range(0, 60, 3):
        passage = text(60)
        cut = passage[:40] if i % 2 else passage[-40:]
        rows += [(i, text(30) + cut + text(30)), (i + 1, text(20) + passage + text(30)), (i + 2, text(25) + passage + text(9))]
    rows = [(i, " ".join(t)) for i, t in rows]
    got = {(r.doc_id, r.with_doc_id) for r in compact_windows.repeated_passages(frame(spark, rows)).collect()}
    assert got == {(i + 2, i + 1) for i in range(0, 60, 3)}
    # two texts under one doc_id: each is compared
    a, b = " ".join(text(60)), " ".join(text(60))
    got = compact_windows.repeated_passages(frame(spark, [(1, a), (1, b), (2, a), (3, b)])).collect()
    assert {(r.doc_id, r.with_doc_id) for r in got} == {(2, 1), (3, 1)}


def test_recall_near_the_threshold(spark):
    rng = random.Random(21)
    text = lambda n: [word(rng) for _ in range(n)]
    rows, want = [], set()
    for i in range(0, 600, 2):
        one = text(rng.randint(50, 62))
        two, at = list(one), rng.randrange(5, len(one) - 5)
        two[at:at + rng.randint(0, 1)] = text(rng.randint(0, 1))
        pair = [text(rng.randint(0, 40)) + x + text(rng.randint(0, 40)) for x in (one, two)]
        rows += [(i, " ".join(pair[0])), (i + 1, " ".join(pair[1]))]
        a, b = (textkernel.Words(pa.array([" ".join(x)])).shingles(5)[0] for x in pair)
        if compact_windows.passages(a, b, 46, 80):
            want.add((i + 1, i))
    got = {(r.doc_id, r.with_doc_id) for r in compact_windows.repeated_passages(frame(spark, rows)).collect()}
    print("recall", len(got & want), "of", len(want))
    assert len(want) > 200 and got <= want and len(got) >= 0.99 * len(want)


def test_a_word_over_and_over_is_one_passage():
    def shingles(*words):
        return textkernel.Words(pa.array([" ".join(words)])).shingles(5)[0]
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    one, two = shingles(*text(20), *["the"] * 60, *text(20)), shingles(*text(30), *["the"] * 400, *text(30))
    assert compact_windows.passages(one, two, 46, 80) == [(20, 76, 30, 426, 1.0)]
    assert compact_windows.passages(two, one, 46, 80) == [(30, 426, 20, 76, 1.0)]
    # with fewer than a passage in one it tells nothing
    assert compact_windows.passages(shingles(*text(20), *["the"] * 40, *text(20)), two, 46, 80) == []


def test_a_run_ends_where_the_documents_differ():
    rng = np.random.default_rng(8)
    new = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    first, second, tail = new(300), new(140), new(60)
    one = np.concatenate([first, new(4), second, new(60)])
    two = np.concatenate([first, new(4), second, tail])
    assert compact_windows.passages(one, two, 46, 80) == [(0, 444, 0, 444, round(440 / 448, 6))]


def test_equal_texts_are_compared_once(spark, monkeypatch):
    rng = random.Random(14)
    text = lambda n: [word(rng) for _ in range(n)]
    passage, copy = text(60), text(80)
    rows = [(i, " ".join(copy)) for i in range(30)] + [(i, " ".join(text(20) + passage + text(20))) for i in range(40, 44)]
    rows += [(50, " ".join(copy[:70])), (51, " ".join(copy[:70])), (60, "too short"), (61, "too short"), (44, rows[-1][1])]
    pairs, stored = [], compact_windows.stored

    def kept(df, name):
        out = stored(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out
    monkeypatch.setattr(compact_windows, "stored", kept)
    got = {(r.doc_id, r.with_doc_id): (r.start, r.end, r.with_start, r.with_end)
           for r in compact_windows.repeated_passages(frame(spark, rows)).collect()}
    linked = {r.id: r.component for r in components(spark.createDataFrame(list(got), "u long, v long")).collect()}
    assert linked == {**{i: 0 for i in (*range(30), 50, 51)}, **{i: 40 for i in range(40, 45)}}
    assert all(got[i, 0] == (0, 80, 0, 80) for i in range(1, 30)) and got[44, 43][1] == 100
    assert sum(pairs) <= 6
