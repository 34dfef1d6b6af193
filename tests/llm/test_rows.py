"""Row-wise operators and mixing against plain walks: nulls, empty and long texts, ties, repeats, empty tables."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuework.llm import chat, mixing, pu_classifier, quality_rules, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, None, sources[i] if sources else "a", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = "the quick brown fox jumps over the lazy dog again and again " * 300
TEXTS = [None, "", " \n\t ", "one two three", LONG, "a b c d e f g h x a b c d e f g h", "same line\nother\nsame line\n\n \nother",
         "x # y $ z & | < > * %", "é ü ß " * 10, "same line\nother\nsame line\n\n \nother"]


def base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_base_rules(spark):
    got = quality_rules.judge(docs_of(spark, TEXTS), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(
            TEXTS[r.doc_id]), r.doc_id
        assert r.score == 0.0  # nothing is trusted
        assert r.kept == (not r.base_failed)


def grams_of(words):
    import xxhash
    mask = (1 << 16) - 1
    one = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    h = [one(w) for w in words]
    ends = [xxhash.xxh64_intdigest((1).to_bytes(4, "little"), one(w[-2:])) for w in words]
    return [x & mask for x in h] + [(x ^ y << 1) & mask for x, y in zip(h, h[1:])] + [x & mask for x in ends]


def test_scores_match_a_plain_walk(spark):
    """Counts, ratios, scores and verdicts, worked out without Spark."""
    import math
    rng = random.Random(12)
    texts = [*(t for t in TEXTS if t is not LONG), *(" ".join(f"w{rng.randrange(60 + i % 3 * 90)}é" for _ in range(rng.randint(1, 80))) for i in range(60))]
    ids = [None, 1, 1, *range(3, len(texts))]
    labels = [(i, int(i % 2 == 0), 0) for i in range(1, 50)] + [(1, 1, 0), (4, 1, 1), (None, 1, 0), (9999, 1, 0)]
    docs = spark.createDataFrame([(i, t, None, "a", 0) for i, t in zip(ids, texts)], DOCS)
    good = {i for i, q, _ in labels if q == 1}
    raw, target = Counter(), Counter()
    for i, t in zip(ids, texts):
        g = grams_of(WORD.findall(t or ""))
        raw.update(g)
        target.update(g if i in good and i is not None else ())
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: round(math.log((target[b] + 10) / (n * share + 10)), 6) for b, n in raw.items()}
    want = []
    for i, t in zip(ids, texts):
        g = grams_of(WORD.findall(t or ""))
        score = sum(ratio[b] for b in g) / len(g) if g else 0.0
        failed = base(t)[-1]
        want.append((i, base(t)[0], failed, score, not failed and round(score, 9) >= -0.1))
    got = quality_rules.judge(docs, spark.createDataFrame(labels, LABELS)).collect()
    key = lambda r: (str(r[0]), r[1], r[3])
    got = sorted(((r.doc_id, r.n_words, r.base_failed, r.score, r.kept) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=2e-8) and (a[4] == b[4] or abs(b[3] + 0.1) < 1e-7), (a, b)
    assert {x[4] for x in want} == {True, False}


def test_log_ratio_separates(spark):
    good = [" ".join(f"word{(i * 7 + k) % 40}" for k in range(60)) for i in range(40)]
    bad = [" ".join(f"zz{(i * 3 + k) % 50}***" for k in range(60)) for i in range(40)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, 1, 0), (3, None, 0)], LABELS)
    got = {r.doc_id: r for r in quality_rules.judge(docs.withColumn("kept", F.lit(1)), labels).collect()}
    assert min(got[i].score for i in range(40)) > max(got[i].score for i in range(40, 80))
    kept = quality_rules.keep_good(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "score"]
    assert {r.score for r in kept.collect()} <= {"mine"}


def test_rules_on_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.keep_good(empty, labels).count() == 0


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SECRETS = [None, "", "password = abcdefgh and token:abc123", "token=secret:abcdefghij", "API_KEY='Zx9Kq2Lm8Pw4Rt6Yv1Bn'",
           "é AKIAABCDEFGHIJKL é AKIASHORT AKIAAKIAABCDEFGH", "0123456789abcdef0123456789abcdef0 deadbeef",
           "key qZ8xW3vB6nM1kL4jH7gF2dS9aP0oI5uY here", "see /news/2020/01/some-long-title-here-for-you ok",
           "id 123e4567-e89b-12d3-a456-426614174000", "password=aaaaaaaa password=aaaaaaaa", "word " * 5000]


def known(t):
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secret_spans(spark):
    got = secrets.scan(docs_of(spark, SECRETS)).select("doc_id", "base_spans", "spans",
                                                       secrets.listed(F.col("spans")).alias("listed")).collect()
    for r in got:
        assert [tuple(s) for s in r.base_spans] == known(SECRETS[r.doc_id]), r.doc_id
        assert [tuple(s) for s in r.spans if s.rank < 3] == known(SECRETS[r.doc_id])
    listed = {r.doc_id: r.listed for r in got}
    assert listed[7] == "entropy:4:36" and "entropy" not in listed[8] + listed[9]
    assert listed[0] == listed[1] == ""


def spans_by_force(text):
    """All spans by a plain walk over every candidate and window."""
    import math
    base = known(text)
    out = list(base)
    for m in re.finditer(secrets.CANDIDATE.replace("}+", "}"), text):
        c = m[0]
        if any(re.search(p, c) for p in secrets.ALLOWED) or not re.search("[0-9]", c):
            continue
        hexa = re.fullmatch("[0-9a-f]+|[0-9A-F]+", c)
        both = re.search("[a-z]", c) and re.search("[A-Z]", c)
        if not (re.search("[A-Fa-f]", c) if hexa else both or re.search("[0-9][^0-9]*[A-Za-z][^0-9]*[0-9]", c)):
            continue
        kind = "hex" if hexa else "base64" if not c.isalnum() else "alnum" if both else "one_case"
        best = max(-sum(n / 20 * math.log2(n / 20) for n in Counter(c[i:i + 20]).values()) for i in range(len(c) - 19))
        if round(best, 9) >= secrets.LEAST_BITS[kind]:
            free = [i for i in range(m.start(), m.end()) if not any(a <= i < b for a, _, b in base)]
            for _, run in itertools.groupby(enumerate(free), lambda x: x[1] - x[0]):
                at = [i for _, i in run]
                out.append((at[0], 3, at[-1] + 1))
    return sorted(out)


def test_entropy_spans_match_a_plain_walk(spark):
    rng = random.Random(9)
    texts = ["key 3ax6xn9q2k7m4p8w5z1r0t6v end", "seed JBSWY3DPEHPK3PXP5Q7ZKLM2 x", "Zk3" + "0123456789abcdef" * 2 + "Qx9LmN",
             "internationalization2024 counterrevolutionary", "abcdefghijklmnopqrstuvwxyz", "a1" * 30, "ABCDEF0123456789ABCDEF"]
    alphabets = ["abcdefghij0123", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ+/=", "0123456789abcdef"]
    for _ in range(150):
        texts.append(rng.choice(["", "token=", "x ", "-"]).join(
            "".join(rng.choices(rng.choice(alphabets), k=rng.randint(5, 45))) + rng.choice(["", " ", "_"]) for _ in range(4)))
    got = secrets.scan(docs_of(spark, texts)).select("doc_id", "spans").collect()
    for r in got:
        assert [tuple(s) for s in r.spans] == spans_by_force(texts[r.doc_id]), texts[r.doc_id]
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in got}
    assert spans[0] == [(4, 3, 28)] and spans[1] == [(5, 3, 29)]
    assert spans[2] == [(0, 3, 2), (2, 2, 35), (35, 3, 41)] and spans[3] == []


def test_window_entropy(spark):
    import math
    texts = ["abcdabcdabcdabcdabcdxyz", "aaaa", "0123456789abcdefghijKLMN", "aaaaaaaaaaaaaaaaaaaab"]
    got = docs_of(spark, texts).select("text", secrets.window_entropy(F.col("text")).alias("h")).collect()
    for r in got:
        w = min(20, len(r.text))
        want = max(-sum(c / w * math.log2(c / w) for c in Counter(r.text[i:i + w]).values())
                   for i in range(len(r.text) - w + 1))
        assert r.h == pytest.approx(want, abs=1e-8)


def test_hide_secrets(spark):
    docs = docs_of(spark, SECRETS).withColumn("spans", F.lit("mine"))
    out = {r.doc_id: r for r in secrets.hide(docs).collect()}
    assert secrets.hide(docs).columns == docs.columns and len(out) == len(SECRETS)
    assert out[0].text is None and out[1].text == "" and out[11].text == SECRETS[11]
    assert out[2].text == "[SECRET] and token:abc123" and out[2].n_chars == len(out[2].text)
    assert out[10].text == "[SECRET] [SECRET]" and out[3].spans == "mine"


CONV = "conv_id long, turn long, role string, text string"
NASTY = r"\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", NASTY), (1, 2, "user", None), (1, 3, "assistant", "\\\\</turn>\n"),
            (2, 0, "system", ""), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, None, "x"),
            (4, 1, "a:\n b", "### y\\"), (5, 0, "user", "only"), (5, 1, "assistant", "é" * 5000), (None, 0, "user", "n")]
    frame = spark.createDataFrame(rows, CONV).withColumn("example", F.lit(9))
    examples = chat.expand(frame)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [tuple(t) for t in got[conv].turns] == [(r, x) for _, r, x in turns]
        assert got[conv].loss_text == "".join(x for _, r, x in turns if r == "assistant")
    per = {(r.conv_id, r.example): r for r in examples.collect()}
    assert len([k for k in per if k[0] == 1]) == 2  # one for each reply, nothing after the last
    first = per[(1, 0)]
    assert first.text[:first.loss_start].endswith("### assistant:\n")
    assert "hi" in first.text and first.text[first.loss_end:] == "</turn>\n"
    assert got[1].formatted_chars == sum(len(r.text) for k, r in per.items() if k[0] == 1)
    assert chat.expand(spark.createDataFrame([], CONV)).count() == 0


def targets(sizes):
    total, names = sum(sizes.values()), sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    capped, out = set(), {}
    while True:
        rest = total - sum(3 * sizes[n] for n in capped)
        free = [n for n in names if n not in capped]
        w = sum(weight[n] for n in free)
        out = {n: 3.0 * sizes[n] if n in capped else rest * weight[n] / w for n in names}
        more = {n for n in free if out[n] > 3 * sizes[n]}
        if not more:
            return out
        capped |= more


@pytest.mark.parametrize("sources", [["b", "a", None, "é", "Z"], ["x"] * 5, ["big", "big", "big", "big", "tiny"]])
def test_mix(spark, sources):
    texts = [None if i == 7 else "w " * (1 + (i * 37) % 90) for i in range(60)]
    src = [sources[i % len(sources)] for i in range(60)]
    docs = docs_of(spark, texts, src).withColumn("target", F.lit("mine"))
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id for r in got)) == list(range(60))
    sizes = Counter()
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source == src[r.doc_id]
        sizes[r.source] += r.size
    want, taken = targets(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(5)).collect()}
    assert all(again[r.doc_id] == r for r in got)
    mixed = mixing.curriculum(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == {r.doc_id: r.copies for r in got if r.copies}


def test_mix_edge_cases(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(docs_of(spark, [None, "", " "])).collect()
    assert [(r.size, r.taken, r.copies) for r in got] == [(0, 0, 0)] * 3
    twice = docs_of(spark, ["a b c"]).union(docs_of(spark, ["a b c"]))
    assert sum(r.taken for r in mixing.mix(twice).collect()) == 6


def test_classifier(spark):
    good = [" ".join(["Some", "plain", f"text{i}", "of", "words,", "that", f"reads{i * 3}", "well."] * 3) + f" end {i}." for i in range(60)]
    bad = [" ".join([f"x{i}***", "|", "|", "|", f"{i}$$$"] * 6) for i in range(40)]
    docs = docs_of(spark, good + bad + [None, "", "z" * 50_000])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 100, 2)], LABELS)
    got = {r.doc_id: r for r in pu_classifier.classify(docs, labels).collect()}
    assert len(got) == 103
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert min(got[i].score for i in range(60)) > max(got[i].score for i in range(60, 100))
    # labels of held-out rows are not read
    flipped = labels.withColumn("quality", F.when(pu_classifier.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in pu_classifier.classify(docs, flipped).collect()} == {
        i: r.score for i, r in got.items()}
    everything = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(103)], LABELS)  # no document without a label
    assert len({r.score for r in pu_classifier.classify(docs, everything).collect()}) > 1
    prior = pu_classifier.classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in prior} == {0.5}
    assert pu_classifier.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_all_trusted_documents_count(spark):
    ids = spark.range(20_500)
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    # everything is trusted, so both multinomials are the same
    assert set(quality_rules.log_ratios(docs, labels.union(labels))) == {0.0}


def test_later_copies_follow_the_schedule(spark):
    # the light source, early, is wanted three times: its last copies are due long before the end of a linear walk
    docs = docs_of(spark, ["w " * 10] * 40, ["a"] * 20 + ["b"] * 20)
    got = [r.doc_id for r in mixing.curriculum(docs, weights=(3, 1), most=1.5, schedules=(
        ((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)))).collect()]
    a, b = [i for i, d in enumerate(got) if d < 20], [i for i, d in enumerate(got) if d >= 20]
    assert len(a) == 30 and len(b) == 10
    # two thirds of a are due when 1 - sqrt(1/3) = 0.42 of b is; its 29th copy at 1 - sqrt(1/15) = 0.74, its 30th at 0.82
    assert [sum(x < a[n] for x in b) for n in (20, 28, 29)] == [5, 8, 9]
