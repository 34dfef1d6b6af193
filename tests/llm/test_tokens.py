"""Packing, token files and fingerprints against plain walks."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuework.llm import codec, lz_fingerprint, packing, token_files, tokens
from cuework.llm.tokens import encoder

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = [None, "", "Hello, World! It's 3.14 o'clock.", "ÉÈ straße naïve", "日本語のテキスト と English", "<|endoftext|> in text",
       "tab\tand\x1cseparator\x85next", "e\u0301 combining", "''' ''s 'S 's'S", "a  b\n\nc ", "x" * 3000, "İ Σας ς", "½ ² ª"]


def test_encoder_is_exact(whole):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abc ABC'é.,!0 \n-|s t") for _ in range(200)) for _ in range(100)]
    for text, raw in zip(texts, encoder(VOCABULARY).encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == whole(text), text


def test_a_full_memory_keeps_the_words_in_use(whole, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 40)
    enc, learnt = tokens.Encoder(VOCABULARY), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (learnt.extend(words), learn(words)))
    for i in range(30):
        texts = ["the usual words, again", " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(20))]
        assert [np.frombuffer(r, "<u2").tolist() for r in enc.encode(texts)] == [whole(t) for t in texts]
        assert len(enc.words.young) + len(enc.words.old) < 200
    assert learnt.count("usual") == 1


def plan_by_force(at, penalty, width):
    best = {0: 0}
    for i in range(1, len(at)):
        costs = []
        for j in range(i):
            n = at[i] - at[j]
            if n <= width and j in best:
                free = n >= max(1, width // 64) and n & (n - 1) == 0
                costs.append(best[j] + (0 if free else width - n) + penalty[i])
        best[i] = min(costs)
    return best[len(at) - 1]


def test_cuts_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        width = int(rng.choice([16, 64]))
        at = np.concatenate([[0], np.cumsum(rng.integers(1, width // 2, size=int(rng.integers(1, 40))))])
        penalty = rng.choice([0, 4, 32], size=len(at))
        cuts = packing.plan_cuts(at, penalty, width)
        cost, a = 0, 0
        for i in cuts:
            n = int(at[i]) - a
            assert 0 < n <= width
            free = n >= max(1, width // 64) and n & (n - 1) == 0
            cost += (0 if free else width - n) + int(penalty[i])
            a = int(at[i])
        assert a == at[-1] and cost == plan_by_force(at.tolist(), penalty.tolist(), width)
    assert packing.plan_cuts(np.array([0]), np.array([0]), 16) == []


@pytest.mark.parametrize("width,block", [(4096, 1 << 19), (64, 256)])
def test_pack(spark, whole, width, block):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["the cat.", "a dog", "runs!", "very", "far away"]) for _ in range(rng.randint(1, 400)))
                   for _ in range(40)]
    rows = [(None if i == 20 else i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("offset", F.lit("mine"))
    got = packing.pack(docs, VOCABULARY, width=width, block=block).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array(whole(t) + [2], "<u4"))
    runs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        runs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(want[r.doc_id][0][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert runs.keys() == want.keys()
    for i, ids in want.items():
        spans = sorted((r.start, r.length) for r in runs[i])
        assert sum(n for _, n in spans) == len(ids) * len(ids[0])
        if len(ids) == 1:
            at = 0
            for s, n in spans:
                assert s == at
                at += n
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width
    assert packing.pack(spark.createDataFrame([], DOCS), VOCABULARY).count() == 0
    ordered = packing.pack(docs, VOCABULARY, width=width, block=block, order_by="doc_id").collect()
    assert sum(r.length for r in ordered) == sum(r.length for r in got)


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65536, n) for n in (1, 2, 3, 700)] + [
        np.zeros(500, int), np.full(9, 65535), np.tile([5, 6, 7], 200), rng.geometric(0.01, 900)]
    coded = codec.encode_blocks(blocks)
    for a, b in zip(blocks, codec.decode_blocks(coded, [len(b) for b in blocks])):
        assert a.tolist() == b.tolist()
    assert len(coded[6]) < 200  # repeats are learned
    assert codec.encode_blocks([]) == [] and codec.decode_blocks([], []) == []


def test_damage_is_seen():
    ids = np.arange(50)
    segments = np.array([(0, 7, 0, 50, 2)], codec.SEGMENT)
    block = codec.seal(segments, 50, codec.encode_blocks([ids])[0])
    table, n, coded = codec.unseal(block)
    assert n == 50 and table["doc_id"].tolist() == [7] and codec.decode_blocks([coded], [n])[0].tolist() == ids.tolist()
    for k in (*range(codec.HEADER.size), 30, len(block) - 1):  # the number of ids and all else in the header too
        broken = bytearray(block)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            codec.unseal(bytes(broken))
    with pytest.raises(ValueError):
        codec.unseal(block[:-1])


def test_crc_join():
    a, b = b"some bytes" * 7, b"and others" * 1000
    assert codec.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert codec.crc_join(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_token_files(spark, whole, tmp_path):
    texts = [*ODD, "the long one. " * 6000, "after"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, "twice"), (5, "twice")]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.createDataFrame(rows, DOCS), path, VOCABULARY)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        ids = np.array(whole(t) + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)
    pieces = token_files.read_segments(spark, path).where("doc_id = 5").collect()
    assert {np.frombuffer(p.ids, "<u4").tolist().__str__() for p in pieces} == {str(whole("twice") + [1])}
    empty = str(tmp_path / "empty")
    token_files.write_tokens(spark.createDataFrame([], DOCS), empty, VOCABULARY)
    assert token_files.read_documents(spark, empty).count() == 0


def plain_phrases(text):
    known, start, out = set(), 0, []
    for end in range(1, len(text) + 1):
        if text[start:end] not in known:
            known.add(text[start:end])
            out.append(text[start:end])
            start = end
    return out + ([text[start:]] if start < len(text) else [])


def test_phrases_are_those_of_the_plain_parse():
    rng = random.Random(4)
    for n in (0, 1, 2, 10, 500, 3000):
        text = "".join(rng.choice("ab c") for _ in range(n))
        edges = [0]
        rest = lz_fingerprint.phrases(text, set(), edges, 0, n)
        if rest < n:
            edges.append(n)
        assert [text[a:b] for a, b in zip(edges, edges[1:])] == plain_phrases(text)
        half = [0]
        known = set()
        at = lz_fingerprint.phrases(text, known, half, 0, n // 2)
        rest = lz_fingerprint.phrases(text, known, half, at, n)
        assert half + ([n] if rest < n else []) == edges


def test_signature_estimates_similarity():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    other = text[:14_000] + "".join(rng.choice("abcdefgh ") for _ in range(6_000))
    a, b = map(lz_fingerprint.short, lz_fingerprint.fingerprints(text, other, 14_000))
    x, y = set(plain_phrases(text)), set(plain_phrases(other))
    assert abs(lz_fingerprint.likeness(a, b) - len(x & y) / len(x | y)) < 0.15
    assert lz_fingerprint.likeness(a, a) == 1.0


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_ring(spark, buckets):
    texts = [None, "", "x", "same text here", "same text here", "日本語 テキスト " * 30, "long " * 9000, "abc" * 11]
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in lz_fingerprint.fingerprint(
        spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit("mine")), buckets).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, follower = t or "", order[(k + 1) % len(order)]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + (follower[1] or "")[:cut] if cut else t
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        same, other = lz_fingerprint.fingerprints(t, edited, 0)
        assert r.fingerprint == lz_fingerprint.hexed(lz_fingerprint.short(same))
        assert r.edited_fingerprint == lz_fingerprint.hexed(lz_fingerprint.short(other))
        nxt = lz_fingerprint.short(lz_fingerprint.fingerprints(follower[1] or "", "", 0)[0])
        assert r.near_next == lz_fingerprint.likeness(lz_fingerprint.short(same), nxt)
    assert got[30].fingerprint == got[40].fingerprint


def test_ring_of_few(spark):
    one = lz_fingerprint.fingerprint(spark.createDataFrame([(1, "abcabc")], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert lz_fingerprint.fingerprint(spark.createDataFrame([], DOCS)).count() == 0
    ties = lz_fingerprint.fingerprint(spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (2, "d")], DOCS), 3).collect()
    assert sorted(r.n_chars for r in ties) == [1, 1, 1, 1]
