"""Token counts against the library."""

import random

import pytest

from cuework.llm import token_counts

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


ODD = [None, "", " ", "\n", "Hello, World! It's 3.14 o'clock.", "aaaa aaaaa aaaaaaa " * 3, "ÉÈ straße naïve", "日本語のテキスト と English",
       "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext|", "tab\tand\x1cseparator\x85next  \n\n x ", "é combining",
       "''' ''s 'S 's'S", "x" * 3000, "abcab" * 2000, "İ Σας ς ½ ² ª", "՘࢏ \U0001f600\U0001f600 \U00018e00x", "  　y", " " * 500 + "z"]


def test_counts_are_the_librarys(library):
    rng = random.Random(3)
    letters = ["abc ABC'é.,!0 \n-|s t", "ab", "ea tiosnr", "<|endoftext|> "]
    texts = ODD + ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(300))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 128), rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x1ffff)]))
                      for _ in range(60)) for _ in range(100)]
    m = token_counts.Merger(VOCABULARY)
    for t, n in zip(texts, m.counts(texts)):
        assert n == library(t), t


def test_memory_and_long_texts(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_PIECES", 20)
    monkeypatch.setattr(token_counts, "AT_ONCE", 7)
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 16)
    monkeypatch.setattr(token_counts, "LONGEST", 5)
    m = token_counts.Merger(VOCABULARY)
    rng = random.Random(4)
    for _ in range(50):
        text = rng.choice([" ", "  ", " \n", " '"]).join(
            "".join(rng.choice("etaoin's") for _ in range(rng.randrange(40))) for _ in range(30))
        assert m.counts([text, text]) == [library(text)] * 2


def test_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (3, "twice", None), (3, "twice", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(docs, VOCABULARY, limit=5)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), library(t), library(t) > 5) for i, t, _ in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: r[1] for r in token_counts.count_tokens(docs, VOCABULARY).select("doc_id", "n_tokens").collect()}
    assert got == {r[0]: library(r[1]) for r in docs.select("doc_id", "text").collect()}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Merger(public.path("word_bpe_49k.json"))
