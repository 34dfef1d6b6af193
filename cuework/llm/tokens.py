"""Token ids by the ``tokenizers`` library, with a memory for words.

Encoding is exact: a text of printable ASCII and Latin letters is lower-cased and split the way the
vocabulary's own pre-tokenizer splits it, pieces not seen before are encoded by the library, and the ids of a
piece are remembered. Pieces of such texts are encoded independently of each other, so joining their ids gives
the ids of the text. Any other text is encoded whole by the library. The memory holds a bounded number of words; when it is
full, those that were not met since it was last full are forgotten. It changes speed only.
"""

from __future__ import annotations

import functools
import re

import numpy as np

PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
PLAIN = bytes([9, 10, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
MOST_WORDS = 500_000  # of each of the two halves of a memory


class Memory:
    """Ids by word in two halves: when the young one is full it becomes the old one, whose words come back as they are met."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words) -> list[str]:
        """Those of some distinct words that are not known; the others are in ``young`` from then on."""
        if len(self.young) > MOST_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = [w for w in words if w not in young]
        if old:
            young.update((w, old[w]) for w in out if w in old)
            out = [w for w in out if w not in young]
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 16-bit ids (the vocabulary has fewer than 65,536)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer.from_file(path)
        # pieces are in normal form and already split
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        size = max(vocab.values()) + 1
        if size > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.word_end = np.zeros(size, bool)
        self.stop = np.zeros(size, bool)
        self.digit = np.zeros(size, bool)
        for token, i in vocab.items():
            if token.endswith("</w>"):
                self.word_end[i] = True
                self.stop[i] = re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*", token[:-4]) is not None
            self.digit[i] = token[:1].isdigit()
        self.size = size
        self.words, self.known = Memory(), Memory()

    def _learn(self, words: list[str]) -> None:
        split = [PIECE.findall(w) for w in words]
        new = self.known.missing(set().union(*split))
        known = self.known.young
        if new:
            ids = np.array(self.pieces.encode(" ".join(new), add_special_tokens=False).ids, "<u2")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(new):  # a piece came apart: take them one by one
                known.update((p, self._direct(p)) for p in new)
            else:
                raw, a = ids.tobytes(), 0
                for p, b in zip(new, ends.tolist()):
                    known[p] = raw[2 * a:2 * b]
                    a = b
        young = self.words.young
        for w, pieces in zip(words, split):
            young[w] = b"".join([known[p] for p in pieces])

    def _direct(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    @staticmethod
    def _plain(text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
        except UnicodeEncodeError:
            return False

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, as the bytes of unsigned 16-bit numbers; null counts as empty."""
        split = [t.lower().split() if t and self._plain(t) else None for t in texts]
        new: set[str] = set()
        for words in split:
            if words:
                new.update(words)
        new = self.words.missing(new)
        words = self.words.young
        if new:
            self._learn(new)
        return [self._direct(t) if w is None and t else b"".join([words[x] for x in w or ()])
                for t, w in zip(texts, split)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
