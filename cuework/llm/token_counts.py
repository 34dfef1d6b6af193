"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens. Those not met before by a Python worker are laid end to end in one array of symbols, one
sequence each. In every round each sequence finds the lowest rank among its adjacent pairs and merges all places of that
pair at once, all sequences in step; sequences without a mergeable pair leave the array. What is left of a sequence are
its tokens. A pair only ever forms pairs of higher rank, so taking all its places at once gives what merging them one by
one gives; where places overlap (``aaa``), every second one counted from the left is merged.

Texts are counted in the task that reads them; nothing is shuffled.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.llm.textkernel import column_bytes, slices_of

# fixed values: how a byte-level vocabulary cuts texts into pre-tokens
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space before another character always begins a pre-token, so texts may be cut there.
WORD = re.compile(r" (?=\S)")
NOT_A_WORD = re.compile(r" (?!\S)")
#: Later characters may be of another class in the library's Unicode tables; it then cuts the text itself.
UNSURE = re.compile("[^\0-՗]")
NONE = np.int32(2**31 - 1)
MOST_PIECES = 500_000  # remembered by a worker; the memory is emptied when full, which changes speed only
LONGEST = 64  # characters of what is remembered
GROUP_BYTES = 1 << 20  # of new pre-tokens merged together
AT_ONCE = 1 << 20  # characters, or pre-tokens, of one text that are cut at a time


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merger:
    """The merge table of a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = not (spec["normalizer"] or spec["post_processor"] or model.get("dropout") or model.get("ignore_merges"))
        if model["type"] != "BPE" or cut != {**cut, "type": "ByteLevel", "add_prefix_space": False, "use_regex": True} \
                or not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.known: dict[str, int] = {}  # tokens of a pre-token
        self.words: dict[str, int] = {}  # tokens of a space and what follows it up to the next

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it can't be merged."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece."""
        size = np.array([len(p) for p in pieces], np.int64)
        count = size.copy()
        alive = np.flatnonzero(size > 1)  # the piece of each sequence
        symbols = self.first[np.frombuffer(b"".join([pieces[i] for i in alive.tolist()]), np.uint8)]
        size = size[alive]
        rank = np.full(len(symbols), NONE)
        if len(rank):
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[np.cumsum(size) - 1] = NONE  # the last symbol of a sequence has no right neighbour
        while len(alive):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            open_ = least != NONE
            count[alive[~open_]] = size[~open_]
            if not open_.all():
                stay = np.repeat(open_, size)
                symbols, rank = symbols[stay], rank[stay]
                alive, size, least = alive[open_], size[open_], least[open_]
                if not len(alive):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # neighbouring places hold the same pair twice: of such a run every second place is merged
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != at[:-1] + 1
            in_run = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            at = at[in_run % 2 == 0]
            owner = np.searchsorted(np.cumsum(size), at, "right")
            symbols[at] = self.made[rank[at]]
            end = np.zeros(len(rank), bool)
            end[np.cumsum(size) - 1] = True
            last = end[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            end[at[last]] = True
            symbols, rank, end = symbols[keep], rank[keep], end[keep]
            size = size - np.bincount(owner, minlength=len(size))
            at = at - np.arange(len(at))  # one symbol less for each place to the left
            stale = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[stale[end[stale]]] = NONE
            stale = stale[~end[stale]]
            rank[stale] = self.rank(symbols[stale], symbols[stale + 1])
        return count

    def learn(self, pieces: set[str]) -> None:
        raw = {p: p.encode("utf-8") for p in pieces}
        group, n = [], 0
        for p, b in [*raw.items(), ("", None)]:
            if group and (b is None or n + len(b) > GROUP_BYTES):
                self.known.update(zip(group, self.merge([raw[q] for q in group]).tolist()))
                group, n = [], 0
            if b is not None:
                group.append(p)
                n += len(b)

    def pieces(self, text: str):
        """Pre-tokens of a text without special strings, in lists of bounded length."""
        if not text.isascii() and UNSURE.search(text):
            yield [text[i:j] for _, (i, j) in self.library.pre_tokenize_str(text)]
        elif len(text) <= AT_ONCE:
            yield PIECE.findall(text)
        else:
            found = (m.group() for m in PIECE.finditer(text))
            while part := list(itertools.islice(found, AT_ONCE)):
                yield part

    def plain(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text, by its pre-tokens."""
        out = []
        for i in range(0, len(texts), 1 << 12):
            cut = [list(self.pieces(t)) for t in texts[i:i + (1 << 12)]]
            new = set().union(*(found for lists in cut for found in lists)).difference(self.known)
            self.learn(new)
            out += [sum(sum(map(self.known.__getitem__, found)) for found in lists) for lists in cut]
            for p in new:
                if len(p) > LONGEST:
                    del self.known[p]
            if len(self.known) > MOST_PIECES:
                self.known.clear()
        return out

    def spaced(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text, word by word; words not met before are merged together."""
        cut = [WORD.split(t) if NOT_A_WORD.search(t) else t.split(" ") for t in texts]
        first = self.plain([words[0] for words in cut])
        new = list(set().union(*(words[1:] for words in cut)).difference(self.words))
        self.words.update(zip(new, self.plain([" " + w for w in new])))
        n = [f + sum(map(self.words.__getitem__, words[1:])) for f, words in zip(first, cut)]
        for w in new:
            if len(w) > LONGEST:
                del self.words[w]
        if len(self.words) > MOST_PIECES:
            self.words.clear()
        return n

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; null counts as empty, a special string is one token."""
        n = [0] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0

        def take():
            for (i, _), k in zip(held, self.spaced([t for _, t in held])):
                n[i] += k
            held.clear()

        for i, text in enumerate(texts):
            parts = self.special.split(text or "") if self.special else [text or ""]
            n[i] += len(parts) - 1
            for part in parts:
                if not part.isascii() and UNSURE.search(part):
                    n[i] += self.plain([part])[0]
                    continue
                at = 0
                while at < len(part):
                    m = WORD.search(part, at + AT_ONCE) if len(part) - at > AT_ONCE else None
                    end = m.start() if m else len(part)
                    held.append((i, part[at:end]))
                    size += end - at
                    at = end
                    if size > AT_ONCE:
                        take()
                        size = 0
        take()
        return n


@functools.cache
def merger(path: str) -> Merger:
    """One for each Python worker."""
    return Merger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (columns ``doc_id`` and ``text``).

    ``n_tokens`` is what the library gives for the file ``vocabulary`` (a byte-level BPE), with special strings in texts
    as one token each and nothing added; ``over_limit`` says whether it exceeds ``limit``.

    A null text counts as empty and has no tokens; a null doc_id stays; rows that are repeated are counted each; ties
    don't arise. Whole texts are counted, a very long one in lists of bounded length. Columns besides doc_id and text
    are not read, whatever their names. An empty table gives an empty one.
    """
    def run(batches):
        m = merger(vocabulary)
        for b in batches:
            texts = b.column(1)
            for i, j in slices_of(texts):
                part = texts.slice(i, j - i)
                _, at = column_bytes(part)
                n = m.counts(part.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(n, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
