"""Words, shingles and their hashes for many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1024)
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 1 << 22:  # too large to keep
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch ``values[start:end]`` (ascending, disjoint), worked out in chunks."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(out):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        hi = int(ends[j - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((values[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mixed(out)


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices_of(texts: pa.Array, most: int = 1 << 21):
    """(start, end) of runs of rows with about ``most`` bytes."""
    _, at = column_bytes(texts)
    if len(at) < 2:
        return
    group = (at[1:] + np.arange(1, len(at))) // most
    edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(at) - 1]
    yield from zip(edge, edge[1:])


class Words:
    """Words of some texts: ``hashes`` of all, and ``at``: text ``i`` has words ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, texts: pa.Array, fold: np.ndarray = SAME):
        self.raw, self.offsets = column_bytes(texts)
        space = SPACE[self.raw]
        begin, end = ~space, ~space
        if len(space):
            edge = self.offsets[(self.offsets > 0) & (self.offsets < len(space))]
            joint = np.zeros(len(space), bool)
            joint[edge] = True
            begin[1:] &= space[:-1] | joint[1:]
            end[:-1] &= space[1:] | joint[1:]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.at = np.searchsorted(self.starts, self.offsets)
        self.hashes = span_hashes(fold[self.raw], self.starts, self.ends)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words inside texts, and where each text's begin. With fewer words, the whole
        sequence is one run; a text without words has none."""
        h, n = self.hashes, np.diff(self.at)
        if len(h) >= k:
            run = h[:len(h) - k + 1].copy()
            for j in range(1, k):
                run = mixed(run + np.uint64(j)) ^ h[j:len(h) - k + 1 + j]
            run = mixed(run)
        else:
            run = np.zeros(0, np.uint64)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        at = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        out = np.empty(int(at[-1]), np.uint64)
        # positions: word index of the first word of each run
        first = np.repeat(self.at[:-1] - at[:-1], count) + np.arange(len(out))
        few = np.flatnonzero((n > 0) & (n < k))
        plain = np.ones(len(out), bool)
        plain[at[few]] = False
        out[plain] = run[first[plain]]
        for i in few.tolist():
            v = np.uint64(n[i])
            for x in h[self.at[i]:self.at[i + 1]]:
                v = mixed(np.array([v + np.uint64(77)]))[0] ^ x
            out[at[i]] = v
        return out, at


def distinct_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and where each text's begin."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(at)))
