"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks that are coded on their own: the model starts anew in each and a checksum closes it. In a
block three models predict the next id. Order 2 and order 1 each remember, for the last two ids or the last one, the
id that followed and how often it came true. Order 0 counts groups of ids. The prediction is the mixture

    P(id) = m2 [id = guess 2] + m1 [id = guess 1] + m0 P0(id)

whose weights follow how often guesses of the same confidence came true. An arithmetic (range) coder spends
``-log2 P`` bits on each id. Blocks are independent, so many of them advance together, one id at a time: every
numpy operation works on one id of all blocks, and coder and decoder run the same model.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096  # ids
LANES = 1024  # blocks that advance together
MAGIC = b"CMR1"
HEADER = struct.Struct("<4sIIII")  # magic, ids, segments, bytes of coded words, checksum of those and all that follows
SEGMENT = np.dtype([("ordinal", "<u8"), ("doc_id", "<i8"), ("start", "<u4"), ("length", "<u4"), ("flags", "<u4")])
NULL_ID, LAST = 1, 2  # flags of a segment

BITS, WORD = 48, 16
BOT, MASK = 1 << (BITS - WORD), (1 << BITS) - 1
UNIT = 1024  # sum of the mixture weights
SLOTS = 2048
GAIN = 64
# groups of neighbouring ids, narrow ones for the frequent low ids: first id, ids in a group
EDGES = ((0, 4), (1024, 32), (8192, 256))
LOW = np.concatenate([np.arange(a, b, w) for (a, w), b in zip(EDGES, (1024, 8192, 65536))])
SHIFT = np.concatenate([np.full((b - a) // w, w.bit_length() - 1) for (a, w), b in zip(EDGES, (1024, 8192, 65536))])
GROUPS, FINE = len(LOW), 32
COARSE = GROUPS // FINE
GROUP_OF = np.repeat(np.arange(GROUPS), 1 << SHIFT)


class Mixer:
    """The model of many blocks at once; ``k`` is the number of blocks still running (the first ones).

    Tables of all blocks lie one after the other in flat arrays. A slot of a context holds the guess (16 bits) and how
    sure it is (4 bits above).
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.slot0, self.odds0, self.group0, self.cum0 = lane * SLOTS, lane * 16, lane * GROUPS, lane * (GROUPS + 1)
        self.slots = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]
        start = np.minimum(8 + 48 * np.arange(16), UNIT // 2)
        self.odds = [np.tile(start, lanes).astype(np.int64) for _ in range(2)]
        self.count = np.zeros((lanes, GROUPS), np.int32)
        self.each = np.ones((lanes, GROUPS), np.int64)
        self.cum = np.zeros((lanes, GROUPS + 1), np.int64)
        self.coarse = np.zeros((lanes, COARSE - 1), np.int64)
        self.flat_count, self.flat_each, self.flat_cum = self.count.ravel(), self.each.ravel(), self.cum.ravel()
        self.last = [np.zeros(lanes, np.int64) for _ in range(2)]
        self.refresh(lanes)

    def refresh(self, k: int) -> None:
        self.each[:k] = 1 + ((self.count[:k] * GAIN) >> SHIFT)
        np.cumsum(self.each[:k] << SHIFT, axis=1, out=self.cum[:k, 1:])
        self.coarse[:k] = self.cum[:k, FINE:GROUPS:FINE]

    def predict(self, k: int) -> None:
        c1, c2 = self.last
        h1 = c1[:k] * 40503
        h2 = ((h1 + c2[:k] * 30011) & 0xFFFF) >> 5
        self.at = [self.slot0[:k] + ((h1 & 0xFFFF) >> 5), self.slot0[:k] + h2]
        found = [t.take(i) for t, i in zip(self.slots, self.at)]
        self.p = [x & 0xFFFF for x in found]
        self.n = [x >> 16 for x in found]
        self.level = [self.odds0[:k] + n for n in self.n]
        self.q = [o.take(i) for o, i in zip(self.odds, self.level)]
        self.m2 = self.q[1]
        self.m1 = ((UNIT - self.m2) * self.q[0]) >> 10
        self.m0 = UNIT - self.m2 - self.m1
        self.total = self.cum[:k, GROUPS]

    def _zero(self, k: int, ids: np.ndarray):
        """Start and length of ids in order 0, and their groups."""
        g = GROUP_OF.take(ids)
        each = self.flat_each.take(self.group0[:k] + g)
        return self.flat_cum.take(self.cum0[:k] + g) + (ids - LOW.take(g)) * each, each, g

    def place(self, k: int, ids: np.ndarray):
        """Start and length of ids (one for each block) in the mixture, whose total is UNIT * total."""
        start, each, self.g = self._zero(k, ids)
        p1, p2 = self.p
        w1, w2 = self.total * self.m1, self.total * self.m2
        start = self.m0 * start + w1 * (ids > p1) + w2 * (ids > p2)
        return start, self.m0 * each + w1 * (ids == p1) + w2 * (ids == p2)

    def find(self, k: int, v: np.ndarray) -> np.ndarray:
        """The ids whose stretches hold the values ``v``."""
        p1, p2 = self.p
        first = p1 <= p2
        a, b = np.minimum(p1, p2), np.maximum(p1, p2)
        w1, w2 = self.total * self.m1, self.total * self.m2
        ma = np.where(first, w1, w2)
        mb = w1 + w2 - ma  # with equal guesses both weights lie side by side
        a0, each_a, _ = self._zero(k, a)
        b0, each_b, _ = self._zero(k, b)
        a0, b0 = self.m0 * a0, self.m0 * b0
        same = a == b
        a1 = a0 + self.m0 * each_a + ma + np.where(same, mb, 0)
        beyond_a = v >= a1
        w = np.where(beyond_a, v - ma, v)
        b1 = b0 + self.m0 * each_b + mb
        beyond_b = beyond_a & (w >= np.where(same, b0, b1))
        in_a = ~beyond_a & (v >= a0)
        in_b = beyond_a & ~beyond_b & (w >= b0)
        u = np.minimum(np.where(beyond_b, w - mb, w) // self.m0, self.total - 1)
        at = (self.coarse[:k] <= u[:, None]).sum(1) * FINE
        base = self.cum0[:k]
        step = FINE // 2
        while step:
            more = at + step
            at = np.where(self.flat_cum.take(base + more) <= u, more, at)
            step //= 2
        ids = LOW.take(at) + (u - self.flat_cum.take(base + at)) // self.flat_each.take(self.group0[:k] + at)
        return np.where(in_a, a, np.where(in_b, b, ids))

    def learn(self, k: int, ids: np.ndarray, step: int) -> None:
        for slots, odds, at, p, n, level, q in zip(
                self.slots, self.odds, self.at, self.p, self.n, self.level, self.q):
            hit = p == ids
            odds[level] = q + np.where(hit, (UNIT - 24 - q) >> 4, -(q >> 4))
            sure = np.where(hit, np.minimum(n + 1, 15), n >> 1)
            slots[at] = np.where(hit | (n > 0), p | (sure << 16), ids | (1 << 16))
        i = self.group0[:k] + self.g
        self.flat_count[i] = self.flat_count.take(i) + 1
        c1, c2 = self.last
        c2[:k] = c1[:k]
        c1[:k] = ids
        if step % 128 == 127 or step in (7, 15, 31, 63):
            self.refresh(k)


def _running(sizes: np.ndarray, step: int) -> int:
    return int(np.searchsorted(-sizes, -step, "left"))  # sizes descend


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded words of each block of ids (each at least one id)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    for a in range(0, len(order), LANES):
        part = order[a:a + LANES]
        for i, raw in zip(part, _encode([blocks[i] for i in part])):
            out[i] = raw
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks])
    lanes, most = len(blocks), int(sizes[0])
    ids = np.zeros((most, lanes), np.int64)
    for i, b in enumerate(blocks):
        ids[:len(b), i] = b
    model = Mixer(lanes)
    words = np.zeros((lanes, 3 * most + 16), np.uint16)
    pos = np.zeros(lanes, np.int64)
    low, size = np.zeros(lanes, np.int64), np.full(lanes, MASK, np.int64)
    for step in range(most):
        k = _running(sizes, step)
        x = ids[step, :k]
        model.predict(k)
        start, length = model.place(k, x)
        lo, rng = low[:k], size[:k]
        r = rng // (model.total * UNIT)
        lo += r * start
        np.multiply(r, length, out=rng)
        while True:
            settled = (lo ^ (lo + rng)) < BOT
            need = np.flatnonzero(settled | (rng < BOT))
            if not len(need):
                break
            l, s = lo[need], rng[need]
            s = np.where(settled[need], s, -l & (BOT - 1))
            words[need, pos[need]] = l >> (BITS - WORD)
            pos[need] += 1
            lo[need] = (l << WORD) & MASK
            rng[need] = s << WORD
            if int(pos[need].max()) >= words.shape[1] - 8:
                words = np.concatenate([words, np.zeros_like(words)], axis=1)
        model.learn(k, x, step)
    for _ in range(BITS // WORD):
        words[np.arange(lanes), pos] = low >> (BITS - WORD)
        pos += 1
        low = (low << WORD) & MASK
    return [words[i, :p].astype("<u2").tobytes() for i, p in enumerate(pos.tolist())]


def decode_blocks(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of coded blocks, as unsigned 32-bit numbers."""
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(coded)
    for a in range(0, len(order), LANES):
        part = order[a:a + LANES]
        for i, ids in zip(part, _decode([coded[i] for i in part], np.array([sizes[i] for i in part]))):
            out[i] = ids
    return out


def _decode(coded: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    lanes, most = len(coded), int(sizes[0])
    longest = max(map(len, coded)) // 2
    words = np.zeros((lanes, longest + 4), np.int64)
    for i, raw in enumerate(coded):
        words[i, :len(raw) // 2] = np.frombuffer(raw, "<u2")
    ids = np.zeros((most, lanes), np.int64)
    model = Mixer(lanes)
    code = (words[:, 0] << 32) | (words[:, 1] << 16) | words[:, 2]
    pos = np.full(lanes, 3)
    low, size = np.zeros(lanes, np.int64), np.full(lanes, MASK, np.int64)
    for step in range(most):
        k = _running(sizes, step)
        model.predict(k)
        lo, rng, cd = low[:k], size[:k], code[:k]
        top = model.total * UNIT
        r = rng // top
        x = model.find(k, np.minimum((cd - lo) // r, top - 1))
        start, length = model.place(k, x)
        lo += r * start
        np.multiply(r, length, out=rng)
        while True:
            settled = (lo ^ (lo + rng)) < BOT
            need = np.flatnonzero(settled | (rng < BOT))
            if not len(need):
                break
            l, s = lo[need], rng[need]
            s = np.where(settled[need], s, -l & (BOT - 1))
            cd[need] = ((cd[need] << WORD) & MASK) | words[need, np.minimum(pos[need], longest + 3)]
            pos[need] += 1
            lo[need] = (l << WORD) & MASK
            rng[need] = s << WORD
        ids[step, :k] = x
        model.learn(k, x, step)
    return [ids[:n, i].astype("<u4") for i, n in enumerate(sizes.tolist())]


def seal(segments: np.ndarray, n_ids: int, coded: bytes) -> bytes:
    """A block of the file format: header, segments (pieces of documents, in order), coded words."""
    body = segments.tobytes() + coded
    return HEADER.pack(MAGIC, n_ids, len(segments), len(coded), _check(n_ids, len(segments), len(coded), body)) + body


def _check(n_ids: int, n_segments: int, n_bytes: int, body: bytes) -> int:
    return zlib.crc32(body, zlib.crc32(struct.pack("<III", n_ids, n_segments, n_bytes)))


def unseal(block: bytes) -> tuple[np.ndarray, int, bytes]:
    """Segments, number of ids and coded words; raises if the block is damaged."""
    if len(block) < HEADER.size:
        raise ValueError("block is cut off")
    magic, n_ids, n_segments, n_bytes, check = HEADER.unpack_from(block)
    body = block[HEADER.size:]
    if magic != MAGIC or len(body) != n_segments * SEGMENT.itemsize + n_bytes or _check(
            n_ids, n_segments, n_bytes, body) != check:
        raise ValueError("block is damaged")
    cut = n_segments * SEGMENT.itemsize
    return np.frombuffer(body[:cut], SEGMENT), n_ids, body[cut:]


POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's polynomial (bit-reversed)."""
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = (b >> 1) ^ POLY if b & 1 else b >> 1
    return out


_POWERS = [1 << 30]  # x to the power 2^k
for _ in range(31):
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """Checksum of two byte strings, one after the other, from theirs."""
    power, n, k = 1 << 31, second_bytes, 3
    while n:
        if n & 1:
            power = _times(_POWERS[k & 31], power)
        n >>= 1
        k += 1
    return _times(power, first) ^ second
