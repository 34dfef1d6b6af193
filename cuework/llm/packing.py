"""Packing: order-preserving dynamic programming over cut points, with a monotone queue.

Documents keep the order in which they are stored. A window may be cut after a document (free), after a sentence
(a small penalty) or, in runs without sentence ends, inside one (a larger penalty). With ``f(i)`` the least cost
of all windows up to cut ``i``,

    f(i) = penalty(i) + min(min over i - width <= j < i of f(j) + width - (i - j),
                            min over j = i - 2^k of f(j))

because a window is padded to ``width`` unless its length is a power of two. The first minimum is
``width - i + min(f(j) + j)`` over a sliding range of cuts: the front of a monotone queue.

Each task packs the rows of its own input split, so nothing is shuffled and a task that is run again gives
the same rows. Tokens are held for one block at a time (``block`` tokens); the windows near the end of a block
are left open and planned again with the next one. A document larger than a block is fed in parts.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.llm.tokens import encoder

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, cut string")
DOC, SENTENCE, INSIDE = 0, 1, 2


def plan_cuts(at: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Indices of the chosen cuts. ``at``: ascending positions, the first 0; gaps of at most ``width``."""
    n = len(at)
    if n < 2:
        return []
    spots = at.tolist()
    cost = penalty.tolist()
    free: dict[int, list[int]] = {}
    k = max(1, width // 64)  # shorter windows are not worth a sequence of their own
    while k <= width:
        back = np.searchsorted(at, at - k)
        for i in np.flatnonzero((at >= k) & (at[np.minimum(back, n - 1)] == at - k)).tolist():
            free.setdefault(i, []).append(int(back[i]))
        k *= 2
    best, came = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(j) + j's position, j), ascending
    for i in range(1, n):
        p = spots[i]
        while spots[queue[0][1]] < p - width:
            queue.popleft()
        key, j = queue[0]
        least = key + width - p
        for j2 in free.get(i, ()):
            if best[j2] < least:
                least, j = best[j2], j2
        best[i] = least = least + cost[i]
        came[i] = j
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    out, i = [], n - 1
    while i:
        out.append(i)
        i = came[i]
    return out[::-1]


class Packer:
    """Takes documents in order, gives pieces. Holds at most a block of ids and one encoded document."""

    def __init__(self, width: int, block: int, sentence_penalty: int, inside_penalty: int, first: int, enc):
        self.width, self.block, self.enc = width, max(block, 4 * width), enc
        self.penalty = np.array([0, sentence_penalty, inside_penalty])
        self.seq = first
        self.docs: list[tuple] = []  # (doc_id, start of this part in its document, ids, doc_tokens, last part)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        total = len(ids)
        for a in range(0, total, self.block):
            part = ids[a:a + self.block]
            self.docs.append((doc_id, a, part, total, a + self.block >= total))
            self.held += len(part)
            if self.held >= self.block:
                yield from self.flush(False)

    def flush(self, end: bool):
        if not self.docs:
            return
        ids = np.concatenate([d[2] for d in self.docs])
        sizes = np.array([len(d[2]) for d in self.docs])
        edges = np.cumsum(sizes)
        kind = np.full(len(ids) + 1, -1, np.int8)
        stop = self.enc.stop[ids]
        stop[:-1] &= ~self.enc.digit[ids[1:]]  # not the point of a number
        kind[1:][stop] = SENTENCE
        kind[0] = DOC
        whole = np.array([d[4] for d in self.docs])
        kind[edges[whole]] = DOC
        kind[edges[~whole]] = np.where(kind[edges[~whole]] < 0, INSIDE, kind[edges[~whole]])
        at = np.flatnonzero(kind >= 0)
        if at[-1] != len(ids):
            kind[len(ids)] = INSIDE
            at = np.append(at, len(ids))
        # long runs without a sentence end get cuts inside, so that no gap is wider than a window
        step = self.width // 16
        gaps = np.diff(at)
        wide = np.flatnonzero(gaps > step)
        if len(wide):
            more = np.concatenate([np.arange(at[g] + step, at[g + 1], step) for g in wide])
            kind[more] = INSIDE
            at = np.flatnonzero(kind >= 0)
        cuts = at[plan_cuts(at, self.penalty[kind[at]], self.width)]
        if not end:  # the last windows may change with what follows
            keep = cuts <= len(ids) - 2 * self.width
            cuts = cuts[keep]
        if not len(cuts):
            return
        yield from self.pieces(ids, edges, cuts, kind)
        done = int(cuts[-1])
        rest = []
        for (doc_id, start, part, total, last), e, size in zip(self.docs, edges.tolist(), sizes.tolist()):
            if e > done:
                skip = max(0, done - (e - size))
                rest.append((doc_id, start + skip, part[skip:], total, last))
        self.docs, self.held = rest, len(ids) - done

    def pieces(self, ids, edges, cuts, kind):
        wide = ids.astype("<u4")
        names = ("document", "sentence", "inside")
        a, d = 0, 0
        ends = edges.tolist()
        for b in cuts.tolist():
            offset = 0
            while a < b:
                while ends[d] <= a:
                    d += 1
                e = min(ends[d], b)
                doc_id, start, part, total, _ = self.docs[d]
                begin = start + a - (ends[d] - len(part))
                yield (doc_id, begin, e - a, zlib.crc32(wide[a:e]), total, self.seq, offset,
                       names[kind[b]] if e == b else "document")
                offset += e - a
                a = e
            self.seq += 1


def pack(docs: DataFrame, tokenizer: str, width: int = 4096, end_id: int = 2, block: int = 1 << 19,
         sentence_penalty: int = 4, inside_penalty: int = 32, order_by: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most ``width`` ids.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null text is empty: its document is the
    end id alone. Repeated rows are packed each. Rows come in stored order, or sorted over the whole table by
    ``order_by``. An empty table gives no rows. Every id lies in exactly one piece; a sequence is padded to
    ``width`` unless its length is a power of two. ``cut`` says where the piece ends.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       *([F.col(order_by).alias("_order")] if order_by else []))
    if order_by:
        rows = rows.repartitionByRange("_order", "doc_id").sortWithinPartitions("_order", "doc_id")
    rows = rows.select("doc_id", "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"]
    types = [pa.int64()] * 7 + [pa.string()]

    def run(batches):
        enc = encoder(tokenizer)
        packer = Packer(width, block, sentence_penalty, inside_penalty,
                        TaskContext.get().partitionId() << 40, enc)
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in byte_slices(lengths):
                part = texts[i:j].to_pylist()
                for k, raw in zip(keys[i:j], enc.encode(part)):
                    out.extend(packer.add(k, np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id))))
            if len(out) >= 1 << 14:
                yield batch()
        out.extend(packer.flush(True))
        if out:
            yield batch()

    return rows.mapInArrow(run, PIECES)


def byte_slices(lengths: np.ndarray, most: int = 1 << 20):
    """(start, end) of runs of rows with about ``most`` bytes."""
    if not len(lengths):
        return
    group = np.cumsum(lengths + 1) // most
    edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    yield from zip(edge, edge[1:])
