"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is web text as it comes. With class prior ``p``
the risk of a scorer is ``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))``: the second term, the risk on
negatives, is unbiased but can fall below zero for a flexible model, and is not let (non-negative risk). Where it
does, the step goes up its gradient instead. The model is additive: a weight for each bin of each feature.

Features are measures of shape and repetition, worked out for every whole text with numpy in Arrow batches. The fit
takes a bounded sample of positives and of unlabelled rows (``most`` of each, first by a hash of doc_id); scoring
covers all rows and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuework.llm.textkernel import LOWER, Words, slices_of


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = {"upper": _class(bytes(range(65, 91))), "digit": _class(b"0123456789"), "symbol": _class(b"#*$%&|<>"),
           "stop": _class(b".!?"), "comma": _class(b",;:"), "bracket": _class(b"()[]{}\"'"), "slash": _class(b"/\\_=+@~^`-"),
           "line": _class(b"\n"), "space": _class(b" \t\r\x0b\x0c"), "high": _class(bytes(range(128, 256)))}
FEATURES = [*CLASSES, "words", "word_bytes", "word_spread", "new_words", "new_pairs", "twins", "top_word",
            "symbol_words", "stop_words", "lines_new", "line_words", "new_eights"]


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and the count of the most frequent one."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, o[first], runs)
    return np.bincount(o[first], minlength=n).astype(float), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null texts are empty, and an empty text has zeros."""
    w = Words(texts, LOWER)
    n = len(w.offsets) - 1
    size = np.maximum(np.diff(w.offsets), 1)
    out = np.zeros((n, len(FEATURES)))
    for k, name in enumerate(CLASSES):
        out[:, k] = _per_text(CLASSES[name][w.raw], w.offsets) / size
    words = np.diff(w.at)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    length = w.ends - w.starts
    mean = _per_text(length, w.at) / some
    spread = np.sqrt(np.maximum(_per_text(length * length, w.at) / some - mean * mean, 0))
    different, top = _distinct(w.hashes, owner, n)
    h = w.hashes
    inside = owner[1:] == owner[:-1]
    pairs = (h[:-1] * np.uint64(3) ^ h[1:])[inside]
    new_pairs, _ = _distinct(pairs, owner[1:][inside], n)
    twins = np.bincount(owner[1:][inside & (h[1:] == h[:-1])], minlength=n)
    runs, at = w.shingles(8)
    new_runs, _ = _distinct(runs, np.repeat(np.arange(n), np.diff(at)), n)
    has_symbol = np.add.reduceat(CLASSES["symbol"][w.raw].astype(np.int64), w.starts) > 0 if len(h) else np.zeros(0)
    ends_stop = CLASSES["stop"][w.raw[w.ends - 1]] if len(h) else np.zeros(0)
    # lines: runs of bytes between line breaks, by hash of their words
    breaks = np.flatnonzero(w.raw == 10)
    line_of = np.searchsorted(breaks, w.starts) + owner  # differs between texts too
    new_line = np.ones(len(h), bool)
    new_line[1:] = line_of[1:] != line_of[:-1]
    first = np.flatnonzero(new_line)
    if len(first):
        turn = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
        weights = (np.uint64(2) * turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        line_hash = np.add.reduceat(h * weights, first)
    else:
        line_hash = np.zeros(0, np.uint64)
    lines = np.bincount(owner[first], minlength=n)
    new_lines, _ = _distinct(line_hash, owner[first], n)
    k = len(CLASSES)
    columns = [np.log1p(words), mean, spread, different / some, new_pairs / np.maximum(words - 1, 1), twins / some,
               top / some, _per_text(has_symbol, w.at) / some, _per_text(ends_stop, w.at) / some,
               new_lines / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)),
               new_runs / np.maximum(np.diff(at), 1)]
    for j, c in enumerate(columns):
        out[:, k + j] = c
    return out


class Additive:
    """Sums a weight for the bin of each feature; bins are cut at quantiles of the sample."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray, bias: float):
        self.cuts, self.weights, self.bias = cuts, weights, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Place of each value among all bins of all features."""
        out, base = np.empty(x.shape, np.int64), 0
        for j, c in enumerate(self.cuts):
            out[:, j] = base + np.searchsorted(c, x[:, j], "right")
            base += len(c) + 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.bins(x)].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05,
        decay: float = 1e-3, bins: int = 12) -> Additive:
    """Minimises the non-negative risk with the sigmoid loss by Adam. Without positives, every score is the prior."""
    if not len(positive) or not len(unlabelled):
        return Additive([np.zeros(0)] * len(FEATURES), np.zeros(len(FEATURES)), float(np.log(prior / (1 - prior))))
    both = np.concatenate([positive, unlabelled])
    cuts = [np.unique(np.quantile(both[:, j], np.arange(1, bins) / bins)) for j in range(both.shape[1])]
    model = Additive(cuts, np.zeros(sum(len(c) + 1 for c in cuts)), 0.0)
    p, u = model.bins(positive), model.bins(unlabelled)
    size = len(model.weights)
    theta = np.zeros(size + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def push(rows, slope):  # gradient of the sum of slope * z over the rows
        g = np.bincount(rows.ravel(), np.repeat(slope, rows.shape[1]), size)
        return np.append(g, slope.sum())

    for t in range(1, steps + 1):
        zp, zu = theta[p].sum(1) + theta[-1], theta[u].sum(1) + theta[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        dp, du = sp * (1 - sp) / len(zp), su * (1 - su) / len(zu)
        negative = su.mean() - prior * sp.mean()
        unlabelled_grad = push(u, du) - push(p, prior * dp)
        if negative >= 0:
            g = push(p, -prior * dp) + unlabelled_grad
        else:
            g = -unlabelled_grad
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    model.weights, model.bias = theta[:-1], float(theta[-1])
    return model


def held_out(doc_id: Column) -> Column:
    """One document in five, by the checksum of its id as text, is never learned from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(ids: DataFrame, most: int) -> DataFrame:
    return ids.distinct().orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = 10_000) -> Additive:
    """Fits on at most ``most`` positives and ``most`` unlabelled documents; the prior is the share of good ones among
    all labels that may be learned from. Where every document carries a label, documents as they come, labels ignored,
    stand for unlabelled ones."""
    usable = labels.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    good = F.count_if(F.col("quality") == 1)
    got = usable.agg(good.alias("good"), F.count("quality").alias("all")).first()
    prior = min(max(got["good"] / got["all"], 0.05), 0.95) if got["all"] else 0.5
    positives = _sample(usable.where("quality = 1").select(F.col("doc_id").cast("long").alias("_id")), most)
    ids = docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("_id"))
    unlabelled = _sample(ids.join(labels.select(F.col("doc_id").cast("long").alias("_id")), "_id", "left_anti"), most)
    if unlabelled.isEmpty():
        unlabelled = _sample(ids, most)
    chosen = positives.withColumn("_good", F.lit(True)).unionByName(unlabelled.withColumn("_good", F.lit(False)))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")

    def run(batches):
        for b in batches:
            for i, j in slices_of(b.column(0)):
                x = features(b.column(0)[i:j])
                yield pa.RecordBatch.from_arrays(
                    [b.column(1)[i:j], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(
                        pa.list_(pa.float64()))], ["good", "x"])

    got = rows.select("text", "_good").mapInArrow(run, "good boolean, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), -1) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(got) else np.zeros(0, int)  # sums then come out alike in any run
    x, good = x[order], got["good"].to_numpy(bool)[order]
    return fit(x[good], x[~good], prior)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 10_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null texts are empty and scored like any other; without labels every score is the prior. Repeated rows are scored
    each; an empty table gives no rows; only doc_id and text are read, and only the text makes the score.
    """
    model = train(docs, labels, most)

    def run(batches):
        for b in batches:
            for i, j in slices_of(b.column(2)):
                s = np.round(model.score(features(b.column(2)[i:j])), 9)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
