"""Hard negatives by slot-decomposed selection.

An anchor has a few positives, and each positive allows negatives whose score lies in a window below its own score. The
windows of an anchor overlap, but their upper limits cut the scores into disjoint slots: slot ``j`` holds the scores
above limit ``j + 1`` and up to limit ``j``. A negative falls into one slot. Tasks score blocks of anchors against blocks
of rows and keep the best ``k`` of each slot; these meet per (anchor, slot) and are cut to ``k`` again. Going from the
lowest slot up, the best ``k`` of a slot and all below it are the merge of the slot's with those found just before: that
answers each window, once what is below its lower limit is cut off the end. All scores are exact integers.

Work is anchors x rows by nature. It comes in cells: rows lie in groups of blocks, each block of anchors is copied once a
group, and a task streams a group's cells through numpy, holding two blocks and the best of one block of anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuework.llm.scratch import stored
from cuework.llm.vectors import in_blocks, whole_numbers

ANCHOR_BYTES = 1 << 19  # of a block of anchors
GROUP_BLOCKS = 256  # blocks of rows in a group at most
NO_SCORE, NO_ID = -(1 << 62), (1 << 63) - 1


def scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """(all inner products, a bound of their size), exact."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64), bound
    if bound >= -NO_SCORE:
        raise OverflowError("inner products do not fit in 64 bits")
    return a @ b.T, bound


def best(s: np.ndarray, bound: int, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, whether there is one) of the ``k`` highest allowed scores of each row, of equal ones the first."""
    n = s.shape[1]
    k = min(k, n)
    if bound * n < 1 << 61:
        key = np.where(allowed, s * n + (n - 1 - np.arange(n)), NO_SCORE)
        at = np.argpartition(key, n - k, axis=1)[:, n - k:] if k < n else np.tile(np.arange(n), (len(s), 1))
    else:
        at = np.argsort(np.where(allowed, -s, -NO_SCORE), axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(allowed, at, axis=1)


class Best:
    """The best ``k`` (score, id) of each anchor and slot of a block, over all rows seen."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, anchors, k), NO_SCORE)
        self.ids = np.full((slots, anchors, k), NO_ID)

    def add(self, slot: int, s: np.ndarray, bound: int, allowed: np.ndarray, ids: np.ndarray) -> None:
        at, real = best(s, bound, allowed, self.k)
        score = np.concatenate([self.score[slot], np.where(real, np.take_along_axis(s, at, axis=1), NO_SCORE)], axis=1)
        who = np.concatenate([self.ids[slot], np.where(real, ids[at], NO_ID)], axis=1)
        order = np.lexsort((who, -score), axis=-1)[:, :self.k]
        self.score[slot] = np.take_along_axis(score, order, axis=1)
        self.ids[slot] = np.take_along_axis(who, order, axis=1)

    def rows(self) -> tuple[np.ndarray, ...]:
        slot, i, j = np.nonzero(self.ids != NO_ID)
        return i, slot, self.score[slot, i, j], self.ids[slot, i, j]


def _cells(anchors: DataFrame, blocks: DataFrame, groups: int, columns: str) -> DataFrame:
    """Each block of anchors with each block of rows: joined on the group that a block of rows belongs to."""
    left = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.select("g", F.col("ids").alias("r_ids"), F.col("labels").alias("r_labels"), F.col("x").alias("r_x"))
    return left.join(right, "g").select("block", "ids", "labels", "dim", "x", "r_ids", "r_labels", "r_x", *columns.split())


def _cell(b: pa.RecordBatch, i: int):
    """(anchors' ids, labels, vectors, rows' ids, labels, vectors) of one cell."""
    dim = b.column("dim")[i].as_py()
    out = []
    for p in ("", "r_"):
        out += [b.column(f"{p}{c}")[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels")]
        out.append(np.frombuffer(b.column(f"{p}x")[i].as_buffer(), np.int64).reshape(-1, dim))
    return out


def _positives(anchors: DataFrame, blocks: DataFrame, groups: int, k: int) -> DataFrame:
    """``block, i, anchor_id, p, id, score``: the first ``k`` other rows of each anchor's label, ``p`` from 0."""
    def run(batches):
        def flush():
            i, _, score, ids = top.rows()
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.full(len(i), block), i, own[i], length[i], ids, score)],
                ["block", "i", "anchor_id", "own", "id", "score"])
        block = None
        for b in batches:
            for n in range(len(b)):
                ids, labels, x, r_ids, r_labels, r_x = _cell(b, n)
                if block != b.column("block")[n].as_py():
                    if block is not None:
                        yield flush()
                    block, own, length = b.column("block")[n].as_py(), ids, (x * x).sum(axis=1)
                    top = Best(len(x), 1, k + 1)  # the anchor itself may be among them
                s, bound = scores(x, r_x)
                top.add(0, s, bound, labels[:, None] == r_labels[None, :], r_ids)
        if block is not None:
            yield flush()

    found = _cells(anchors, blocks, groups, "").mapInArrow(
        run, "block long, i long, anchor_id long, own long, id long, score long")
    order = Window.partitionBy("block", "i").orderBy(F.desc("score"), "id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    itself = (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    # one row that looks like the anchor is the anchor
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).withColumn(
        "same", F.sum(F.when(itself, 1).otherwise(0)).over(upto)).where(
        ~(itself & (F.col("same") == 1))).withColumn("p", (F.col("n") - 1 - F.least("same", F.lit(1))).cast("int")).where(
        F.col("p") < k).select("block", "i", "anchor_id", "p", "id", "score")


def _negatives(anchors: DataFrame, blocks: DataFrame, groups: int, k: int) -> DataFrame:
    """``block, i, slot, id, score``: the first ``k`` rows of other labels in each slot of each anchor. ``limits`` of a
    block has a row (anchor, slot, upper limit, lower limit) for each positive."""
    def run(batches):
        def flush():
            i, slot, score, ids = top.rows()
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.full(len(i), block), i, slot.astype(np.int32), ids, score)],
                ["block", "i", "slot", "id", "score"])
        block = None
        for b in batches:
            for n in range(len(b)):
                ids, labels, x, r_ids, r_labels, r_x = _cell(b, n)
                if block != b.column("block")[n].as_py():
                    if block is not None:
                        yield flush()
                    block = b.column("block")[n].as_py()
                    at = b.column("limits")[n].values.flatten()
                    i, slot, high, low = (c.to_numpy(zero_copy_only=False) for c in at)
                    slots = int(slot.max()) + 1
                    upper = np.full((slots + 1, len(x)), NO_SCORE)
                    upper[slot, i] = high
                    least = np.full(len(x), NO_ID)
                    np.minimum.at(least, i, low)
                    top = Best(len(x), slots, k)
                s, bound = scores(x, r_x)
                fits = (labels[:, None] != r_labels[None, :]) & (s >= least[:, None])
                for j in range(slots):
                    top.add(j, s, bound, fits & (s <= upper[j][:, None]) & (s > upper[j + 1][:, None]), r_ids)
        if block is not None:
            yield flush()

    found = _cells(anchors, blocks, groups, "limits").mapInArrow(run, "block long, i long, slot int, id long, score long")
    order = Window.partitionBy("block", "i", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and positive, the first ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` percent of the positive's: columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells the rows that are anchors. A score is the inner product of vectors made of ``floor(scale * c)``;
    higher scores come first, of equal ones the smaller id. An anchor's positives are its first ``positives`` other rows
    of the same label, all if there are fewer. A positive with a negative score has no window.

    Rows with a null id or label take no part, nor those whose vectors :func:`whole_numbers` leaves out. Repeated rows
    count each, as anchors, positives and negatives; an anchor is not its own positive, but its copy is. A table without
    anchors, or an empty one, gives no rows. Further columns are only seen by ``anchors``. Scores beyond 62 bits raise
    OverflowError.
    """
    spark = rows.sparkSession
    rows = whole_numbers(rows.where(F.col(ident).isNotNull() & F.col(label).isNotNull()), vector, scale).select(
        F.col(ident).alias("_id"), F.col(label).cast("int").alias("_label"), "_x", F.coalesce(anchors, F.lit(False)).alias("_a"))
    blocks = stored(in_blocks(rows, "_id", F.col("_label")).withColumn("block", F.monotonically_increasing_id()), "blocks")
    groups = blocks.count()
    groups = max(1, min(groups, max(4 * spark.sparkContext.defaultParallelism, groups // GROUP_BLOCKS)))
    blocks = blocks.withColumn("g", F.pmod(F.hash("block"), F.lit(groups)))
    chosen = stored(in_blocks(rows.where("_a"), "_id", F.col("_label"), ANCHOR_BYTES)
                    .withColumn("block", F.monotonically_increasing_id()), "anchors")
    found = stored(_positives(chosen, blocks, groups, positives).where("score >= 0").select(
        "*", F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"{high} * score div 100").alias("high")), "positives")
    limits = found.groupBy("block").agg(F.collect_list(F.struct("i", "p", "high", "low")).alias("limits"))
    kept = _negatives(chosen.join(limits, "block"), blocks, groups, negatives)
    of_anchor = kept.groupBy("block", "i").agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("s"), "id")).alias("c"))
    windows = found.groupBy("block", "i", "anchor_id").agg(F.collect_list(F.struct("p", "id", "score", "low")).alias("w"))
    # suffix merges: entry 1 is nothing, entry n + 1 the best of the n lowest slots
    merged = windows.join(of_anchor, ["block", "i"]).withColumn("m", F.expr(f"""
        aggregate(sequence(size(w) - 1, 0, -1), cast(array(array()) AS array<array<struct<s: bigint, id: bigint>>>),
          (acc, j) -> concat(acc, array(slice(array_sort(concat(element_at(acc, -1), transform(
            filter(c, e -> e.slot = j), e -> named_struct('s', e.s, 'id', e.id)))), 1, {int(negatives)}))))"""))
    one = merged.select("anchor_id", F.explode("w").alias("w"), "m", F.size("w").alias("n")).select(
        "anchor_id", "w", F.posexplode(F.expr("filter(element_at(m, n - w.p + 1), e -> -e.s >= w.low)")).alias("at", "e"))
    return one.select("anchor_id", F.col("w.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                      F.col("e.id").alias("negative_id"), F.col("w.score").alias("positive_score"),
                      (-F.col("e.s")).alias("negative_score"))
