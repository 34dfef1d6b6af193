"""Embeddings as integers, and in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = float(1 << 31)
BLOCK_BYTES = 1 << 20
BLOCK = "ids array<long>, labels array<int>, dim int, x binary"


def whole_numbers(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """``rows`` with a column ``_x``: the long ``floor(scale * c)`` of each component, worked out in doubles.

    Rows take no part whose vector is null, empty or holds a null or non-finite entry, one of 2^31 or more after
    scaling (sums could not be exact), or whose length is not the most common one among the others (of equally common
    ones the greatest).
    """
    v = F.col(vector)
    big = lambda c: F.abs(c.cast("double") * scale) >= LARGEST
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | big(c))
    rows = rows.where(fine)
    common = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows.withColumn("_x", F.lit(None).cast("array<long>"))
    return rows.where(F.size(v) == common["d"]).withColumn(
        "_x", F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def in_blocks(rows: DataFrame, ident: str, label: Column | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of about ``most`` bytes of vectors, each from one input split; rows of a block are sorted by id, nulls
    first. Columns: ids, labels (null without ``label``), dim, and x as 64-bit integers, row by row."""
    def run(batches):
        def block(held):
            ids = pa.concat_arrays([h[0] for h in held])
            at = pa.compute.sort_indices(ids, null_placement="at_start")
            x = np.concatenate([h[2] for h in held])[at.to_numpy()]
            one = lambda a: pa.ListArray.from_arrays([0, len(a)], a)
            labels = pa.concat_arrays([h[1] for h in held]).take(at)
            return pa.RecordBatch.from_arrays(
                [one(ids.take(at)), one(labels), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())],
                ["ids", "labels", "dim", "x"])

        held, n = [], 0
        for b in batches:
            i = 0
            while i < len(b):
                x = b.column(2)
                dim = len(x[0])
                fit = max(1, most // (8 * dim) - n)
                part = b.slice(i, fit)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
                held.append((part.column(0), part.column(1), flat.reshape(-1, dim)))
                n += len(part)
                i += len(part)
                if n * 8 * dim >= most - 8 * dim:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    label = F.lit(None).cast("int") if label is None else label.cast("int")
    return rows.select(F.col(ident).cast("long").alias("id"), label.alias("label"), F.col("_x").alias("x")).mapInArrow(
        run, BLOCK)


def matrices(batch: pa.RecordBatch):
    """(ids as an Arrow array, labels, matrix of integers) of each block in a batch of rows of :func:`in_blocks`."""
    for k in range(len(batch)):
        ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
        x = np.frombuffer(batch.column("x")[k].as_buffer(), np.int64).reshape(-1, batch.column("dim")[k].as_py())
        yield ids, labels, x
