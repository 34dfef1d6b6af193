"""Token files: ids of documents in ascending order, in blocks coded by ``codec``, and the way back.

A token file is a set of shards. A shard holds the documents of one range of doc_id, in order, as blocks of
``codec.BLOCK`` ids; blocks are rows (shard, block, n_ids, data) of a Parquet folder, so that Spark's committer
decides which attempt of a task counts and any store that Spark reaches will do. ``data`` is the block of the
format: header, table of document pieces, coded words, checksum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cuework.llm import codec
from cuework.llm.packing import byte_slices
from cuework.llm.tokens import encoder

BLOCKS = "shard int, block long, n_ids long, data binary"


def _write_blocks(tokenizer: str, end_id: int):
    def run(batches):
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        ids, segments, blocks = [], [], []
        room, number, ordinal = codec.BLOCK, 0, 0

        def batch():
            nonlocal number
            coded = codec.encode_blocks([b for b, _ in blocks])
            data = [codec.seal(s, len(b), c) for (b, s), c in zip(blocks, coded)]
            n = len(blocks)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()),
                 pa.array([len(b) for b, _ in blocks], pa.int64()), pa.array(data, pa.binary())],
                ["shard", "block", "n_ids", "data"])
            number += n
            blocks.clear()
            return out

        def close():
            nonlocal room
            blocks.append((np.concatenate(ids), np.array(segments, codec.SEGMENT)))
            ids.clear()
            segments.clear()
            room = codec.BLOCK

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for i, j in byte_slices(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)):
                for key, raw in zip(keys[i:j], enc.encode(texts[i:j].to_pylist())):
                    doc = np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id))
                    a = 0
                    while a < len(doc):
                        n = min(room, len(doc) - a)
                        flags = (codec.NULL_ID if key is None else 0) | (codec.LAST if a + n == len(doc) else 0)
                        segments.append((ordinal, key or 0, a, n, flags))
                        ids.append(doc[a:a + n])
                        a += n
                        room -= n
                        if not room:
                            close()
                            if len(blocks) == codec.LANES:
                                yield batch()
                    ordinal += 1
        if ids:
            close()
        if blocks:
            yield batch()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the ids of all documents, each closed by ``end_id``, in ascending doc_id order.

    Null texts are empty (the end id alone). Null doc_ids come first; equal doc_ids are ordered by text, and every
    row is a document of its own. Other columns are ignored. An empty table gives a file without blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write_blocks(tokenizer, end_id), BLOCKS).write.parquet(path)


SEGMENTS = ("shard int, ordinal long, doc_id long, local long, start long, length long, whole boolean, crc long, "
            "ids binary")


def _read_blocks(with_ids: bool):
    names = ["shard", "ordinal", "doc_id", "local", "start", "length", "whole", "crc", "ids"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]

    def run(batches):
        for b in batches:
            shards, numbers, data = (b.column(k) for k in range(3))
            for lo in range(0, len(data), codec.LANES):
                hi = min(lo + codec.LANES, len(data))
                parts = [codec.unseal(x) for x in data[lo:hi].to_pylist()]
                decoded = codec.decode_blocks([c for _, _, c in parts], [n for _, n, _ in parts])
                out = []
                for shard, number, (segments, _, _), ids in zip(
                        shards[lo:hi].to_pylist(), numbers[lo:hi].to_pylist(), parts, decoded):
                    at = 0
                    for ordinal, key, start, length, flags in segments.tolist():
                        raw = ids[at:at + length].tobytes()
                        out.append((shard, ordinal, None if flags & codec.NULL_ID else key,
                                    number * codec.BLOCK + at, start, length,
                                    start == 0 and bool(flags & codec.LAST), zlib.crc32(raw), raw if with_ids else None))
                        at += length
                cols = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def _joined_crc(parts: pd.Series) -> pd.Series:
    """Checksum of a document from those of its pieces: 12 bytes each, (length, crc), in order."""
    def one(raw):
        crc = 0
        for length, c in struct.iter_unpack(">qI", raw):
            crc = codec.crc_join(crc, c, 4 * length)
        return crc
    return parts.map(one)


def read_segments(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Pieces of documents as stored: one row for each document and block, checksums verified; ids as bytes of
    little-endian unsigned 32-bit numbers."""
    blocks = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "data")
    return blocks.mapInArrow(_read_blocks(with_ids), SEGMENTS)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a token file, decoded from its blocks.

    ``start`` counts the ids of all documents before. A document that spans blocks is put together from the
    checksums of its pieces, so that its ids need not meet.
    """
    pieces = read_segments(spark, path, with_ids=False).drop("ids")
    # most documents lie in one block; only the others are grouped
    part = F.concat(*[F.unhex(F.lpad(F.hex(F.col(c)), n, "0")) for c, n in (("length", 16), ("crc", 8))])
    rows = pieces.groupBy("shard", "ordinal", "doc_id").agg(
        F.min("local").alias("local"), F.sum("length").alias("n_tokens"), F.count("*").alias("n"),
        F.min("crc").alias("crc"), F.array_sort(F.collect_list(F.when(~F.col("whole"), F.struct(
            "start", part.alias("p"))))).alias("parts"))
    join = F.pandas_udf(_joined_crc, LongType())
    joined = F.reduce("parts", F.lit(bytearray()), lambda a, x: F.concat(a, x["p"]))
    rows = rows.withColumn("crc", F.when(F.col("n") == 1, F.col("crc")).otherwise(join(joined)))
    sizes = spark.read.schema(BLOCKS).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # one row for each shard
    base = sizes.select(F.col("shard").alias("_s"), (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("_base"))
    return rows.join(F.broadcast(base), F.col("shard") == F.col("_s")).select(
        "doc_id", (F.col("_base") + F.col("local")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
