"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the shortest that is not yet in the dictionary). The phrases are
hashed and the set is kept as minimum-hash signature: the hash space is cut into ``BINS`` bins and each remembers
its least hash. The share of bins in which two signatures agree, of those that are not empty in both, estimates
the Jaccard similarity of the phrase sets: how well one text's dictionary compresses the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.llm.textkernel import span_hashes

BINS = 128
EMPTY = 0xFFFF


def phrases(text: str, known: set[str], edges: list[int], start: int, end: int) -> int:
    """Parses ``text[start:end]`` on, adding phrases to ``known`` and their ends to ``edges``.

    Gives the start of the phrase left unfinished at ``end``. The dictionary holds every beginning of its phrases,
    so a search may start at the length of the last phrase and go either way.
    """
    k = 4
    while start < end:
        if start + k > end:
            k = end - start
        if text[start:start + k] in known:
            k += 1
            while start + k <= end and text[start:start + k] in known:
                k += 1
            if start + k > end:
                return start
        else:
            while k > 1 and text[start:start + k - 1] not in known:
                k -= 1
        known.add(text[start:start + k])
        start += k
        edges.append(start)
    return start


def phrase_hashes(text: str, edges: np.ndarray) -> np.ndarray:
    """Hash of each phrase; ``edges``: 0 and the phrases' ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return span_hashes(points, edges[:-1], edges[1:])


def signature(hashes: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """The least hash of each bin, all ones where there is none."""
    least = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF)) if least is None else least.copy()
    np.minimum.at(least, (hashes >> np.uint64(57)).astype(np.int64), hashes)
    return least


def short(least: np.ndarray) -> np.ndarray:
    """16 bits of each bin's least hash."""
    out = (least % np.uint64(EMPTY)).astype(np.uint16)
    out[least == np.uint64(0xFFFFFFFFFFFFFFFF)] = EMPTY
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets; two empty ones are alike."""
    used = (a != EMPTY) | (b != EMPTY)
    n = int(used.sum())
    return 1.0 if n == 0 else float(((a == b) & used).sum()) / n


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprints(text: str, edited: str, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text`` and ``edited``, which begin with the same ``shared`` characters (parsed once)."""
    known: set[str] = set()
    edges = [0]
    at = phrases(text, known, edges, 0, shared)
    out = []
    for whole in (text, edited):
        ends = edges[:]
        rest = phrases(whole, known, ends, at, len(whole))
        # back to the dictionary at the end of the shared part: every phrase added since is new
        for a, b in zip(ends[len(edges) - 1:], ends[len(edges):]):
            known.discard(whole[a:b])
        if rest < len(whole):  # the last phrase is one that was seen before
            ends.append(len(whole))
        out.append(signature(phrase_hashes(whole, np.array(ends))))
    return out[0], out[1]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _walk(batches):
    """Rows come bucket by bucket, in the order of the ring; a guest is the first row of the next bucket."""
    names = RESULT.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before = None  # (bucket, doc_id, text): waits for its next document
    waiting = None  # a finished row but for near_next, and its signature
    out: list[tuple] = []
    served = None  # the bucket whose guest has been seen

    def batch():
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def done(doc_id, text, follower):
        """Emits what waits for this document's signature, then lets this one wait."""
        nonlocal waiting
        n = len(text)
        cut = n // 3
        edited = text[:n - cut] + follower[:cut] if cut else text
        sig, other = map(short, fingerprints(text, edited, n - cut))
        if waiting is not None:
            row, last = waiting
            out.append((*row, likeness(last, sig)))
        waiting = ((doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), hexed(sig), hexed(other),
                    likeness(sig, other)), sig)

    for b in batches:
        for bucket, guest, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            if bucket == served:
                continue  # further rows tied with the guest
            if before is not None:
                done(before[1], before[2], text)
            before = (bucket, doc_id, text)
            if guest:
                # only its signature is needed
                sig = short(fingerprints(text, text, len(text))[0])
                row, last = waiting
                out.append((*row, likeness(last, sig)))
                waiting, before, served = None, None, bucket
            if len(out) >= 2048:
                yield batch()
    if out:
        yield batch()


def ring(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, guest, doc_id, text) in runs: documents by descending doc_id, cut into buckets, each bucket
    followed by the first document of the next one (of the first bucket after the last).

    The borders are approximate quantiles of doc_id, ``buckets - 1`` numbers; the heads of the buckets are as many
    rows. Texts are shuffled once.
    """
    spark = docs.sparkSession
    n = buckets or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    borders = sorted(set(rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []))
    if borders:
        # descending: bucket 0 holds the largest ids
        where = F.array(*map(F.lit, borders))
        found = F.size(F.filter(where, lambda x: x < F.col("doc_id")))
        bucket = F.when(F.col("doc_id").isNull(), F.lit(len(borders))).otherwise(len(borders) - found).cast("int")
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()  # one row for each bucket
    order = sorted(h["bucket"] for h in heads)
    serves = {b: order[(k - 1) % len(order)] for k, b in enumerate(order)}
    if not heads:
        return rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    links = F.create_map(*[x for h in heads for x in (F.lit(h["bucket"]), F.struct(
        F.lit(h["head"]).cast("long").alias("head"), F.lit(serves[h["bucket"]]).alias("serves")))])
    link = links[F.col("bucket")]
    copies = F.when(F.col("doc_id").eqNullSafe(link["head"]), F.array(
        F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")),
        F.struct(link["serves"].alias("b"), F.lit(True).alias("g")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g"))))
    rows = rows.select(F.explode(copies).alias("c"), "doc_id", "text")
    rows = rows.select(F.col("c.b").alias("bucket"), F.col("c.g").alias("guest"), "doc_id", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses; see RESULT for the columns.

    The edited text replaces the last third of the code points (rounded down) by the beginning of the next document,
    by descending doc_id; null ids come last, and the first document follows the last. A null text is empty; two
    empty texts are alike (1.0). Rows with equal doc_id are ordered by text. Other columns are ignored. An empty table
    gives no rows; a single document follows itself.
    """
    return ring(docs, buckets).mapInArrow(_walk, RESULT)
