"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule: a piecewise linear rate over training time 0 to 1. Its integral, scaled to
the source's target, is the cumulative demand ``D(t)`` in words. A source's documents lie in a fixed
pseudo-random order, pass after pass, at cumulative sizes ``c``; a document is due when ``D(t)`` reaches ``c``,
so its training position is the inverse of ``D`` at ``c``. Range-sorting by position gives the training order.

Cumulative sizes need a running sum over a source, and one source may hold most of the table: each source is
cut into buckets of the order's hash, bucket totals are summed first, and only rows of one bucket are windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuework.llm.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Schedules by weight class: (time, rate) knots. Light sources come early, heavy ones late.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target): one row for each source.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes by weight; a target
    stops at ``most`` times its source's size and the excess is shared again by weight until none is above.
    The level at which sharing ends is found from aggregates; each round fixes at least one more source.
    """
    # one row for each source is all that meets here, and only (source, size)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    table = stored(sources.withColumn("weight", F.array(*map(F.lit, weights))[turn].cast("double"))
                   .withColumn("class", turn.cast("int")), "sources")
    top = F.col("source_size") * F.lit(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = None, -1
    while True:
        full = F.lit(False) if level is None else top <= F.col("weight") * level
        got = table.agg(F.count_if(full), F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight")))).first()
        if got[0] == fixed or not got[2]:
            break
        fixed, level = got[0], (total - (got[1] or 0.0)) / got[2]
    share = top if level is None else F.least(top, F.col("weight") * F.lit(level))
    return table.withColumn("target", share.cast("double"))


def _inverse(share: Column, knots) -> Column:
    """The time at which the scaled integral of a piecewise linear rate reaches ``share`` (0 to 1)."""
    pieces, area = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        grown = (r0 + r1) / 2 * (t1 - t0)
        pieces.append((t0, t1, r0, (r1 - r0) / (t1 - t0), area, grown))
        area += grown
    need = share * F.lit(area)
    out = F.lit(float(knots[-1][0]))
    for t0, t1, rate, slope, before, grown in reversed(pieces):
        rest = F.greatest(need - F.lit(before), F.lit(0.0))
        if abs(slope) < 1e-12:
            step = rest / F.lit(rate)
        else:  # the root of slope / 2 * x^2 + rate * x = rest
            inner = F.greatest(F.lit(rate * rate) + F.lit(2 * slope) * rest, F.lit(0.0))
            step = (F.sqrt(inner) - F.lit(rate)) / F.lit(slope)
        out = F.when(need <= before + grown, F.least(F.lit(t0) + step, F.lit(t1))).otherwise(out)
    return out


def _at(share: Column, schedules, classes: int) -> Column:
    """The time at which a source of weight class ``class`` has met the share of its target."""
    at = F.lit(None).cast("double")
    for k in range(classes):
        at = F.when(F.col("class") == k, _inverse(share, schedules[k % len(schedules)])).otherwise(at)
    return at


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, schedules=SCHEDULES,
        bucket_rows: int = 10_000) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, copies, position`` for every row of ``docs``.

    ``taken``: words the mix takes from the document, repeats counted; whole passes and, in the last pass, the
    part below the target, so that a source's ``taken`` adds up to its target rounded down. ``copies``: whole
    documents instead, one for each pass in which the middle of the document lies below the target.
    ``position``: the training time (0 to 1) of the first copy, null if nothing is taken.
    Null text or source, ties and repeated rows are allowed (null sources are one source, repeated rows are
    rows); an empty table gives no rows; other columns are ignored. The order in a source is a hash of doc_id.
    """
    return _plan(docs, weights, most, schedules, bucket_rows).drop("class", "begin")


def _plan(docs: DataFrame, weights, most: float, schedules, bucket_rows: int = 10_000) -> DataFrame:
    """``mix`` with ``class`` and ``begin``, the words of the source before the document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        word_count(F.col("text")).alias("size"))
    sized = stored(sized.withColumn("_h", F.xxhash64("doc_id", F.lit("mix"))), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(sums, weights, most)
    # buckets: the top bits of the hash, as many as the largest source needs for bucket_rows rows each
    rows = targets.agg(F.max("_rows")).first()[0] or 0
    bits = max(4, (rows // bucket_rows).bit_length())
    sized = sized.withColumn("_b", F.shiftright("_h", 63 - bits))
    table = sized.groupBy("source", "_b").agg(F.sum("size").alias("_sum")).withColumn(
        "_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")) - F.col("_sum"))
    per = table.join(targets.drop("_rows"), table["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    run = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_in", F.coalesce(F.sum("size").over(run), F.lit(0)))
    s = placed.alias("s").join(per.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))
                               & (F.col("s._b") == F.col("p._b")))
    begin = F.col("_before") + F.col("_in")
    goal = F.floor("target")
    size, whole = F.col("size"), F.floor(goal / F.col("source_size"))
    rest = goal - whole * F.col("source_size")
    taken = F.when(F.col("source_size") > 0, whole * size + F.greatest(F.lit(0), F.least(rest - begin, size)))
    copies = F.when(F.col("source_size") > 0, whole + F.when(2 * begin + size <= 2 * rest, 1).otherwise(0))
    share = F.when(F.col("target") > 0, begin / F.col("target"))
    at = _at(share, schedules, len(weights))
    return s.select("doc_id", "size", F.col("s.source").alias("source"), "source_size", "target",
                    F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
                    F.coalesce(copies, F.lit(0)).cast("int").alias("copies"),
                    F.when(taken > 0, at).alias("position"), "class", begin.alias("begin"))


def curriculum(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, schedules=SCHEDULES) -> DataFrame:
    """``docs`` as the mix takes them: whole copies, range-sorted by training position.

    The columns are those of ``docs``. Each copy of a document stands where its source's demand reaches it. Rows that are
    equal in doc_id and source are told apart by nothing and take the same number of copies each.
    """
    plan = _plan(docs, weights, most, schedules).where("copies > 0")
    plan = plan.groupBy("doc_id", "source").agg(
        F.max("copies").alias("_copies"), F.min("begin").alias("_begin"), F.first("source_size").alias("_size"),
        F.first("target").alias("_target"), F.first("class").alias("class"))
    # each copy is due when the demand reaches its own place, a pass of the source behind the copy before
    plan = plan.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    share = F.when(F.col("_target") > 0, (F.col("_begin") + F.col("_k") * F.col("_size")) / F.col("_target"))
    plan = plan.withColumn("_position", _at(F.coalesce(share, F.lit(0.0)), schedules, len(weights)))
    d, p = docs.alias("d"), plan.alias("p")
    return (d.join(p, F.col("d.doc_id").cast("long").eqNullSafe(F.col("p.doc_id"))
                   & F.col("d.source").cast("string").eqNullSafe(F.col("p.source")))
            .select("d.*", F.col("p._position").alias("__position"))
            .repartitionByRange("__position", "doc_id").sortWithinPartitions("__position", "doc_id").drop("__position"))
