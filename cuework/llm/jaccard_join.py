"""N-gram Jaccard join by set relations, exact.

A document's set is its distinct word shingles. Documents with equal sets are one set from then on: what is found
for one holds for all. The search over distinct sets works with inverted lists of prefix shingles, rare ones first, and
skips by what is known of sets:

* Index-level skipping: where two similar sets share a shingle for the first time, what is left of either after that
  place must hold the overlap they need. Lists are cut into blocks by how much is left after the position, only equal
  and neighbouring blocks are joined, and sizes and positions bound each pair before it is compared.
* Answer-level skipping: in the first rounds every set meets two sets of all its lists, hubs that many sets of a group
  have in common, one of them near the middle of its group. Sets that turn out similar are in one component, and whatever else links them adds nothing; later
  rounds and the last join take only sets of lists that still belong to different components. For two sets that were
  compared with the same hub, the overlap with each other follows within bounds from their overlaps with the hub and
  what they lack of it; mostly that settles the pair without looking at the sets. A large group of near copies
  thus costs a number of comparisons that grows with its size, not its square.

Candidates are first bounded by bit maps of their sets: a bit of one that the other lacks stands for a member that the
other lacks. Those that may be similar are compared by their whole sets. Shingles are ordered from rare to frequent: by counts over all documents
in a table of ``1 << SKETCH`` buckets, and those found in very many prefixes so ordered (the ``MOST_HOT`` most frequent
ones, counted exactly) last, so that what many documents share makes no lists. Any order gives the same links; a
good one gives short lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.llm.components import components
from cuework.llm.lookup import rows_of
from cuework.llm.scratch import forget, stored
from cuework.llm.textkernel import LOWER, Words, distinct_sets, mixed, slices_of

SKETCH = 18
HOT_SETS, MOST_HOT = 32, 1 << 17  # prefixes that make a shingle hot; the most that are put last
STARS, HEADS = 3, 6  # rounds in which each set meets two hubs; sets of each list that may be hubs
MOST_BITS = 20  # of a bit map, as a power of two; otherwise it has 4 to 8 bits for each member
RECORDS = "doc_id long, n int, k1 long, k2 long, bits binary, bucket int, docs int"
ENTRIES = "h int, k1 long, n int, pos int"
ANSWERS = "a long, b long, an int, bn int, shared int"


def set_keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set (sums over its members), 128 bits together."""
    zero = np.zeros(1, np.uint64)
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        total = np.concatenate([zero, np.cumsum(mixed(values ^ np.uint64(salt)))])
        out.append(mixed(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out[0].view(np.int64), out[1].view(np.int64)


def _sets(texts: pa.Array, k: int):
    return distinct_sets(*Words(texts, LOWER).shingles(k))


def bit_map(values: np.ndarray) -> bytes:
    """Bits of a set, numbered by the first bits of its members' hashes: a smaller map is a larger one folded."""
    power = min(MOST_BITS, max(6, int(4 * len(values) - 1).bit_length()))
    bits = np.zeros(1 << power, bool)
    bits[(mixed(values) >> np.uint64(64 - power)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def most_shared(a: bytes, b: bytes, an: int, bn: int) -> int:
    """Bound of the members that two sets share, by their bit maps and sizes."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x = np.packbits(np.unpackbits(x).reshape(len(y) * 8, -1).any(axis=1))
    elif len(y) > len(x):
        y = np.packbits(np.unpackbits(y).reshape(len(x) * 8, -1).any(axis=1))
    return min(an - int(np.bitwise_count(x & ~y).sum()), bn - int(np.bitwise_count(y & ~x).sum()))


def _records(k: int):
    """A row for each document; after a task's documents, its shingle counts by bucket."""
    names = ["doc_id", "n", "k1", "k2", "bits", "bucket", "docs"]

    def run(batches):
        counts = np.zeros(1 << SKETCH, np.int64)
        for b in batches:
            for i, j in slices_of(b.column(1)):
                values, at = _sets(b.column(1)[i:j], k)
                counts += np.bincount((values >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
                k1, k2 = set_keys(values, at)
                none = pa.nulls(j - i, pa.int32())
                bits = pa.array([bit_map(values[x:y]) if y > x else None for x, y in zip(at.tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(np.diff(at).astype(np.int32)),
                                                  pa.array(k1), pa.array(k2), bits, none, none], names)
        full = np.flatnonzero(counts)
        for a in range(0, len(full), 1 << 14):
            f = full[a:a + (1 << 14)]
            none, short = pa.nulls(len(f), pa.int64()), pa.nulls(len(f), pa.int32())
            docs = np.minimum(counts[f], 2**31 - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([none, short, none, none, pa.nulls(len(f), pa.binary()), pa.array(f.astype(np.int32)), pa.array(docs)], names)
    return run


def least_overlap(a, b, percent: int):
    """Shared members that sets of sizes a and b need at least."""
    return -(-percent * (a + b) // (100 + percent))


def _entries(k: int, percent: int, rank: np.ndarray, hot: np.ndarray, only_shingles: bool = False):
    """Prefix shingles of each set: (shingle, set, size, position). A pair of similar sets shares one that is early in the
    smaller set. Shingles are named by half of their hash: lists that meet by chance give candidates, no links. ``rank``:
    order of the buckets; ``hot``: sorted names of shingles that come last of all."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for i, j in slices_of(b.column(0)):
                values, at = _sets(b.column(0)[i:j], k)
                k1, _ = set_keys(values, at)
                n = np.diff(at)
                fresh = np.zeros(len(n), bool)
                if len(seen) > 1 << 19:
                    seen.clear()
                for x, (key, size) in enumerate(zip(k1.tolist(), n.tolist())):
                    if size and key not in seen:
                        seen.add(key)
                        fresh[x] = True
                smallest = -(-percent * n // 100)
                reach = np.where(fresh, n - least_overlap(smallest, n, percent) + 1, 0)
                owner = np.repeat(np.arange(len(n)), n)
                live = fresh[owner]
                values, owner = values[live], owner[live]
                place = rank[(values >> np.uint64(64 - SKETCH)).astype(np.int64)].astype(np.int16)
                names = (mixed(values) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                if len(hot):
                    place[hot[np.minimum(np.searchsorted(hot, names), len(hot) - 1)] == names] += 256
                order = np.lexsort((values, place, owner))
                names, owner = names[order], owner[order]
                first = np.searchsorted(owner, np.arange(len(n)))
                pos = np.arange(len(names)) - first[owner]
                take = pos < reach[owner]
                names, owner, pos = names[take], owner[take], pos[take]
                if only_shingles:
                    yield pa.RecordBatch.from_arrays([pa.array(names)], ["h"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(k1[owner]), pa.array(n[owner].astype(np.int32)),
                     pa.array(pos.astype(np.int32))], ["h", "k1", "n", "pos"])
    return run


def _texts(k: int):
    """(set, doc_id, text) of every row that has a set."""
    def run(batches):
        for b in batches:
            for i, j in slices_of(b.column(1)):
                values, at = _sets(b.column(1)[i:j], k)
                k1, _ = set_keys(values, at)
                some = pa.array(np.flatnonzero(np.diff(at)))
                yield pa.RecordBatch.from_arrays([pa.array(k1).take(some), b.column(0)[i:j].take(some),
                                                  b.column(1)[i:j].take(some)], ["k1", "doc_id", "text"])
    return run


def _compare(k: int):
    """How many shingles two sets (a, b, text_a, text_b) share, rows of equal ``a`` together."""
    def run(batches):
        same, last = None, None
        for batch in batches:
            for i, j in slices_of(batch.column(3)):
                b = batch.slice(i, j - i)
                firsts = b.column(0).to_pylist()
                other, at = _sets(b.column(3), k)
                sizes, shared = [], []
                for x, a in enumerate(firsts):
                    if a != last:
                        last = a
                        same, _ = _sets(b.column(2)[x:x + 1], k)
                    o = other[at[x]:at[x + 1]]
                    sizes.append(len(same))
                    shared.append(int((same[np.minimum(np.searchsorted(same, o), len(same) - 1)] == o).sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(
                    np.diff(at).astype(np.int32)), pa.array(shared, pa.int32())], ["a", "b", "an", "bn", "shared"])
    return run


def _bounded(percent: int):
    """Pairs (a, b) of (a, b, an, bn, bits_a, bits_b) that may be similar by their bit maps."""
    def run(batches):
        for batch in batches:
            an, bn, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            most = np.array([most_shared(*z) for z in zip(x, y, an, bn)], np.int64)
            keep = 100 * most >= percent * (np.array(an, np.int64) + np.array(bn, np.int64) - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _compared(pairs: DataFrame, sets: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Answers to the pairs (a, b) of sets that may be similar, by their whole texts."""
    one = lambda c: sets.select(F.col("k1").alias(c), F.col("n").alias(f"{c}n"), F.col("bits").alias(f"bits_{c}"))
    near = pairs.select("a", "b").join(one("b"), "b").join(one("a"), "a").select("a", "b", "an", "bn", "bits_a", "bits_b")
    near = stored(near.mapInArrow(_bounded(percent), "a long, b long"), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("k1")).distinct().join(sets.select("k1", "rep"), "k1")
    wanted = stored(wanted, "wanted")
    texts = rows_of(rows, "doc_id", wanted.select("rep").distinct())
    # rows that are repeated, or further texts of an id, end here
    texts = texts.groupBy("doc_id", F.xxhash64("text").alias("t")).agg(F.first("text").alias("text")).select(
        "doc_id", "text").mapInArrow(_texts(k), "k1 long, doc_id long, text string")
    texts = texts.join(wanted, (texts["k1"] == wanted["k1"]) & (texts["doc_id"] == wanted["rep"])).select(texts["k1"], "text")
    texts = stored(texts.dropDuplicates(["k1"]), "texts")
    got = near.join(texts.select(F.col("k1").alias("b"), F.col("text").alias("text_b")), "b")
    got = got.join(texts.select(F.col("k1").alias("a"), F.col("text").alias("text_a")), "a")
    out = stored(got.select("a", "b", "text_a", "text_b").mapInArrow(_compare(k), ANSWERS), "answers")
    forget(near, wanted, texts)
    return out


def _similar(shared, an, bn, percent: int):
    return 100 * shared >= percent * (an + bn - shared)


def derive(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """``pairs`` (a, b, an, bn, ...) with ``low`` and ``high``, bounds of the overlap of a and b by their answers from the
    hub (column ``b`` of ``answers``) that a has most in common with; both null where b was not compared with it.

    If a and b have x and y members in common with the hub, at least x + y less its size are common to all three; inside
    the hub no more than min(x, y) can be common, and outside it no more than the smaller rest.
    """
    one = answers.groupBy("a").agg(F.max(F.struct("shared", F.col("b").alias("hub"), F.col("bn").alias("hn"))).alias("o")).select(
        "a", F.col("o.hub").alias("hub"), F.col("o.hn").alias("hn"), F.col("o.shared").alias("x"))
    two = answers.groupBy(F.col("a").alias("b"), F.col("b").alias("hub")).agg(F.max("shared").alias("y"))
    low = F.greatest(F.lit(0), F.col("x") + F.col("y") - F.col("hn"))
    high = F.least("x", "y") + F.least(F.col("an") - F.col("x"), F.col("bn") - F.col("y"))
    both = pairs.join(one, "a", "left").join(two, ["b", "hub"], "left")
    known = F.col("y").isNotNull()
    return both.select(*pairs.columns, F.when(known, low).alias("low"), F.when(known, high).alias("high"))


def _fits(an, ap, bn, bp, percent: int):
    """Whether sets of sizes ``an`` and ``bn`` that share a shingle at ``ap`` and ``bp`` can be similar: by size, and by
    what is left after those positions (true of the first shingle that a similar pair shares)."""
    sizes = 100 * F.least(an, bn) >= percent * F.greatest(an, bn)
    return sizes & (F.least(an - ap, bn - bp) >= F.ceil(percent * (an + bn) / F.lit(100 + percent)))


def similar_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two documents are linked if ``100 * shared >= percent * union`` of their sets of ``shingle``-word shingles (the
    whole sequence if there are fewer words; A-Z count as a-z); ``component_id`` is the least doc_id reachable.
    Texts that are null or have no word have an empty set, linked with nothing, and are their own component. Rows
    with a null doc_id are linked with nothing and have no component. Rows with equal doc_id are one document if their
    sets are equal, otherwise linked through their id. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = stored(rows.mapInArrow(_records(shingle), RECORDS), "sets")
    records = both.where("n IS NOT NULL").drop("bucket", "docs")
    counts = both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()
    rank = np.zeros(1 << SKETCH, np.uint8)  # steps of a quarter power of two
    rank[counts["bucket"].to_numpy(int)] = np.minimum(255, 4 * np.log2(1 + counts["docs"].to_numpy(float)))
    real = records.where("n > 0 AND doc_id IS NOT NULL")
    sets = stored(real.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "distinct")
    first = real.select("doc_id", "k1", "bits").join(
        sets.groupBy("k1").agg(F.min("rep").alias("rep"), F.min("n").alias("n")).withColumnRenamed("k1", "s1"),
        (F.col("doc_id") == F.col("rep")) & (F.col("k1") == F.col("s1"))).groupBy("k1", "rep", "n").agg(F.first("bits").alias("bits"))
    rows = rows.where("doc_id IS NOT NULL")
    shared = _lists(rows, shingle, percent, rank)
    maps = stored(first.join(shared.select("k1").distinct(), "k1", "left_semi"), "maps")
    answers, left, opened = [], shared.withColumn("comp", F.col("k1")), [shared]
    for turn in range(STARS):
        pairs = stored(_with_hubs(left, turn, percent, answers), "pairs")
        answers.append(_compared(pairs, maps, rows, shingle, percent))
        links = _all(answers).where(_similar(F.col("shared"), F.col("an"), F.col("bn"), percent)).select(
            F.col("a").alias("u"), F.col("b").alias("v"))
        known = components(links, rounds=1)  # enough to skip by: what it puts together is connected
        more = left.drop("comp").join(known, left["k1"] == known["id"], "left").withColumn(
            "comp", F.coalesce("component", "k1")).drop("id", "component").repartition("h")
        # all columns are named: rows and ends of a list are read off one shuffle
        every = F.struct("comp", "k1", "n", "pos")
        several = more.groupBy("h").agg(F.min(every).alias("lo"), F.max(every).alias("hi")).where("lo.comp <> hi.comp")
        left = stored(more.join(several.select("h"), "h"), "open")
        forget(pairs, *opened)
        opened = [left]
    pairs = stored(_rest(left, percent), "pairs")
    asked = stored(derive(pairs, _all(answers)).select("a", "b", "an", "bn", "low", "high"), "bounded")
    fits = lambda x: F.coalesce(_similar(F.col(x), F.col("an"), F.col("bn"), percent), F.lit(x == "high"))
    settled = asked.where(fits("low")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    open_ = asked.where(fits("high") & ~fits("low")).select("a", "b")
    open_ = stored(open_.join(_all(answers).select("a", "b"), ["a", "b"], "left_anti"), "left")
    answers.append(_compared(open_, maps, rows, shingle, percent))
    links = _all(answers).where(_similar(F.col("shared"), F.col("an"), F.col("bn"), percent)).select(
        F.col("a").alias("u"), F.col("b").alias("v")).unionByName(settled)
    reps = sets.groupBy("k1").agg(F.min("rep").alias("rep"))
    linked = links.join(reps.withColumnRenamed("rep", "ru"), F.col("u") == F.col("k1")).drop("k1").join(
        reps.withColumnRenamed("rep", "rv"), F.col("v") == F.col("k1")).select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    # rows of one doc_id with different sets are one document with several sets
    reps = records.where("n > 0 AND doc_id IS NOT NULL").join(sets, ["k1", "k2", "n"]).select("doc_id", "n", "rep")
    twice = reps.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    final = components(linked.unionByName(twice))
    forget(pairs, asked, open_, maps, *opened, *answers)
    found = final.withColumnRenamed("component", "component_id")
    return records.join(found, (records["doc_id"] == found["id"]) & (records["n"] > 0), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def _lists(rows: DataFrame, shingle: int, percent: int, rank: np.ndarray) -> DataFrame:
    """Prefix entries in lists of two sets or more, stored."""
    prefixes = rows.select("text").mapInArrow(_entries(shingle, percent, rank, np.zeros(0, np.int32), True), "h int")
    top = prefixes.groupBy("h").count().where(F.col("count") >= HOT_SETS).orderBy(
        F.desc("count"), "h").limit(MOST_HOT).toPandas()
    hot = np.sort(top["h"].to_numpy(np.int32))
    entries = rows.select("text").mapInArrow(_entries(shingle, percent, rank, hot), ENTRIES).repartition("h")
    # a set may come from several tasks; lists of one set end here. All columns are named, so that Spark sees the same
    # shuffle on both sides of the join and makes it once
    end = F.struct("k1", "n", "pos")
    lists = entries.groupBy("h").agg(F.min(end).alias("lo"), F.max(end).alias("hi")).where("lo.k1 <> hi.k1").select("h")
    return stored(entries.join(lists, "h").groupBy("h", "k1").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "lists")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _with_hubs(left: DataFrame, turn: int, percent: int, answers: list[DataFrame]) -> DataFrame:
    """Pairs (a, b): every set with two hubs of another component that it can be similar to, from the heads of its lists.

    Copies of a text have shingles of their own, which are rare and push what they share back: the set at the earliest
    position in a list is the one nearest to the middle of its group, and one hub is the foremost of these (ever more
    loosely from turn to turn, so that hubs change). The other comes first by a hash of this turn. All lists rank sets alike,
    so a group of many lists has few hubs."""
    left = left.select("h", "k1", "n", "pos", "comp").repartition("h")
    front = lambda c: F.floor(c / F.lit(1 + turn))
    some = [F.struct(F.xxhash64("k1", F.lit(turn * HEADS + i)).alias("r"), "k1", "n", "pos", "comp") for i in range(HEADS // 2)]
    first = F.struct(front(F.col("pos")).alias("front"), F.xxhash64("k1", F.lit(turn)).alias("r"), "k1", "n", "pos", "comp")
    heads = left.groupBy("h").agg(F.array(*[f(x) for x in some for f in (F.min, F.max)], F.min(first).dropFields("front")).alias("e"))
    fit = F.filter("e", lambda e: (e["comp"] != F.col("comp")) & _fits(F.col("n"), F.col("pos"), e["n"], e["pos"], percent))
    ranked = F.transform(fit, lambda e: F.struct(front(e["pos"]).alias("front"), F.xxhash64(e["k1"], F.lit(turn)).alias("r"), e["k1"].alias("b")))
    hashed = F.transform(fit, lambda e: F.struct(F.xxhash64(e["k1"], F.lit(turn)).alias("r"), e["k1"].alias("b")))
    rows = left.join(heads, "h").select("k1", F.array_min(ranked).alias("x"), F.array_max(hashed).alias("y")).where("x IS NOT NULL")
    two = rows.groupBy("k1").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    # a pair is asked once: the hub of two sets that are hubs to each other is the one with the greater key
    pairs = two.select(F.col("k1").alias("a"), F.explode(F.array_distinct(F.array("x.b", "y.b"))).alias("b"))
    pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("b").alias("b")).select(
        F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), "b")
    if not answers:
        return pairs
    done = _all(answers).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return pairs.join(done, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")


def _rest(left: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b, an, bn) of sets of a list that are in different components and may be similar, by blocks of what
    is left after the position: similar sets differ in it by no more than in size."""
    # a little wider than the ratio of sizes, so that rounding can't put a pair two blocks apart
    width = max(1e-6, float(-np.log(percent / 100)) * 1.000001)
    block = F.floor(F.log((F.col("n") - F.col("pos")).cast("double")) / F.lit(width))
    left = left.withColumn("block", block)
    early = F.col("pos") <= F.col("n") - F.ceil(percent * 2 * F.col("n") / F.lit(100 + percent))
    x = left.where(early).select("h", F.col("k1").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"), F.col("comp").alias("ac"),
                                   F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)).alias("block"))
    y = left.select("h", F.col("k1").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("comp").alias("bc"), "block")
    return x.join(y, ["h", "block"]).where("ac <> bc").where(
        (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))).where(
        _fits(F.col("an"), F.col("ap"), F.col("bn"), F.col("bp"), percent)).select("a", "b", "an", "bn").distinct()


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the first document (by doc_id) of each group; columns stay.

    Rows with a null doc_id stay. Of rows that share a doc_id one stays.
    """
    groups = similar_groups(docs, shingle, percent)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__stay")).distinct()
    kept = docs.join(stay, docs["doc_id"].cast("long") == stay["__stay"]).drop("__stay").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))
