"""Quality rules: hashed n-gram log-likelihood ratios, trusted target against raw corpus.

Words, word pairs and word endings are hashed into a fixed number of buckets. Two multinomials are counted over them: one from
all documents (the raw corpus), one from trusted documents. A document's score is the mean over its n-grams of
``log(target / raw)``; every document is kept or not by comparing that score with one fixed threshold, after
base rules on its length and on repeated passages. Everything runs inside the JVM: texts move once, to meet the ids of
all trusted documents; sums per bucket are pre-aggregated in each task, and the table of ratios has as many numbers as
there are buckets, whatever the size of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
#: Positions of a window of words, and the base limits.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null or blank texts."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, f"[{SPACE}]+"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words covered by windows (given by hash, in order) that occur twice or more."""
    def covered(s):
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        spots = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
        return F.aggregate(spots, start, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(width), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _bound(ordered, covered)).otherwise(0)


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds the base measures, ``base_failed``, ``_w`` (the words) and ``_h`` (their hashes) to the rows of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_w", words_of(text))
    rows = rows.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                              lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))
    rows = rows.withColumn("_win", windows)
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))))
    rows = rows.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_win")).cast("long")}).drop("_win", "_lines")
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def grams(words: Column, hashes: Column, buckets: int) -> Column:
    """Buckets of all words, word pairs and word endings (two characters), given the words and their hashes."""
    mask = buckets - 1
    pairs = F.when(F.size(hashes) > 1, F.transform(
        F.sequence(F.lit(1), F.size(hashes) - 1),
        lambda i: F.get(hashes, i - 1).bitwiseXOR(F.shiftleft(F.get(hashes, i), 1)).bitwiseAND(mask).cast("int")))
    ends = F.transform(words, lambda w: F.xxhash64(F.substring(w, -2, 2), F.lit(1)).bitwiseAND(mask).cast("int"))
    return F.concat(F.transform(hashes, lambda h: h.bitwiseAND(mask).cast("int")),
                    F.coalesce(pairs, F.array().cast("array<int>")), ends)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("_trusted")).distinct()


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, smoothing: float = 10.0) -> list[float]:
    """``log(target / raw)`` by bucket: a list of ``buckets`` numbers, all 0 where nothing is trusted.

    ``smoothing`` is added to the count of each bucket and to the count that the raw model expects there, so that
    n-grams too rare to tell weigh little.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    # merged at every size: ids are as many as the corpus has good documents; words are made after it, and rows
    # without an id don't meet in one task
    ids = trusted_ids(labels).hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    named = rows.where("_id IS NOT NULL").join(ids, F.col("_id") == F.col("_trusted"), "left").select("text", "_trusted")
    rows = named.unionByName(rows.where("_id IS NULL").select("text", F.lit(None).cast("long").alias("_trusted")))
    rows = rows.withColumn("_w", words_of(F.col("text")))
    rows = rows.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    counts = rows.select(F.col("_trusted").isNotNull().alias("t"),
                         F.explode(grams(F.col("_w"), F.col("_h"), buckets)).alias("b"))
    counts = counts.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("t").alias("target")).collect()
    raw_all, target_all = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    out = [0.0] * buckets
    for r in counts if target_all else ():
        expected = r["raw"] * target_all / raw_all
        out[r["b"]] = round(math.log((r["target"] + smoothing) / (expected + smoothing)), 6)
    return out


def judge(docs: DataFrame, labels: DataFrame, threshold: float = -0.1, buckets: int = 1 << 16) -> DataFrame:
    """Rows of ``docs`` with the base measures, ``score`` and ``kept``.

    ``score``: mean log ratio of the document's n-grams, 0 for a text without words. ``kept``: the base rules hold
    and the score is at least ``threshold``. Null texts are empty (and so fail the base rules); repeated rows are
    judged each; without any trusted document every score is 0; an empty table gives no rows. Of other columns,
    those named like the measures are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    ratios = log_ratios(docs, labels, buckets)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    rows = base_rules(docs.drop(*new, "_w", "_h", "_win", "_lines", "_g"))
    rows = rows.withColumn("_g", grams(F.col("_w"), F.col("_h"), buckets))
    total = F.aggregate("_g", F.lit(0.0), lambda s, b: s + F.get(table, b))
    rows = rows.withColumn("score", F.when(F.size("_g") > 0, F.round(total / F.size("_g"), 9)).otherwise(0.0))
    return rows.drop("_w", "_h", "_g").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = -0.1) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    rows = judge(rows, labels, threshold)
    # the row number, always true here, keeps the optimizer from moving (and so repeating) all measures into the filter
    return rows.withColumn("_keep", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("_keep").select("_row.*")
