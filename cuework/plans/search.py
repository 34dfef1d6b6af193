"""Requests without candidates of their own, looked up in one shared catalogue.

Candidates of a request are the catalogue entries whose name (artist and title, or title) shares enough words with one of
its lookup queries. Names are joined over an index of their rarest words; scores then bound how many of the entries have
to be compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions import text as tx
from cuework.operators.joins import duration_match, levenshtein_similarity, match_score, ratio_similarity
from cuework.operators.ranking import top_n
from cuework.operators.tables import ttl_lookup
from cuework.plans.lyrics import rank_names, resolve_lyrics
from cuework.session import checkpoint

#: What a search needs to know of a catalogue entry; bodies are fetched for chosen ones only.
ENTRY = ["provider_ref", "artist", "title", "duration", "synced", "long_enough", "instrumental", "input_pos"]


def search_key(artist: str = "artist", title: str = "title", duration: str = "duration") -> Column:
    """Name under which the result of a search is kept."""
    low = [F.lower(tx.text_or_empty(c)) for c in (artist, title)]
    seconds = F.coalesce(F.col(duration), F.lit(0.0)).cast("long").cast("string")
    return F.concat(F.lit("search:"), low[0], F.lit("|"), low[1], F.lit("|"), seconds)


def _words(name: Column) -> Column:
    return F.array_distinct(F.split(name, " "))


def _prefixes(names: DataFrame, frequency: DataFrame, min_percent: int) -> DataFrame:
    """``names`` (``name``, ``words``) with a row for each of the rarest words, one of which two names that share
    ``min_percent`` of their words must have in common: ``word``, its ``position``, ``size``, ``name``, ``words``."""
    ranked = (names.select("name", F.explode("words").alias("w")).join(frequency, "w", "left")
              .groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("o")))
    size = F.size("o")
    # an integer ceiling: no pair may be lost to the last digit of a product
    take = size - F.floor((size * min_percent + 99) / 100).cast("int") + 1
    return ranked.select("name", F.col("o.w").alias("words"), size.alias("size"),
                         F.posexplode(F.slice(F.col("o.w"), F.lit(1), take)).alias("position", "word"))


def catalogue_index(catalogue: DataFrame, min_percent: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, word frequencies, entries by name) of a catalogue; each may be stored and used for many searches.

    The index has the rarest words of every different name, in how many names a word occurs being the order. Entries
    that no score can tell apart beyond the first few are left for :func:`search_catalogue` to cut.
    """
    title = tx.normalize_title("title")
    both = tx.normalize_title(F.concat_ws(" ", "artist", "title"))
    # read for the names, their words, the index and the entries: normalised once
    entries = checkpoint(catalogue.select(*ENTRY, title.alias("_t"), tx.normalize_title("artist").alias("_a"), both.alias("_b")))
    entries = entries.select(*ENTRY, "_t", "_a", F.explode(F.array_distinct(F.array("_b", "_t"))).alias("name")).where("name <> ''")
    names = entries.select("name").distinct().withColumn("words", _words(F.col("name")))
    frequency = names.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return _prefixes(names, frequency, min_percent), frequency, entries


def matching_names(queries: DataFrame, index: DataFrame, frequency: DataFrame, min_percent: int = 60) -> DataFrame:
    """``query``, ``name``: the names of the index sharing ``min_percent`` of all words with each query (column
    ``query``, normalised). Pairs are met over a rare word, and left at once where sizes or the places of that word rule
    out enough common words."""
    asked = queries.select(F.col("query").alias("name")).where("name <> ''").distinct().withColumn(
        "words", _words(F.col("name")))
    left = _prefixes(asked, frequency, min_percent).select(
        "word", *(F.col(c).alias(f"q_{c}") for c in ("name", "words", "size", "position")))
    both = F.col("q_size") + F.col("size")
    # of the words up to the shared one, at most so many are common; of those after it, at most the rest of the shorter
    reach = F.least("q_position", "position") + 1 + F.least(F.col("q_size") - F.col("q_position"),
                                                            F.col("size") - F.col("position")) - 1
    enough = lambda common: common * 100 >= (both - common) * min_percent
    common = F.size(F.array_intersect("q_words", "words"))
    return (left.join(index, "word")
            .where((F.col("q_size") * 100 >= F.col("size") * min_percent) & (F.col("size") * 100 >= F.col("q_size") * min_percent))
            .where(enough(reach)).where(enough(common))
            .select(F.col("q_name").alias("query"), "name").distinct())


def search_catalogue(requests: DataFrame, catalogue: DataFrame, key: Sequence[str], top: int = 5,
                     measure: str = "levenshtein", min_score: float = fixed.MIN_MATCH_SCORE, min_percent: int = 60,
                     index: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Best ``top`` catalogue entries of every request: ``key``, ``provider_ref``, ``score``, ``rank``.

    ``requests``: key (unique), artist, title, duration. ``catalogue``: the columns :data:`ENTRY`. Ties in the score go
    by ``input_pos``. Requests without an entry of at least ``min_score`` have no row.

    Lengths of names and all else but their letters bound a score from above. The ``top`` entries of the highest bound
    are scored first; the least of their scores then rules out every entry whose bound lies below it, so that a popular
    name costs a comparison of letters for few of its entries. The result is exact.
    """
    key = list(key)
    index, frequency, entries = index or catalogue_index(catalogue, min_percent)
    wanted = rank_names(requests.select(*key, "artist", "title", "duration"))
    asked = wanted.select(*key, F.col("duration").alias("want_duration"), tx.normalize_title("title").alias("_wt"),
                          tx.normalize_title("artist").alias("_wa"), (tx.text_or_empty("artist") != "").alias("_asked"))
    queries = tx.expand_queries(requests, key).where("kind = 'search'").select(
        *key, tx.normalize_title("query").alias("query")).where("query <> ''").distinct()
    # entries alike in all that counts: the first ``top`` of them are enough
    same = Window.partitionBy("name", "_t", "_a", "duration", "synced", "long_enough", "instrumental").orderBy("input_pos")
    entries = entries.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= top)
    names = matching_names(queries, index, frequency, min_percent)
    pairs = (queries.join(names, "query").select(*key, "name").distinct().join(entries, "name")
             .select(*key, *ENTRY, "_t", "_a").dropDuplicates([*key, "provider_ref", "input_pos"]).join(asked, key))
    most = _longest_similarity if measure == "levenshtein" else _longest_ratio
    exact = levenshtein_similarity if measure == "levenshtein" else ratio_similarity

    def score(similarity) -> Column:
        _, _, duration = duration_match(F.col("want_duration"), F.col("duration"))
        artist = F.when(F.col("_asked"), similarity(F.col("_a"), F.col("_wa"))).otherwise(0.5)
        return match_score(similarity(F.col("_t"), F.col("_wt")), artist, duration, F.coalesce("synced", F.lit(False)),
                           F.coalesce("long_enough", F.lit(False)), F.coalesce("instrumental", F.lit(False)))

    pairs = checkpoint(pairs.withColumn("_most", score(most)).where(F.col("_most") >= min_score - 1e-9))
    first = top_n(pairs, key, [F.col("_most").desc(), F.col("input_pos")], top).withColumn("score", score(exact))
    least = first.groupBy(*key).agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == top)
    # rounding must not rule out an equal score
    rest = pairs.join(least.select(*key, "_least"), key, "left").where(
        F.col("_least").isNull() | (F.col("_most") >= F.col("_least") - 1e-9))
    scored = rest.withColumn("score", score(exact)).where(F.col("score") >= min_score)
    return top_n(scored, key, [F.col("score").desc(), F.col("input_pos")], top).select(*key, "provider_ref", "score", "rank")


def _longest_similarity(a: Column, b: Column) -> Column:
    """Bound of the Levenshtein similarity: the difference of lengths has to be typed."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(
        1.0 - F.abs(F.length(a) - F.length(b)) / F.greatest(longest, F.lit(1)))


def _longest_ratio(a: Column, b: Column) -> Column:
    """Bound of the matching-blocks ratio: no more than the shorter string can match."""
    both = F.length(a) + F.length(b)
    return F.when((a == "") | (b == ""), 0.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / F.greatest(both, F.lit(1)))


Bodies = DataFrame | Callable[[DataFrame], DataFrame]


def resolve_requests(requests: DataFrame, catalogue: DataFrame, bodies: Bodies, cache: DataFrame, now: Column,
                     top: int = 5, measure: str = "levenshtein") -> dict[str, DataFrame]:
    """Lyrics of requests that come without a key and without candidates.

    ``requests``: artist, title, duration. ``catalogue``: :data:`ENTRY` and provider, album. ``bodies``: provider_ref,
    plain_text, lrc_text; or a function that gives them for the references of a table (``provider_ref``, each once), where
    they have to be fetched or made. ``cache``: search_key, refs (array of provider_ref, best first), fetched_at. Requests with the
    same key are one. A fresh cache entry gives the candidates; for others the catalogue is searched, and what is found
    is cached (nothing found is not). Candidates get their bodies, are scored in full, ranked, and the best one is
    stored. Returns what :func:`resolve_lyrics` gives, and ``cache``: the new state of the cache.
    """
    keyed = requests.withColumn("search_key", search_key())
    keyed = keyed.groupBy("search_key").agg(F.min(F.struct("artist", "title", "duration")).alias("_r")).select(
        "search_key", "_r.*")
    known = checkpoint(ttl_lookup(keyed, cache, ["search_key"], now))
    found = search_catalogue(known.where("NOT hit"), catalogue, ["search_key"], top, measure)
    fresh = checkpoint(found.groupBy("search_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "provider_ref"))).alias("_f")).select(
        "search_key", F.col("_f.provider_ref").alias("refs"), now.alias("fetched_at")))
    state = cache.join(fresh.select("search_key"), "search_key", "left_anti").select(
        "search_key", "refs", "fetched_at").unionByName(fresh)
    refs = known.where("hit").select("search_key", "refs").unionByName(fresh.select("search_key", "refs"))
    refs = refs.select("search_key", F.posexplode("refs").alias("input_pos", "provider_ref"))
    if not isinstance(bodies, DataFrame):
        bodies = bodies(refs.select("provider_ref").distinct())
    candidates = (refs.join(catalogue.drop("input_pos", "synced", "long_enough"), "provider_ref")
                  .join(bodies, "provider_ref"))
    return {**resolve_lyrics(keyed, candidates, ["search_key"], measure=measure, top=top), "cache": state}
