"""Catalogue search against brute force, request resolution, versioned and bucketed tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cuework.operators.tables import upsert
from cuework.plans import search
from cuework.sources import versions

ENTRY = ("provider_ref string, artist string, title string, duration double, synced boolean, long_enough boolean, "
         "instrumental boolean, input_pos long, provider string, album string")
REQUEST = "k string, artist string, title string, duration double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b))


def by_force(requests, entries, top=5, percent=60):
    """Plain names only: lower case words, nothing to clean."""
    out = []
    for k, artist, title, duration in requests:
        queries = [set(q.split()) for q in (f"{artist} {title}".strip(), title) if q]
        scored = []
        for e in entries:
            forms = [set(n.split()) for n in (f"{e[1]} {e[2]}", e[2])]
            if not any(100 * len(q & n) >= percent * len(q | n) for q in queries for n in forms):
                continue
            known = duration and e[3]
            s = (0.35 * similar(e[2], title) + 0.25 * (similar(e[1], artist) if artist else 0.5)
                 + 0.2 * (max(0.0, 1 - abs(e[3] - duration) / 15) if known else 0.5) + 0.15 * bool(e[4]) + 0.05 * (1 if e[5] else 0.2))
            s = s * 0.1 if e[6] else s
            if s >= 0.35:
                scored.append((-round(s, 9), e[7], e[0]))
        out += [(k, ref, n) for n, (_, _, ref) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def catalogue_rows(rng, n, words):
    name = lambda k: " ".join(rng.sample(words, k))
    titles = [name(rng.randint(1, 5)) for _ in range(n // 3)]
    return [(f"r{i}", rng.choice(["ann", "bo band", "the cats"]), rng.choice(titles), rng.choice([None, 0.0, 100.0, 104.0, 190.0]),
             rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.1, i, "p", "") for i in range(n)]


@pytest.mark.parametrize("measure", ["levenshtein"])
def test_search_matches_brute_force(spark, measure):
    rng = random.Random(11)
    words = ["red", "blue", "river", "night", "song", "of", "rain", "home", "light", "day"]
    entries = catalogue_rows(rng, 150, words)
    asked = [(f"q{i}", rng.choice(["", "ann", "bo band", "cats"]), " ".join(rng.sample(words, rng.randint(1, 5))), rng.choice([None, 101.0]))
             for i in range(40)]
    found = search.search_catalogue(spark.createDataFrame(asked, REQUEST), spark.createDataFrame(entries, ENTRY), ["k"], measure=measure)
    got = sorted((r.k, r.provider_ref, r["rank"]) for r in found.collect())
    want = by_force(asked, entries)
    assert got == want and len(want) > 60


def test_few_letters_are_compared(spark):
    """Of many entries of one popular name only those that may reach the best five are scored."""
    entries = [(f"r{i}", "ann", "red river", 100.0 + i % 7 * 10, i % 2 == 0, True, False, i, "p", "") for i in range(300)]
    asked = spark.createDataFrame([("q", "ann", "red river", 100.0)], REQUEST)
    cat = spark.createDataFrame(entries, ENTRY)
    got = search.search_catalogue(asked, cat, ["k"]).orderBy("rank").collect()
    assert [r.provider_ref for r in got] == [f"r{i}" for i in (0, 14, 28, 42, 56)]
    assert search.search_catalogue(asked.limit(0), cat, ["k"]).count() == 0
    assert search.search_catalogue(asked, cat.limit(0), ["k"]).count() == 0


def test_bounds_hold(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("ab ", k=rng.randint(0, 6))), "".join(rng.choices("ab ", k=rng.randint(0, 6)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert df.where(search._longest_similarity(a, b) < search.levenshtein_similarity(a, b) - 1e-12).count() == 0
    assert df.where(search._longest_ratio(a, b) < search.ratio_similarity(a, b) - 1e-12).count() == 0


def test_names_meet_over_rare_words(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(9)]
    names = sorted({" ".join(rng.sample(words[:rng.randint(2, 9)], rng.randint(1, 2))) for _ in range(30)}
                   | {" ".join(rng.sample(words, rng.randint(3, 9))) for _ in range(40)})
    cat = spark.createDataFrame([("x", "", n, None, False, False, False, i, "p", "") for i, n in enumerate(names)], ENTRY)
    for percent in (50, 60, 70, 100):
        index, frequency, _ = search.catalogue_index(cat, percent)
        got = {tuple(r) for r in search.matching_names(spark.createDataFrame([(n,) for n in names], "query string"), index,
                                                       frequency, percent).collect()}
        sets = {n: set(n.split()) for n in names}
        assert got == {(a, b) for a, b in itertools.product(names, names)
                       if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def test_resolution_uses_the_cache(spark):
    entries = [("r1", "ann", "red river", 100.0, False, True, False, 0, "p", ""),
               ("r2", "ann", "red river", 100.0, True, True, False, 1, "p", ""),
               ("r3", "bo", "old song", 100.0, False, True, False, 2, "p", "")]
    bodies = spark.createDataFrame([("r1", "one\ntwo", ""), ("r2", "", "[00:01.00]timed"), ("r3", "x " * 50, "")],
                                   "provider_ref string, plain_text string, lrc_text string")
    asked = spark.createDataFrame([("Ann", "Red River", 100.0), ("ann", "red river", 100.4), ("bo", "old song", 100.0),
                                   ("", "ann - red river (Official Video)", None), ("zed", "nothing here", 1.0)],
                                  "artist string, title string, duration double")
    cache = spark.createDataFrame([("search:ann|red river|100", ["r1"], 90), ("search:bo|old song|100", ["r1"], 1)],
                                  "search_key string, refs array<string>, s int").select(
        "search_key", "refs", F.timestamp_seconds(F.col("s") * 86400).alias("fetched_at"))
    out = search.resolve_requests(asked, spark.createDataFrame(entries, ENTRY), bodies, cache, F.timestamp_seconds(F.lit(91 * 86400)))
    chosen = {r.search_key: r.provider_ref for r in out["chosen"].collect()}
    # the cached entry counts while fresh, though the catalogue has a better one; the stale one is searched anew
    assert chosen == {"search:ann|red river|100": "r1", "search:bo|old song|100": "r3",
                      "search:|ann - red river (official video)|0": "r2"}
    assert {(r.search_key, r.text) for r in out["lines"].collect()} >= {
        ("search:ann|red river|100", "one"), ("search:|ann - red river (official video)|0", "timed")}
    state = {r.search_key: r.refs for r in out["cache"].collect()}
    assert state["search:bo|old song|100"][0] == "r3" and state["search:ann|red river|100"] == ["r1"] and len(state) == 3


def test_current_version(spark, tmp_path):
    table = str(tmp_path / "t")
    assert versions.state(spark, table) is None
    with pytest.raises(LookupError):
        versions.read_version(spark, table)
    df = spark.range(1000).withColumn("v", F.lit(1))
    assert versions.write_version(df, table, ["id"], 8) == 1
    assert versions.write_version(df.withColumn("v", F.lit(2)), table, ["id"], 8) == 2
    # a writer that dies before its commit changes nothing
    df.withColumn("v", F.lit(3)).write.parquet(f"{table}/data/died")
    assert [tuple(r) for r in versions.read_version(spark, table).groupBy("v").count().collect()] == [(2, 1000)]
    assert versions.read_version(spark, table, number=1).where("v = 1").count() == 1000
    every = versions.version_files(spark, table).count()
    few = versions.version_files(spark, table, 100, 120).count()
    assert every >= 8 and 1 <= few <= 2
    part = versions.read_version(spark, table, 100, 120)
    assert len(part.inputFiles()) == few and sorted(r.id for r in part.collect()) == list(range(100, 121))
    assert versions.read_version(spark, table, 5000, 6000).count() == 0
    with pytest.raises(versions.Conflict):
        versions.commit(spark, table, 2, {})
    versions.write_version(df.limit(0), table, ["id"])
    assert versions.read_version(spark, table).count() == 0
    assert versions.drop_versions(spark, table, 1) >= 3 and versions.commits(spark, table) == [3]
    assert versions.read_version(spark, table).count() == 0


def test_bucketed_merge(spark, tmp_path):
    table = str(tmp_path / "t")
    schema = "id long, v string, created_at long, updated_at long"
    make = lambda rows: spark.createDataFrame(rows, schema)
    merge = lambda base, changes: upsert(base, changes, ["id"], ["v"])
    everything = versions.merge_buckets(table, make([(i, "a", 1, 1) for i in range(50)]), ["id"], merge, 0, 16)
    assert len(everything) > 10
    before = versions.state(spark, table)["buckets"]
    touched = versions.merge_buckets(table, make([(3, "b", 2, 2), (999, "new", 2, 2)]), ["id"], merge, 1, 16)
    after = versions.state(spark, table)["buckets"]
    assert 1 <= len(touched) <= 2 and all(after[b] == p for b, p in before.items() if int(b) not in touched)
    assert all(after[str(b)] != before.get(str(b)) for b in touched)
    # the same commit again does nothing, a dead try of the next one is overwritten
    assert versions.merge_buckets(table, make([(3, "twice", 9, 9)]), ["id"], merge, 1) == []
    make([(0, "dead", 0, 0)]).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{table}/data/commit=2")
    versions.merge_buckets(table, make([(4, "c", 3, 3)]), ["id"], merge, 2)
    got = {r.id: (r.v, r.created_at, r.updated_at) for r in versions.read_buckets(spark, table, schema).collect()}
    assert got == {**{i: ("a", 1, 1) for i in range(50)}, 3: ("b", 1, 2), 999: ("new", 2, 2), 4: ("c", 1, 3)}
    assert versions.merge_buckets(table, make([]), ["id"], merge, 3) == [] and versions.read_buckets(spark, table, schema).count() == 51


def test_bodies_are_made_for_chosen_entries(spark):
    entries = [(f"r{i}", "ann", "red river" if i < 4 else f"other song {i}", 100.0, False, True, False, i, "p", "") for i in range(12)]
    asked = spark.createDataFrame([("Ann", "Red River", 100.0)], "artist string, title string, duration double")
    cache = spark.createDataFrame([], "search_key string, refs array<string>, fetched_at timestamp")
    texts = spark.createDataFrame([(f"r{i}", f"line {i}", "") for i in range(12)], "provider_ref string, plain_text string, lrc_text string")
    wanted = []

    def bodies(refs):
        wanted.extend(r.provider_ref for r in refs.collect())
        return texts.join(refs, "provider_ref", "left_semi")
    now = F.timestamp_seconds(F.lit(91 * 86400))
    resolve = lambda b: search.resolve_requests(asked, spark.createDataFrame(entries, ENTRY), b, cache, now, top=3)
    got = [[(r.search_key, r.line_index, r.text) for r in resolve(b)["lines"].collect()] for b in (bodies, texts)]
    assert got[0] == got[1] == [("search:ann|red river|100", 0, "line 0")] and sorted(wanted) == ["r0", "r1", "r2"]


def test_documents_are_measured_once(spark):
    from cuework.queries import catalogue
    from cuework.queries.registry import table
    t = lambda n: table(spark, "/root/testdata/sf0.001", n)
    c = catalogue.catalogue(t)
    # nothing is made of a text above the join that deals documents out to entries
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("format_string") > plan.index("Join Inner")
    refs = c.select("provider_ref")
    long = catalogue.bodies(t, refs).select("provider_ref", (F.length(F.regexp_replace(F.concat("plain_text", "lrc_text"),
                                                                                   r"(?U)^\s+|\s+$", "")) >= 80).alias("is_long"))
    assert c.join(long, "provider_ref").filter("long_enough <> is_long").count() == 0 and long.count() == refs.count()
