"""Requests against one shared catalogue, and the versioned tables their results are kept in."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.functions import text as tx
from cuework.plans import search
from cuework.queries.flows import scratch
from cuework.queries.registry import query, r
from cuework.queries.texts import NOISY_SQL, noisy, sql_title
from cuework.sources import versions
from cuework.sources.sinks import replace_keys

NOW = "timestamp '2024-06-30 00:00:00'"


def requests(t) -> DataFrame:
    """Every brand asks for every name it has: as artist and title, as one noisy title, as "Artist - Title"."""
    k = F.length(F.concat("p_brand", "p_name")) % 3
    return t("part").select("p_brand", "p_name").distinct().select(
        F.when(k == 0, "").otherwise(F.col("p_brand")).alias("artist"),
        F.when(k == 0, F.concat("p_brand", F.lit(" - "), "p_name")).when(
            k == 1, F.concat("p_name", F.lit(" (Official Video)"))).otherwise(F.col("p_name")).alias("title"),
        (F.length("p_name") * 2.5).alias("duration"))


def catalogue(t) -> DataFrame:
    k = F.col("p_partkey")
    # measured once a document, not once a part
    docs = documents(t)
    n = docs.select("doc_id", F.length(tx.strip("plain")).alias("plain"), F.length(tx.strip("timed")).alias("timed"))
    n = t("part").select(k, (k % F.lit(max(1, t("documents").count()))).alias("doc_id")).join(n, "doc_id").select(
        k.cast("string").alias("provider_ref"), F.when(k % 2 == 0, F.col("timed")).otherwise(F.col("plain")).alias("n"))
    return t("part").select(
        k.cast("string").alias("provider_ref"), F.lit("catalogue").alias("provider"), F.col("p_brand").alias("artist"),
        noisy().alias("title"), F.lit("").alias("album"), F.col("p_size").cast("double").alias("duration"),
        (k % 2 == 0).alias("synced"), (k % 11 == 0).alias("instrumental"), k.alias("input_pos")).join(
        n, "provider_ref", "left").withColumn("long_enough", F.coalesce(F.col("n") >= 80, F.lit(False))).drop("n")


def documents(t) -> DataFrame:
    """Documents as bodies: ``plain``, and ``timed`` with a time every two seconds."""
    text = F.col("text")
    for old, new in zip("[]<>", "()()"):
        text = F.replace(text, F.lit(old), F.lit(new))
    lines = F.filter(F.transform(tx.lines_of("plain"), tx.strip), lambda x: x != "")
    timed = F.array_join(F.transform(lines, lambda x, i: F.concat(
        F.format_string("[%02d:%02d.00]", F.floor(i / 30), i % 30 * 2), x)), "\n")
    return t("documents").select("doc_id", F.coalesce(text, F.lit("")).alias("plain")).withColumn("timed", timed)


def bodies(t, refs: DataFrame) -> DataFrame:
    """Bodies of the entries ``refs`` (``provider_ref``): plain for odd ones, timed for even ones."""
    k = F.col("p_partkey")
    docs = F.lit(max(1, t("documents").count()))
    asked = t("part").select(k.cast("string").alias("provider_ref"), k, (k % docs).alias("doc_id")).join(
        refs, "provider_ref", "left_semi")
    both = asked.join(documents(t), "doc_id")
    even = k % 2 == 0
    return both.select("provider_ref", F.when(even, "").otherwise(F.col("plain")).alias("plain_text"),
                       F.when(even, F.col("timed")).otherwise("").alias("lrc_text"))


def cached(t) -> DataFrame:
    """Some searches were done before: two entries of the brand each, a third of them too long ago."""
    asked = requests(t).withColumn("search_key", search.search_key())
    rows = t("part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("low")).join(
        t("part").groupBy("p_brand").agg(F.max("p_partkey").alias("high")), "p_brand")
    k = F.length(F.concat("p_brand", "p_name")) % 3
    brand = F.when(F.col("artist") == "", F.split("title", " - ")[0]).otherwise(F.col("artist"))
    name = F.regexp_replace(F.when(F.col("artist") == "", F.split("title", " - ")[1]).otherwise(F.col("title")),
                            r" \(Official Video\)$", "")
    asked = asked.select("search_key", brand.alias("p_brand"), name.alias("p_name"))
    return rows.where(F.col("low") % 4 == 1).join(asked, ["p_brand", "p_name"]).select(
        "search_key", F.array(F.col("low").cast("string"), F.col("high").cast("string")).alias("refs"),
        F.expr(f"{NOW} - make_interval(0, 0, 0, CASE WHEN low % 3 = 0 THEN 30 ELSE 2 END)").cast("timestamp").alias("fetched_at"))


REQUESTS_SQL = """rq AS (SELECT DISTINCT p_brand, p_name, length(p_brand || p_name) % 3 AS k FROM part),
rk AS (SELECT *, length(p_name) * 2.5 AS want_duration, 'search:' || CASE k WHEN 0 THEN '' ELSE lower(p_brand) END || '|' ||
  lower(CASE k WHEN 0 THEN p_brand || ' - ' || p_name WHEN 1 THEN p_name || ' (Official Video)' ELSE p_name END) || '|' ||
  CAST(trunc(length(p_name) * 2.5) AS BIGINT) AS search_key FROM rq)"""
LIST_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
BODY_SQL = f"""bd AS (SELECT p_partkey, {LIST_SQL} AS ls, CASE WHEN p_partkey % 2 = 1 THEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ELSE
    length(array_to_string(list_transform({LIST_SQL}, lambda x: '[00:00.00]' || x), chr(10))) END AS n
  FROM part JOIN (SELECT doc_id, translate(text, '[]<>', '()()') AS text FROM documents) d ON p_partkey % (SELECT count(*) FROM documents) = doc_id)"""
SCORE_SQL = f"""ct AS (SELECT p_partkey, p_brand, {sql_title('title')} AS nt, {sql_title('p_brand')} AS na, {sql_title("p_brand || ' ' || title")} AS nb,
  p_size, coalesce(n >= 80, false) AS long_enough FROM (SELECT *, {NOISY_SQL} AS title FROM part) LEFT JOIN bd USING (p_partkey)),
wn AS (SELECT *, {sql_title('p_name')} AS wt, {sql_title('p_brand')} AS wa, {sql_title("p_brand || ' ' || p_name")} AS wb FROM rk),
sc AS (SELECT search_key, p_partkey, nt, na, nb, wt, wa, wb, (0.35 * (1 - levenshtein(nt, wt) / greatest(length(nt), length(wt)))
  + 0.25 * (1 - levenshtein(na, wa) / greatest(length(na), length(wa))) + 0.2 * greatest(0, 1 - abs(p_size - want_duration) / 15)
  + 0.15 * (p_partkey % 2 = 0)::INT + 0.05 * CASE WHEN long_enough THEN 1 ELSE 0.2 END) * CASE WHEN p_partkey % 11 = 0 THEN 0.1 ELSE 1 END AS score
  FROM wn, ct)"""
# names that share 60 % of their words, by comparing all of them
FOUND_SQL = f"""qn AS (SELECT DISTINCT q, string_split(q, ' ') AS ws FROM (SELECT unnest([wt, wb]) AS q FROM wn)),
cn AS (SELECT DISTINCT c, string_split(c, ' ') AS ws FROM (SELECT unnest([nt, nb]) AS c FROM ct)),
nm AS (SELECT q, c FROM (SELECT q, c, len(list_intersect(qn.ws, cn.ws)) AS i, len(list_distinct(qn.ws)) + len(list_distinct(cn.ws)) AS n FROM qn, cn)
  WHERE i * 100 >= (n - i) * 60),
fd AS (SELECT DISTINCT search_key, p_partkey, score FROM sc JOIN nm ON nm.q IN (wt, wb) AND nm.c IN (nt, nb) WHERE score >= 0.35),
tp AS (SELECT *, row_number() OVER (PARTITION BY search_key ORDER BY round(score, 9) DESC, p_partkey) AS rank FROM fd QUALIFY rank <= 5)"""


@query("j3_search_catalogue", f"""WITH {REQUESTS_SQL}, {BODY_SQL}, {SCORE_SQL}, {FOUND_SQL}
SELECT search_key, p_partkey::VARCHAR AS provider_ref, round(score, 5)::DOUBLE AS score, CAST(rank AS INTEGER) AS rank FROM tp""")
def j3_search(t):
    asked = requests(t).withColumn("search_key", search.search_key())
    found = search.search_catalogue(asked, catalogue(t), ["search_key"])
    return found.select("search_key", "provider_ref", r("score", 5).alias("score"), "rank")


@query("d2_resolve_requests", f"""WITH {REQUESTS_SQL}, {BODY_SQL}, {SCORE_SQL}, {FOUND_SQL},
ca AS (SELECT search_key, low, high FROM (SELECT p_brand, p_name, min(p_partkey) AS low FROM part GROUP BY ALL) JOIN
  (SELECT p_brand, max(p_partkey) AS high FROM part GROUP BY ALL) USING (p_brand) JOIN rk USING (p_brand, p_name)
  WHERE low % 4 = 1 AND low % 3 <> 0),
cd AS (SELECT search_key, p_partkey, rank FROM tp WHERE search_key NOT IN (SELECT search_key FROM ca)
  UNION ALL SELECT search_key, low, 0 FROM ca UNION ALL SELECT search_key, high, 1 FROM ca WHERE high <> low),
be AS (SELECT search_key, p_partkey, score FROM cd JOIN sc USING (search_key, p_partkey) JOIN bd USING (p_partkey) WHERE score >= 0.35
  QUALIFY row_number() OVER (PARTITION BY search_key ORDER BY round(score, 9) DESC, rank) = 1),
l0 AS (SELECT search_key, p_partkey, unnest(ls) AS text, unnest(range(len(ls))) AS i, len(ls) AS n, p_partkey % 2 = 0 AS timed FROM be JOIN bd USING (p_partkey)),
l1 AS (SELECT search_key, i, CASE WHEN timed THEN regexp_replace(text, '\\s{{2,}}', ' ', 'g') ELSE text END AS text,
  CASE WHEN timed THEN i * 2.0 END AS s, CASE WHEN timed THEN CASE WHEN i < n - 1 THEN i * 2.0 + 2
    ELSE greatest(i * 2.0 + 0.5, least(want_duration, i * 2.0 + 8)) END END AS e FROM l0 JOIN rk USING (search_key))
SELECT search_key, CAST(i AS INTEGER) AS line_index, md5(text) AS text, s::DOUBLE AS start_s, e::DOUBLE AS end_s FROM l1
UNION ALL SELECT search_key, 0, md5('kept'), NULL, NULL FROM rk WHERE search_key NOT IN (SELECT search_key FROM l1)
UNION ALL SELECT 'search:' || lower(n_name), 0, md5('kept'), NULL, NULL FROM nation""")
def d2_requests(t):
    """Search, cache, rank, pick, parse and store: the lines end up in the current version of a table that had older
    lines of some of the requests, and lines of others."""
    spark = t("part").sparkSession
    table = f"{scratch(spark)}/lines"
    out = search.resolve_requests(requests(t), catalogue(t), partial(bodies, t), cached(t), F.expr(NOW).cast("timestamp"))
    lines = out["lines"]
    old = requests(t).select(search.search_key().alias("search_key")).unionByName(
        t("nation").select(F.concat(F.lit("search:"), F.lower("n_name")).alias("search_key"))).select(
        "search_key", F.lit(0).alias("line_index"), F.lit("kept").alias("text"), F.lit(None).cast("double").alias("start"),
        F.lit(None).cast("double").alias("end"))
    versions.write_version(old, table, ["search_key"])
    versions.write_version(replace_keys(versions.read_version(spark, table), lines.select(*old.columns), ["search_key"]),
                           table, ["search_key"])
    return versions.read_version(spark, table).select(
        "search_key", "line_index", F.md5("text").alias("text"), F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query("snk1_current_version", """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity * 2 AS l_quantity FROM lineitem
WHERE l_orderkey BETWEEN 1000 AND 30000""")
def snk1_version(t):
    """Two versions and a write that fails before its commit; a range of keys is read from the files that may hold it."""
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    spark = li.sparkSession
    table = f"{scratch(spark)}/lineitem"
    versions.write_version(li, table, ["l_orderkey"], 16)
    versions.write_version(li.withColumn("l_quantity", F.col("l_quantity") * 2), table, ["l_orderkey"], 16)
    li.withColumn("l_quantity", F.lit(-1.0)).write.parquet(f"{table}/data/died")
    return versions.read_version(spark, table, 1000, 30000)
