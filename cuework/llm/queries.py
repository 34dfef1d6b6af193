"""The queries of this subpackage, with their SQL twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuework.llm import (chat, compact_windows, hard_negatives, jaccard_join, lz_fingerprint, mixing, packing,
                         pu_classifier, quality_rules, secrets, token_counts, token_files, whitening)
from cuework.llm.scratch import scratch_path, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


@query
def op1_pack_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op2_lz_fingerprints(spark, sf_dir):
    return lz_fingerprint.fingerprint(table(spark, sf_dir, "documents"))


@query
def op3_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "position")


@query
def op4_log_ratio_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


@query
def op5_jaccard_groups(spark, sf_dir):
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), shingle=4, percent=85)


@query
def op6_secret_spans(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


@query
def op7_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_files.read_documents(spark, path)


@query
def op8_positive_unlabelled(spark, sf_dir):
    return pu_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_prefix_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nasty = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame(
        [(-7, 0, "user", nasty), (-7, 1, "assistant", nasty)], rows.schema))
    back = chat.read_back(stored(chat.expand(rows), "examples"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


@query
def op10_repeated_passages(spark, sf_dir):
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_lanczos_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_slot_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query
def op13_count_tokens(spark, sf_dir):
    from public_tokenizers import path

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


SQL["op9_prefix_targets"] = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(t)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  length('### ' || role || ':' || chr(10) || replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '\### ')
    || '</turn>' || chr(10)) AS f FROM c),
p AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY i) AS upto,
  max(CASE WHEN role = 'assistant' THEN i ELSE 0 END) OVER (PARTITION BY conv_id) AS final FROM r)
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR (i = n AND final < n) THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""


SQL["op12_slot_negatives"] = """WITH b AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
  AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM b a JOIN b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
