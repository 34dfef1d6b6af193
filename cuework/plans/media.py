"""Assignment of media to the scenes of every job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.functions import predicates as pr
from cuework.operators.joins import anti_join_refs

REF = ["job_id", "provider", "provider_ref"]


def assign_media(ranked: DataFrame, *blocked: DataFrame, held: DataFrame | None = None,
                 threshold: int = fixed.DUPLICATE_BITS, extras: int = 2) -> DataFrame:
    """Scenes in order take their best candidate that no earlier pick repeats.

    ``ranked``: job_id, scene_index, rank, provider, provider_ref, kind, phash, score. ``blocked``
    tables (exclusions, used, outgoing references) are removed by anti-joins first; ``held`` (job_id,
    phash) are hashes already in use. A scene's main pick has ``slot`` 0; after it the scene takes up to
    ``extras`` more, with slots 1, 2 and so on.

    The choice depends on every earlier pick of the job, so a job is walked in order; its rows
    arrive sorted and in batches and only the picks are remembered, never the candidates.
    """
    df = anti_join_refs(ranked.filter("kind = 'photo'"), *blocked, on=REF)
    cols = ["job_id", "scene_index", "rank", "provider", "provider_ref", "phash", "score"]
    rows = df.select(*cols)
    if held is not None:
        old = held.filter("phash is not null").select(
            "job_id", F.lit(-1).alias("scene_index"), F.lit(0).alias("rank"),
            F.lit("").alias("provider"), F.lit("").alias("provider_ref"), "phash",
            F.lit(0.0).alias("score"))
        rows = rows.unionByName(old)
    rows = rows.repartition("job_id").sortWithinPartitions("job_id", "scene_index", "rank",
                                                          "provider", "provider_ref")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, n_hashes = np.zeros(64, np.uint64), 0  # of all picks so far
        used: set[tuple] = set()
        scene, taken = None, 0
        for b in batches:
            keep, slots = [], []
            for n, (s, provider, ref, h) in enumerate(zip(
                    b["scene_index"], b["provider"], b["provider_ref"], b["phash"])):
                h = None if pd.isna(h) else np.uint64(int(h) & 0xFFFFFFFFFFFFFFFF)
                if n_hashes == len(hashes):
                    hashes = np.concatenate([hashes, np.zeros(len(hashes), np.uint64)])
                if s < 0:
                    hashes[n_hashes] = h
                    n_hashes += 1
                    continue
                if s != scene:
                    scene, taken = s, 0
                if taken > extras or (provider, ref) in used:
                    continue
                if h is not None and (np.bitwise_count(hashes[:n_hashes] ^ h) <= threshold).any():
                    continue
                keep.append(n)
                slots.append(taken)
                taken += 1
                used.add((provider, ref))
                if h is not None:
                    hashes[n_hashes] = h
                    n_hashes += 1
            yield b.iloc[keep].assign(slot=slots)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in cols)
    return rows.groupBy("job_id").applyInPandas(walk, f"{kinds}, slot int")


def fit_assets(assets: DataFrame, styles: DataFrame) -> DataFrame:
    """Add how each asset is fitted into the frame, by the style of its job."""
    return assets.join(styles.select("job_id", "style"), "job_id").withColumn(
        "adaptation", pr.adaptation("width", "height", "style"))


def coverage(scenes: DataFrame, picks: DataFrame) -> DataFrame:
    """Scenes of each job with and without media."""
    got = picks.filter("slot = 0").select("job_id", "scene_index", F.lit(1).alias("_hit"))
    return scenes.select("job_id", "scene_index").join(got, ["job_id", "scene_index"], "left").groupBy(
        "job_id").agg(F.count("_hit").alias("fetched_count"), F.count(F.lit(1)).alias("scene_count"))
