"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.llm.scratch import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours of each node to the least one: those above the node, or those up to it."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # the node itself too is linked to the least of its neighbours
        out = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id, component``: the least id reachable from each id that has a link; ``links`` has columns ``u`` and ``v``.

    With ``rounds`` it stops after so many: equal components are then still connected, but one may have several names.

    Every round is written down, so nothing is held but one table of links. Ids without a link don't appear; links
    with a null end, loops and repeated links count for nothing.
    """
    edges = stored(links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while rounds is None or rounds > 0:
        edges = stored(_star(_star(edges, True), False), "links")
        if rounds is not None:
            rounds -= 1
            continue
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    named = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = edges.select("v").distinct().join(named, F.col("v") == F.col("id"), "left_anti")
    return named.unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))
