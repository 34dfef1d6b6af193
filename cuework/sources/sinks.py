"""Writers. A table is a folder of versions; a new state never overwrites what it was read from."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.sources import versions


def write_version(df: DataFrame, table: str, cluster_by: Sequence[str] = (), version: str = "") -> str:
    """Write a new current version of a table, cut into ranges of ``cluster_by``; returns its folder.

    :func:`cuework.sources.versions.read_version` reads the current one, or only the files that hold some keys.
    """
    name = version or uuid.uuid4().hex
    versions.write_version(df, table, cluster_by, name=name)
    return f"{table}/data/{name}"


def replace_keys(current: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the new keys replace every old row of those keys."""
    return current.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def plan_documents(scenes: DataFrame, header: DataFrame, key: Sequence[str],
                   order: str = "scene_index", page_rows: int = 10_000) -> DataFrame:
    """One JSON document per key: the header fields and the ordered scenes.

    Scenes beyond ``page_rows`` of one key continue in further documents with a higher ``page``.
    """
    from cuework.operators.joins import nest_children
    docs = nest_children(header, scenes, key, [order], "scenes", page_rows)
    fields = [c for c in docs.columns if c not in key and c != "page"]
    return docs.select(*key, "page", F.to_json(F.struct(*fields)).alias("document"))


def write_plan_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("error").json(path)


def attribution(assets: DataFrame, key: Sequence[str] = ("job_id",)) -> DataFrame:
    return assets.select(*key, "scene_index", "provider", "creator", "license", "page_url")


def append_history(history: DataFrame, parents: DataFrame, new: DataFrame, key: str,
                   created: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(history with the new rows, parents with a bare row for every key that lacked one).

    Known parents only get a later ``updated_at``.
    """
    seen = new.groupBy(key).agg(F.max(created).alias("_at"), F.min(created).alias("_first"))
    both = parents.withColumn("_old", F.lit(True)).join(seen, key, "full")
    cols = []
    for c in parents.columns:
        if c == "created_at":
            cols.append(F.coalesce(c, "_first").alias(c))
        elif c == "updated_at":
            cols.append(F.greatest(c, "_at").alias(c))
        else:
            cols.append(F.col(c))
    return history.unionByName(new, allowMissingColumns=True), both.select(*cols)
