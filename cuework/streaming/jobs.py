"""Structured Streaming jobs over the job log and timed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.functions import fixed_values as fixed
from cuework.operators.aggregates import dedupe_first
from cuework.operators.tables import upsert
from cuework.operators.windows import group_by_pause, thin_events
from cuework.sources.versions import merge_buckets
from cuework.streaming.state import STAMP, Fills, LatestState, Pauses, dealt, fields, keyed_rows, use_rocksdb

# fixed values: states after which a job no longer changes
TERMINAL = ["done", "error", "cancelled"]
BUCKETS = 1024  # of keys, in the state of a stream: fixed for the life of its checkpoint


def latest_state(events: DataFrame, key: Sequence[str] = ("job_id",), state: str = "state",
                 ts: str = "ts", info: Sequence[str] = (),
                 terminal: Sequence[str] = tuple(TERMINAL)) -> DataFrame:
    """State of every job: its first terminal row if there is one, else its last row."""
    row = F.struct(ts, state, *info)
    end = F.col(state).isin(list(terminal))
    agg = events.groupBy(*key).agg(F.min(F.when(end, row)).alias("_end"), F.max(row).alias("_last"))
    return agg.select(*key, F.coalesce("_end", "_last").alias("_r")).select(*key, "_r.*")


def job_state_stream(events: DataFrame, key: Sequence[str] = ("job_id",), state: str = "state",
                     ts: str = "ts", info: Sequence[str] = (),
                     terminal: Sequence[str] = tuple(TERMINAL), delay: str = "1 day",
                     keep_seconds: float = 7 * 86400.0) -> DataFrame:
    """:func:`latest_state` on a stream, in ``update`` mode: a row whenever the state of a job changes.

    A running job is remembered however long it pauses, a finished one until the watermark (``delay`` behind the latest
    row) is ``keep_seconds`` past its end: rows that come later than that do not open it again, they are late and
    dropped. Only a row whose own time is that long after the end starts the job anew.
    """
    use_rocksdb(events.sparkSession)
    key = list(key)
    columns = [*key, ts, state, *info]
    rows = keyed_rows(events.withWatermark(ts, delay), key, ts, F.to_json(F.struct(ts, state, *info), STAMP),
                      over=F.coalesce(F.col(state).isin(list(terminal)), F.lit(False)))
    out = rows.groupBy(*key).transformWithStateInPandas(
        LatestState(round(keep_seconds * 1e6), key), f"{fields(events, key)}, cw_x string", "Update", "EventTime")
    return out.select(*key, F.from_json("cw_x", fields(events, columns[len(key):]), STAMP).alias("_r")).select(*key, "_r.*")


def pause_sessions(events: DataFrame, key: Sequence[str], ts: str = "ts", gap_seconds: float = 0.9,
                   length: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Sessions separated by more than ``gap_seconds`` of silence: start, end of the last item, items.

    ``length`` names the item's own duration in seconds: the silence is counted from its end.
    """
    gap = F.lit(float(gap_seconds)) + (F.col(length) if length else F.lit(0.0))
    gap_text = F.concat(F.round(gap * 1000).cast("long").cast("string"), F.lit(" milliseconds"))
    item_end = F.timestamp_micros(F.unix_micros(ts) + (
        (F.col(length) if length else F.lit(0.0)) * 1e6).cast("long"))
    src = events.withWatermark(ts, delay) if events.isStreaming else events
    return (src.groupBy(*key, F.session_window(ts, gap_text).alias("w"))
            .agg(F.min(ts).alias("start"), F.max(item_end).alias("end"), F.count(F.lit(1)).alias("items"))
            .drop("w"))


def pause_groups(events: DataFrame, key: Sequence[str], ts: str = "ts", text: str = "text",
                 gap_seconds: float = 0.9, max_items: int = 8, delay: str = "10 minutes",
                 length: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Groups of at most ``max_items`` rows without a pause of more than ``gap_seconds`` between them.

    ``length`` names a row's own duration in seconds (NULL: none); a pause is counted from the end of the row before. A stream gives
    the groups that the same rows give as a batch: it takes rows in order of time as the watermark passes them, holds
    rows within ``delay`` and one open group a key, and gives a group out when the next one begins or the pause is over.
    State is held by ``buckets`` of keys, as a call for each key takes far longer than its rows.
    """
    key = list(key)
    end = F.unix_micros(ts) + (F.coalesce(F.round(F.col(length) * 1e6).cast("long"), F.lit(0)) if length else F.lit(0))
    if not events.isStreaming:
        rows = keyed_rows(events, key, ts, F.coalesce(F.col(text), F.lit("")), end)
        groups = group_by_pause(rows, key, "cw_t", "cw_e", ["cw_e", "cw_x"], gap_seconds * 1e6, max_items).groupBy(
            *key, "group_index").agg(
            F.min("cw_t").alias("_s"), F.max("cw_e").alias("_f"), F.count(F.lit(1)).cast("int").alias("items"),
            F.array_sort(F.collect_list(F.struct("in_group", F.nullif("cw_x", F.lit("")).alias("w")))).alias("_w"))
        return groups.select(*key, F.timestamp_micros("_s").alias("start"), F.timestamp_micros("_f").alias("end"), "items",
                             F.concat_ws(" ", "_w.w").alias("text"))
    use_rocksdb(events.sparkSession)
    rows = keyed_rows(events.withWatermark(ts, delay), key, ts, F.coalesce(F.col(text), F.lit("")), end)
    out = dealt(rows, key, ts, buckets).transformWithStateInPandas(
        Pauses(round(gap_seconds * 1e6), max_items),
        "cw_k string, _start long, _end long, items int, text string", "Append", "EventTime")
    return out.withColumn("_k", F.from_json("cw_k", fields(events, key), STAMP)).select("_k.*", F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end"),
                      "items", "text")


def ttl_dedupe(events: DataFrame, key: Sequence[str], ts: str = "ts",
               ttl_seconds: float = fixed.CACHE_TTL_SECONDS, delay: str = "1 hour",
               buckets: int = BUCKETS) -> DataFrame:
    """Fills of a cache key: its first row, then each row more than ``ttl_seconds`` after the last fill.

    A stream decides about a row when the watermark (``delay`` behind the latest row) passes it, keeps the time of the
    last fill of a key, and forgets it when the time to live is over. Of rows of a key at one moment one counts.
    State is held by ``buckets`` of keys, as in :func:`pause_groups`.
    """
    key = list(key)
    if not events.isStreaming:
        at = F.unix_micros(ts)
        first = dedupe_first(events, [*key, ts], [ts]).withColumn("_at", at.cast("double"))
        # at exactly the time to live the entry is still good
        fills = thin_events(first, key, "_at", ttl_seconds * 1e6 + 1).withColumn("_fill", F.lit(True))
        return first.join(fills, [*key, "_at"]).drop("_at", "_fill").select(*events.columns)
    use_rocksdb(events.sparkSession)
    rest = [c for c in events.columns if c not in key]
    rows = keyed_rows(events.withWatermark(ts, delay), key, ts, F.to_json(F.struct(*rest), STAMP))
    out = dealt(rows, key, ts, buckets).transformWithStateInPandas(
        Fills(round(ttl_seconds * 1e6)), "cw_k string, cw_x string", "Append", "EventTime")
    return out.select(F.from_json("cw_k", fields(events, key), STAMP).alias("_k"),
                      F.from_json("cw_x", fields(events, rest), STAMP).alias("_r")).select("_k.*", "_r.*").select(
        *events.columns)


def upsert_stream(stream: DataFrame, table: str, key: Sequence[str], replace: Sequence[str],
                  order: str, checkpoint: str, buckets: int = 64):
    """Keep a table current: every micro-batch upserts its latest row per key, unless the table already has a later one
    by ``order``.

    The table is cut into hash buckets of the key (:func:`cuework.sources.versions.merge_buckets`): a batch reads and
    rewrites only the buckets it touches, and its number is that of the commit, so a batch that is repeated after a
    failure is applied once. Start the returned writer with ``.start()``; :func:`read_buckets` reads the table.
    """
    key = list(key)

    def merge(base: DataFrame, changes: DataFrame) -> DataFrame:
        known = base.select(*key, F.col(order).alias("_known"))
        # a late row does not replace a newer one
        newer = changes.join(known, key, "left").filter(F.col("_known").isNull() | (F.col("_known") <= F.col(order)))
        return upsert(base, newer.select(*changes.columns), key, replace)

    def apply(batch: DataFrame, batch_id: int) -> None:
        names = [c for c in batch.columns if c not in key]
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("_r"))
        latest = latest.select(*key, "_r.*").select(*batch.columns).persist()
        try:
            merge_buckets(table, latest, key, merge, batch_id, buckets)
        finally:
            latest.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
