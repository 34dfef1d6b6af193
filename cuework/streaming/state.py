"""Stateful processors: they take the rows of a key in order of time, once the watermark says that none will come before.

Until then rows wait in list state, so a late row within the watermark counts as if it had come in time, and a stream
gives what the same rows give as a batch. Timers hand them on; a bucket of keys without open rows keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: the key as JSON, time and end in microseconds, the rest as text
ROWS = pa.schema([("cw_k", pa.string()), ("cw_t", pa.int64()), ("cw_e", pa.int64()), ("cw_x", pa.string())])
VALUE = "rows binary"
STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def use_rocksdb(spark: SparkSession) -> None:
    """Processors keep their state in RocksDB, the only store that has lists and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def pack(rows: list[tuple]) -> tuple[bytes]:
    """Rows (key, time, end, text) as a state value: one Arrow stream."""
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ROWS) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def unpack(values) -> list[tuple]:
    return [r for v in values for r in zip(*pa.ipc.open_stream(bytes(v[0])).read_all().to_pydict().values())]


class InOrder(StatefulProcessor):
    """Gives :meth:`step` the finished rows of a bucket of keys, in order of key and time; rows that :meth:`wanted`
    refuses are left at once. A bucket's rows are one value in a list for each batch, so state costs calls by buckets, not
    by keys or rows."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", VALUE)
        self.kept = handle.getValueState("kept", VALUE)

    def _kept(self) -> list[tuple]:
        return unpack([self.kept.get()]) if self.kept.exists() else []

    def _keep(self, rows: list[tuple], until: int | None) -> None:
        """Keep these rows and look again just after ``until``."""
        if rows:
            self.kept.update(pack(rows))
            self.handle.registerTimer(until // 1000 + 1)
        else:
            self.kept.clear()

    def wanted(self, rows: list[tuple]) -> list[tuple]:
        return rows

    def step(self, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        new = self.wanted([r for pdf in rows for r in zip(*(pdf[n].tolist() for n in ROWS.names))])
        if new:
            self.waiting.appendValue(pack(new))
            self.handle.registerTimer(-(-min(r[1] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # rows at the watermark itself count as late from now on
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = unpack(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in held if r[1] <= watermark]
        if ready:
            self.waiting.clear()
            if len(ready) < len(held):
                rest = [r for r in held if r[1] > watermark]
                self.waiting.put([pack(rest)])
                self.handle.registerTimer(-(-min(r[1] for r in rest) // 1000))
        yield from self.step(sorted(ready), watermark)

    def close(self) -> None:
        pass


class Fills(InOrder):
    """Rows more than ``ttl`` microseconds after the last kept one of their key; its time is all that is kept, and only
    so long."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def wanted(self, rows):
        fills = {k: t for k, t, _, _ in self._kept()}
        return [r for r in rows if r[0] not in fills or r[1] - fills[r[0]] > self.ttl]

    def step(self, rows, watermark):
        fills, out = {k: t for k, t, _, _ in self._kept()}, []
        for r in rows:
            if r[0] not in fills or r[1] - fills[r[0]] > self.ttl:
                fills[r[0]] = r[1]
                out.append(r)
        live = [(k, t, t, "") for k, t in fills.items() if watermark <= t + self.ttl]
        self._keep(live, min((r[1] for r in live), default=0) + self.ttl)
        if out:
            yield pd.DataFrame({"cw_k": [r[0] for r in out], "cw_x": [r[3] for r in out]})


class Pauses(InOrder):
    """Groups of rows: a new one begins when the last row's end is more than ``gap`` microseconds ago, or when ``most``
    rows are together. The open group of each key is all that is kept; it is given out when the next one begins, or when
    the watermark has passed the gap."""

    def __init__(self, gap: int, most: int):
        self.gap, self.most = gap, most

    def step(self, rows, watermark):
        still, done, ends = [], [], []
        # rows of open groups lie before all others of their key
        for _, part in groupby(sorted(self._kept() + rows), itemgetter(0)):
            group = []
            for r in part:
                if group and (r[1] - group[-1][2] > self.gap or len(group) == self.most):
                    done.append(group)
                    group = []
                group.append(r)
            if watermark > group[-1][2] + self.gap:
                done.append(group)
            else:
                still += group
                ends.append(group[-1][2] + self.gap)
        self._keep(still, min(ends, default=0))
        if done:
            yield pd.DataFrame({"cw_k": [g[0][0] for g in done], "_start": [g[0][1] for g in done],
                                "_end": [max(r[2] for r in g) for g in done], "items": [len(g) for g in done],
                                "text": [" ".join(r[3] for r in g if r[3]) for g in done]})


class LatestState(StatefulProcessor):
    """The row that says how a job stands: its first terminal row, else its last row.

    A running job is kept for ever; a finished one until the watermark is ``keep`` microseconds past its end, by when
    rows of the same run are late and dropped before they get here.
    """

    def __init__(self, keep: int, key: list[str]):
        self.keep, self.key = keep, key

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "over boolean, t long, x string")

    def handleInputRows(self, key, rows, timerValues):
        was = tuple(self.now.get()) if self.now.exists() else None
        best = was
        for pdf in rows:
            for t, over, x in zip(pdf["cw_t"].tolist(), pdf["cw_over"].tolist(), pdf["cw_x"].tolist()):
                row = (bool(over), t, x)
                if best is None or (row[0] and not best[0]):
                    best = row
                elif row[0] == best[0] and (row[1:] < best[1:] if over else row[1:] > best[1:]):
                    best = row
        if best != was:
            self.now.update(best)
            if best[0]:
                self.handle.registerTimer((best[1] + self.keep) // 1000 + 1)
            yield pd.DataFrame({**{k: [v] for k, v in zip(self.key, key)}, "cw_x": [best[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.now.exists():
            over, t, _ = self.now.get()
            # an earlier end may have come in since the timer was set; then its own timer counts
            if over and timerValues.getCurrentWatermarkInMs() * 1000 > t + self.keep:
                self.now.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_rows(events: DataFrame, key: list[str], ts: str, row: Column, end: Column | None = None,
               **more: Column) -> DataFrame:
    """What the processors read (names must not begin with an underscore): the key, the watermarked time, ``cw_t`` and ``cw_e`` (microseconds) and ``cw_x``."""
    t = F.unix_micros(F.col(ts))
    return events.where(F.col(ts).isNotNull()).select(
        *key, ts, t.alias("cw_t"), (t if end is None else end).cast("long").alias("cw_e"), row.alias("cw_x"),
        *[c.alias(f"cw_{n}") for n, c in more.items()])


def dealt(rows: DataFrame, key: list[str], ts: str, buckets: int):
    """Rows of :func:`keyed_rows` grouped by a hash bucket of their key, which goes with them as JSON (``cw_k``)."""
    return rows.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("cw_b"), ts,
                       F.to_json(F.struct(*key), STAMP).alias("cw_k"), "cw_t", "cw_e", "cw_x").groupBy("cw_b")


def fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
