"""Keyed state that sees the rows of a key in event-time order, whatever order files arrive in.

Rows wait in a map state until the watermark has passed them by ``late``; an event-time timer releases them, oldest first, to a step that
folds them into a small list state. So results do not depend on how rows were dealt to files and micro-batches. A row that comes when
its time has already been released is not folded but given out with ``late_at`` set, to be stored and counted; Spark itself drops (and
counts) only rows older than ``horizon``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3600 * 1000

#: (kept rows, released rows (at, *fields) in order) -> (kept rows, output rows)
Step = Callable[[list, list], tuple[list, list]]


class InOrder(StatefulProcessor):
    def __init__(self, step: Step, fields: list[str], waiting: str, kept: str, names: list[str], late: int, horizon: int, idle: int):
        self.step, self.fields, self.schemas, self.row, self.width = step, fields, (waiting, kept), Row(*names), len(names) - 2
        self.late, self.horizon, self.idle = late, horizon, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", self.schemas[0])
        self.kept = handle.getListState("kept", self.schemas[1])
        self.edge = handle.getValueState("edge", "at bigint")

    def _edge(self) -> int | None:
        return self.edge.get()[0] if self.edge.exists() else None

    def _limit(self, timer_values) -> int:
        """Microseconds up to which rows are released: ``late`` behind the newest row of the stream."""
        mark = timer_values.getCurrentWatermarkInMs()
        return (mark + self.horizon - self.late) * 1000 if mark > 0 else -1

    def _release(self, key, limit: int) -> Iterator[Row]:
        ready = sorted(at for at, in self.waiting.keys() if at <= limit)
        if ready:
            rows = [(at, *self.waiting.getValue((at,))) for at in ready]
            kept, out = self.step([tuple(x) for x in self.kept.get()] if self.kept.exists() else [], rows)
            for at in ready:
                self.waiting.removeKey((at,))
            self.edge.update((ready[-1],))
            if kept:
                self.kept.put(kept)
            else:
                self.kept.clear()
            if self.idle:
                self.handle.registerTimer(ready[-1] // 1000 + self.idle - self.horizon)
            for x in out:
                yield self.row(key[0], *x, None)
        first = min((at for at, in self.waiting.keys()), default=None)
        if first is not None:
            self.handle.registerTimer(first // 1000 + self.late - self.horizon)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        edge = self._edge()
        for r in rows:
            value = tuple(r[f] for f in self.fields)
            if edge is not None and r["at"] <= edge:
                yield self.row(key[0], *([None] * self.width), r["at"])
            elif not self.waiting.containsKey((r["at"],)) or tuple(self.waiting.getValue((r["at"],))) < value:
                self.waiting.updateValue((r["at"],), value)  # of rows with one stamp the largest counts
        yield from self._release(key, self._limit(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit = self._limit(timerValues)
        edge = self._edge()
        if self.idle and edge is not None and edge // 1000 + self.idle <= limit // 1000 + self.late:
            self.kept.clear()  # a key without rows for that long; the edge stays
        yield from self._release(key, limit)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, step: Step, waiting: str, kept: str, out: str, key: str = "symbol", ts: str = "ts",
             late: int = 6 * HOUR, horizon: int = 30 * 24 * HOUR, idle: int = 0, mark: str | None = None) -> DataFrame:
    """``key``, the columns of ``out`` and ``late_at`` (set for rows that came too late, with the other columns null).

    ``waiting`` names the columns that a row keeps (DDL), ``kept`` a row of the list state, all times in microseconds. Times are in
    milliseconds: ``late`` is how far files may be out of order, ``horizon`` (not less) how long late rows are still given out,
    ``idle`` (0: never) after what silence of a key its kept rows go. Rows with ``mark`` (a boolean column) only move the watermark.
    """
    if horizon < late:
        raise ValueError("horizon must not be less than late")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fields = [x.split()[0] for x in waiting.split(", ")]
    names = [key, *[x.split()[0] for x in out.split(", ")], "late_at"]
    timed = rows.withWatermark(ts, f"{horizon} milliseconds")
    if mark:  # a filter that reads the event time stays above the watermark
        timed = timed.where(~(F.col(mark) & F.col(ts).isNotNull()))
    timed = timed.select(key, ts, F.unix_micros(F.col(ts)).alias("at"), *fields)
    return timed.groupBy(key).transformWithState(
        InOrder(step, fields, waiting, kept, names, late, horizon, idle), f"{key} string, {out}, late_at bigint", "append", "eventTime")


def on_time(rows: DataFrame) -> DataFrame:
    return rows.where("late_at IS NULL").drop("late_at")


def too_late(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """The rows that came too late: key and time."""
    return rows.where("late_at IS NOT NULL").select(key, F.timestamp_micros("late_at").alias("ts"))
