"""Status of each task as keyed state of a stream: the last event by time, kept in the state store, with timers for silence.

A batch touches the state of the keys that it has, and writes one row for each of them; nothing that is already there is
read or written again. Late and repeated events change nothing, as an event counts only if it is later than the state's.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state needs, for streams that are started within; the session's own setting comes back."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if was is None else spark.conf.set(STORE, was)


def plain(x):
    """A Python value of a pandas one, None for what is missing."""
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x.item() if hasattr(x, "item") else x


class LatestEvent(StatefulProcessor):
    """Keeps the last row of a key by `order`; with `idle` seconds, a row with silent = true once the watermark is so far beyond it."""

    def __init__(self, key: str, columns: list[str], order: list[str], schema: StructType, idle: int | None):
        self.key, self.columns, self.order, self.schema, self.idle = key, columns, order, schema, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _row(self, key, state: tuple, silent: bool) -> pd.DataFrame:
        return pd.DataFrame([[*key, *state, silent]], columns=[self.key, *self.columns, "silent"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        best = None
        for part in rows:
            row = part.sort_values(self.order, kind="stable").iloc[-1]
            own = tuple(plain(row[c]) for c in self.columns)
            best = own if best is None or self._place(own) > self._place(best) else best
        held = self.last.get() if self.last.exists() else None
        if held is None or self._place(best) > self._place(held):
            self.last.update(best)
            held = best
            if self.idle is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(best[self.columns.index(self.order[0])].timestamp() * 1000) + 1000 * self.idle)
        yield self._row(key, tuple(held), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        if self.last.exists():
            yield self._row(key, tuple(self.last.get()), True)

    def _place(self, row: tuple) -> tuple:
        return tuple(row[self.columns.index(c)] for c in self.order)

    def close(self) -> None:
        pass


def latest_events(events: DataFrame, key: str, order: list[str], idle: int | None = None) -> DataFrame:
    """A stream of (key, the other columns, silent): the last event so far of each key that a batch has, by `order` (its first column
    a timestamp with a watermark, if there are timers). Needs state_store() when it is started."""
    rest = [c for c in events.columns if c != key]
    schema = StructType([events.schema[c] for c in rest])
    out = StructType([events.schema[key], *schema.fields, StructField("silent", BooleanType())])
    processor = LatestEvent(key, rest, order, schema, idle)
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="None" if idle is None else "EventTime")


def append_to(folder: str):
    """A sink that writes each batch once, under its number."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def drain(events: DataFrame, key: str, order: list[str], folder: str, idle: int | None = None) -> StreamingQuery:
    """Reads what is there of a stream into `folder` (rows and checkpoint) and stops; a later call goes on behind it."""
    spark = events.sparkSession
    with state_store(spark):
        query = latest_events(events, key, order, idle).writeStream.outputMode("update").foreachBatch(append_to(f"{folder}/rows")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def current(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The last row of each key that a drained stream has written."""
    rows = spark.read.parquet(f"{folder}/rows")
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("batch", "silent")).alias("x")).select(key, "x.*")
