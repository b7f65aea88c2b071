"""Section events and task status as streams. Windows with watermarks are an extension; the application has none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "task_id string, seq long, kind string, section string, status string, updated_at timestamp"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT, files_per_batch: int = 100) -> DataFrame:
    """Append-only JSON lines as a stream; malformed lines become null rows and are left out."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.where(F.col(rows.columns[0]).isNotNull())


def latest_status(events: DataFrame, key: str = "task_id", order: str = "updated_at") -> DataFrame:
    """The last event of each key; works on streams (update or complete mode) and on tables."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in ("seq", "event_id") if c in rest])).alias("x")).select(key, "x.*")


def follow(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, until_now: bool = True) -> StreamingQuery:
    """Hands each batch to the sink; with until_now it stops when what is there has been read."""
    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_now else writer.trigger(processingTime="500 milliseconds")).start()


def merge_status(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that upserts the last status of each task into a Parquet table, a new version of it for each batch."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_status(batch)
        if number:
            new = latest_status(spark.read.parquet(f"{target}/v={number - 1}").select(*new.columns).unionByName(new))
        new.write.mode("overwrite").parquet(f"{target}/v={number}")

    return sink


def windowed(events: DataFrame, ts: str = "ts", size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows, with a watermark for late rows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = events.withWatermark(ts, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no more than `gap` apart."""
    rows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def control_state(events: DataFrame) -> DataFrame:
    """task_id, state: running, paused or cancelled by the last pause, resume or cancel event; a cancelled task stays so."""
    rows = events.where(F.col("kind").isin("pause", "resume", "cancel"))
    last = F.max_by("kind", F.struct("updated_at", "seq"))
    state = F.when(F.max(F.col("kind") == "cancel"), "cancelled").when(last == "pause", "paused").otherwise("running")
    return rows.groupBy("task_id").agg(state.alias("state"))


def stop_when(query: StreamingQuery, cancelled: Callable[[], bool], every: float = 0.5) -> bool:
    """Waits for a query to end, and stops it as soon as `cancelled` says so; whether it was stopped."""
    while not query.awaitTermination(every):
        if cancelled():
            query.stop()
            return True
    return False


def assembled(tokens: DataFrame) -> DataFrame:
    """task_id, section, text: a model's pieces of text (task_id, section, seq, piece) put together; repeated pieces of one seq count once.
    Neighbouring pieces of a section move as one row, and once."""
    rows = tokens.select("task_id", "section", "seq", F.col("piece").cast("string").alias("piece"))
    kinds = dict(rows.dtypes)
    runs = rows.mapInArrow(_runs, f"task_id {kinds['task_id']}, section {kinds['section']}, seqs array<{kinds['seq']}>, pieces array<string>")
    both = F.flatten(F.collect_list(F.arrays_zip("seqs", "pieces")))
    whole = runs.groupBy("task_id", "section").agg(F.array_sort(F.transform(both, lambda x: F.struct(x["seqs"].alias("seq"), x["pieces"].isNull().alias("none"), x["pieces"].alias("piece")))).alias("p"))
    first = F.filter("p", lambda x, k: (k == 0) | ~x["seq"].eqNullSafe(F.get("p", k - 1)["seq"]))
    return whole.select("task_id", "section", F.array_join(F.transform(first, lambda x: x["piece"]), "").alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one task and section as a row with lists."""
    for b in batches:
        if b.num_rows:
            other = np.zeros(b.num_rows - 1, bool)
            for c in b.columns[:2]:
                then, now = c.slice(0, b.num_rows - 1), c.slice(1)
                differ = pc.fill_null(pc.not_equal(then, now), False)
                other |= pc.or_(differ, pc.xor(pc.is_null(then), pc.is_null(now))).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(other) + 1])
            at = pa.array(np.append(starts, b.num_rows), pa.int32())
            one = pa.array(starts)
            lists = [pa.ListArray.from_arrays(at, c) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays([*(c.take(one) for c in b.columns[:2]), *lists], names=["task_id", "section", "seqs", "pieces"])

