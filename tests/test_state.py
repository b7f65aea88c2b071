"""Keyed state of event streams: several drains, late and repeated events, silence."""

import datetime as dt

from pyspark.sql import functions as F

from textloom.shipping import ship
from textloom.streaming import state

SCHEMA = "task string, kind string, value double, ts timestamp, seq long"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_drains_go_on_and_late_events_change_nothing(spark, tmp_path):
    ship(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, source, [("a", "start", 1.0, at(1), 1), ("a", "stop", None, at(2), 2), ("b", "start", 3.0, at(5), 1), ("b", "go", 4.0, at(5), 2)])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    now = lambda: {r.task: (r.kind, r.value, r.seq) for r in state.current(spark, out, "task").collect()}
    state.drain(stream(), "task", ["ts", "seq"], out)
    assert now() == {"a": ("stop", None, 2), "b": ("go", 4.0, 2)}
    add(spark, source, [("a", "late", 9.0, at(0), 9), ("b", "go", 4.0, at(5), 2), ("c", "new", 0.0, at(0), 1)])
    state.drain(stream(), "task", ["ts", "seq"], out)
    assert now() == {"a": ("stop", None, 2), "b": ("go", 4.0, 2), "c": ("new", 0.0, 1)}
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.where("batch = (SELECT 0)").count() == 2 and rows.count() == 5  # a row for each key that a batch has
    assert spark.conf.get(state.STORE, None) != state.ROCKS


def test_silent_tasks(spark, tmp_path):
    ship(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source).withWatermark("ts", "1 minute")
    add(spark, source, [("a", "start", 1.0, at(0), 1), ("b", "start", 1.0, at(30), 1)])
    state.drain(stream(), "task", ["ts", "seq"], out, 600)
    add(spark, source, [("b", "end", 1.0, at(31), 2)])
    state.drain(stream(), "task", ["ts", "seq"], out, 600)
    found = {r.task: (r.kind, r.silent) for r in state.current(spark, out, "task").select("task", "kind", "silent").collect()}
    assert found == {"a": ("start", True), "b": ("end", False)}
    assert spark.read.parquet(f"{out}/rows").where(F.col("silent")).count() == 1
