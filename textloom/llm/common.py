"""Shared tables, document passes and connected components for the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
FILE_ROWS = 50_000  # of small tables, whose many rounds would else leave a file and a task for each partition

_resident: dict[str, tuple] = {}
_made: list[tuple[SparkSession, str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one beside the warehouse if that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, table, path in _made:
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit, or this table
            continue


def prepare(spark: SparkSession) -> None:
    """Ships the package, and bounds the session's Arrow batches: texts of any length may stand in a row."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        value = spark.conf.get(name).lower().rstrip("b")
        if not value.isdigit() or not 0 < int(value) <= most:
            spark.conf.set(name, str(most))


class Scratch:
    """Written tables of one operator run. They cut lineage and outlive executors; the rest goes at exit."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, by: str | None = None, rows: int | None = None) -> DataFrame:
        """Writes df as Parquet and reads it back; with `by` partitioned on disk by that column, with a bound of its rows in files that this many need."""
        path, schema = f"{self.root}/{name}", df.schema
        if rows is not None:
            df = df.coalesce(max(4, rows // FILE_ROWS))
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        _made.append((self.spark, "", path))
        return self.spark.read.schema(schema).parquet(path)

    def sorted_run(self, df: DataFrame, key: str, n: int) -> tuple[str, DataFrame]:
        """Writes df in n buckets of `key`, each sorted by it: a merge join reads it without exchange or sort."""
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
        _made.append((self.spark, name, path))
        return path, self.spark.table(name)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again, and lets finished shuffles go."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
        gc.collect()
        self.spark._jvm.System.gc()


def _release() -> None:
    """Gives freed memory back to the system, as the worker may stay idle beside others for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it likes
        pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow in slices of at most `rows` rows; make() builds the worker's state once for each task."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _resident and make.__module__ not in _resident:
            _resident.clear()
            gc.collect()
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield each(batch.slice(at, rows))
        _release()

    return df.mapInArrow(run, schema)


def resident(module: str, key, make: Callable):
    """What make() gives, kept in the worker process until another module's operator runs there or the key changes."""
    if _resident.get(module, (None,))[0] != key:
        _resident.clear()
        _resident[module] = (key, make())
    return _resident[module][1]


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df and none of those before has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array, drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """The batch with one column exchanged and some left out."""
    names = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([values if n == name else batch.column(n) for n in names], names=names)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of `edges` (u long, v long): a row (u, v) for each node that isn't its component's smallest, v being that.

    Alternating large and small stars; each round is a written table, so a lost executor costs one round at most,
    and every step is an equi-join of written tables, whose hot keys the adaptive plan may split, and a distinct.
    """
    e = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    turn = 0
    while mark[0]:
        keep = lambda df, name, rows=2 * mark[0]: scratch.table(df, f"{name}{turn}", rows=rows)  # noqa: B023, E731 - a node for each end of an edge at most
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large")
        e = keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "middle")
        low = keep(e.groupBy("u").agg(F.min("v").alias("m")), "small")
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        turn += 1
        e = keep(e, "edges")
        scratch.drop(f"large{turn - 1}", f"middle{turn - 1}", f"small{turn - 1}", f"edges{turn - 1}")
        was, mark = mark, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    return e
