"""Tables that are changed by keys: each batch is written once, in proportion to its rows, and merged when it is read.

A table is a folder. `base` has rows by bucket of the key and by the number of the last batch that they hold; `changes` has the
batches, by number and bucket, a deleted key as a row that says so. `marks` lists what has been written whole, last of all,
so what a lost job leaves behind is never read. A read takes the newest base of each bucket, leaves out the keys that later
batches have, and adds the last row of these: where the changes are few they are sent to the tasks of the base, which is
not moved. `compact` writes new bases of those buckets that have changes; others keep theirs.

One writer at a time; readers never wait. Rows with a null key are kept as rows of that key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

GONE = StructField("gone__", BooleanType())
MARK = "kind string, seq long, bucket int"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _marks(self) -> list:
        """(kind, seq, bucket): a row a batch, and one for each base of a bucket."""
        try:
            return self.spark.read.schema(MARK).json(f"{self.path}/marks").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # no batch yet
                return []
            raise

    def _mark(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, MARK).coalesce(1).write.mode("append").json(f"{self.path}/marks")

    def _state(self) -> tuple[int, dict[int, int]]:
        """The last batch, and that which each bucket's base holds."""
        marks = self._marks()
        upto: dict[int, int] = {}
        for m in marks:
            if m["kind"] == "base":
                upto[m["bucket"]] = max(upto.get(m["bucket"], 0), m["seq"])
        return max((m["seq"] for m in marks if m["kind"] == "change"), default=0), upto

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket__", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> int:
        seq = self._state()[0] + 1
        self._with_bucket(rows).write.mode("overwrite").partitionBy("bucket__").parquet(f"{self.path}/changes/seq__={seq}")
        self._mark([("change", seq, None)])
        return seq

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Inserts rows or replaces those of their keys; of rows that share a key the last by `order` counts. Gives the batch's number."""
        rows = rows.select(self.columns)
        rest = F.struct(*[c for c in self.columns if c not in self.keys])
        if order is not None:
            rows = rows.groupBy(*self.keys).agg(F.max_by(rest, order).alias("x")).select(*self.keys, "x.*").select(self.columns)
        else:
            rows = rows.dropDuplicates(self.keys)
        return self._write(rows.withColumn("gone__", F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        """Deletes the rows that have the values of `keys`, all key columns or some of them."""
        if set(keys.columns) == set(self.keys):
            gone = keys.distinct()
        else:
            gone = self.read().select(self.keys).join(keys.distinct(), keys.columns, "left_semi")
        blank = [F.col(c) if c in self.keys else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns]
        return self._write(gone.select(*blank, F.lit(True).alias("gone__")))

    def update(self, values: DataFrame, columns: list[str]) -> int:
        """Sets columns of the rows whose keys `values` (keys and columns) has; others of its keys are left out."""
        new = values.select(*self.keys, *(F.col(c).alias(f"{c}__") for c in columns)).dropDuplicates(self.keys)
        rows = self.read().join(new, self.keys)
        return self._write(rows.select(*(F.col(f"{c}__").alias(c) if c in columns else F.col(c) for c in self.columns), F.lit(False).alias("gone__")))

    def _parts(self, seq: int, upto: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        """The merged rows, with their bucket. What is read is chosen by folders: a base of each bucket, and the batches behind it."""
        chosen = range(self.buckets) if buckets is None else buckets
        either = lambda conditions: reduce(Column.__or__, conditions, F.lit(False))  # noqa: E731 - one a bucket
        place = [StructField("bucket__", IntegerType()), StructField("seq__", LongType())]
        rows = lambda kind, fields: self.spark.read.schema(StructType([*self.schema.fields, *fields, *place])).parquet(f"{self.path}/{kind}")
        empty = self.spark.createDataFrame([], StructType([*self.schema.fields, GONE, *place]))
        base = rows("base", []).where(either((F.col("bucket__") == b) & (F.col("seq__") == upto[b]) for b in chosen if b in upto)) if upto else empty.drop("gone__")
        changes = rows("changes", [GONE]).where(either((F.col("bucket__") == b) & F.col("seq__").between(upto.get(b, 0) + 1, seq) for b in chosen)) if seq else empty
        last = F.struct(*[c for c in self.columns if c not in self.keys], "gone__", "bucket__")
        new = changes.groupBy(*self.keys).agg(F.max_by(last, "seq__").alias("x")).select(*self.keys, "x.*")
        names = [f"{k}__key" for k in self.keys]
        same = F.lit(True)
        for k, n in zip(self.keys, names, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(n))
        old = base.join(new.select(*(F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True))), same, "left_anti")
        return old.select(*self.columns, "bucket__").unionByName(new.where("NOT gone__").select(*self.columns, "bucket__"))

    def read(self) -> DataFrame:
        return self._parts(*self._state()).select(self.columns)

    def compact(self, least: int = 1) -> list[int]:
        """New bases of the buckets with `least` batches or more behind theirs. Gives the buckets."""
        seq, upto = self._state()
        full = [b for b in range(self.buckets) if seq - upto.get(b, 0) >= least]
        if full:
            rows = self._parts(seq, upto, full).withColumn("seq__", F.lit(seq))
            rows.repartition("bucket__").write.mode("append").partitionBy("seq__", "bucket__").parquet(f"{self.path}/base")
            self._mark([("base", seq, b) for b in full])
        return full
