"""Exact vector search over a written table of cells.

Vectors of unit length lie in the cell of their nearest centre; a cell has its centre and its radius, the largest angle between
the centre and a member. A member's angle to a query is at least the query's angle to the centre less the radius, so the
cosine in a cell is bounded by that of this difference. A query looks into its most promising cells first; the k-th best
score found there is a floor, and of all other cells only those whose bound reaches it are read. The table is partitioned by
cell, so cells that no query of a block wants are not read at all, and no vector of a cell is scored for a query that has
ruled the cell out.

Centres are a bounded sample: CELLS vectors, the first by a hash of their key. Vectors without length (cosine 0) have a cell of
their own. Null, empty and null-holding vectors are not searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import BLOCK, in_blocks
from .similar import folder

CELLS = 256  # centres at most
FIRST = 4  # cells that a query looks into before others are bounded
SLACK = 1e-7  # of angles, far above what rounding adds
NONE = -1  # the cell of vectors without length


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1))
    return np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(len(column), -1)


def _assign(centres: np.ndarray) -> Callable:
    """Adds the cell of each vector and its angle to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(1)))
            cosine = x @ centres.T
            cell = cosine.argmax(axis=1)
            far = angle(cosine[np.arange(len(x)), cell])
            blank = ~x.any(axis=1)
            cell[blank], far[blank] = NONE, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _scan(sent, k: int, key: str, id_kind: pa.DataType, digits: int) -> Callable:
    """The k best of each query in a task, over the cells that it wants; and a row (query, null, number of vectors scored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, wanted = sent.value
        size = np.sqrt((vectors * vectors).sum(axis=1))
        keys: list = [np.zeros(0, object)] * len(ids)
        best, scored, kind = [np.zeros(0)] * len(ids), np.zeros(len(ids)), None
        for batch in batches:
            kind = batch.column(key).type
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                rows = np.flatnonzero(cells == cell)
                asking = wanted.get(int(cell))
                if asking is None:
                    continue
                part = batch.take(pa.array(rows))
                x, own = _matrix(part.column("embedding")), np.array(part.column(key).to_pylist(), object)
                length = np.outer(size[asking], np.sqrt((x * x).sum(axis=1)))
                score = np.round(np.divide(vectors[asking] @ x.T, length, out=np.zeros_like(length), where=length > 0), digits)
                for q, line in zip(asking, score, strict=True):
                    scored[q] += len(line)
                    take = np.flatnonzero(line >= best[q].min()) if len(best[q]) >= k else np.arange(len(line))
                    s, n = np.concatenate([best[q], line[take]]), np.concatenate([keys[q], own[take]])
                    if len(s) > k:
                        order = np.array(sorted(np.flatnonzero(s >= np.partition(s, -k)[-k]).tolist(), key=lambda j: (-s[j], n[j]))[:k])
                        s, n = s[order], n[order]
                    best[q], keys[q] = s, n
        if kind is not None:
            rows = [(i, x, float(s)) for i, ks, ss in zip(ids, keys, best, strict=True) for x, s in zip(ks, ss, strict=True)] + [(i, None, float(c)) for i, c in zip(ids, scored, strict=True) if c]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_kind), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", key, "score"])

    return run


class CellTable:
    """Vectors (key, embedding) in a table partitioned by cell."""

    def __init__(self, vectors: DataFrame, key: str = "chunk_id", cells: int = CELLS):
        self.spark, self.key = vectors.sparkSession, key
        usable = vectors.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())).select(key, F.col("embedding").cast("array<double>").alias("embedding"))
        sample = usable.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64(key), key).limit(cells).collect()
        self.centres = unit(np.array([r["embedding"] for r in sample], float)) if sample else np.zeros((0, 0))
        self.path = folder(self.spark, "cells")
        if sample:
            schema = f"{key} {dict(usable.dtypes)[key]}, embedding array<double>, cell int, far double"
            usable.mapInArrow(_assign(self.centres), schema).repartition("cell", F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy("cell").parquet(self.path)
            self.table = self.spark.read.schema(schema).parquet(self.path)
        else:
            self.table = usable.withColumns({"cell": F.lit(NONE), "far": F.lit(0.0)})
        self.cells = {r["cell"]: (r["far"], r["n"]) for r in self.table.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # CELLS rows and one

    def bounds(self, queries: np.ndarray, numbers: list[int]) -> np.ndarray:
        """What the cosine of each query with a member of each cell is at most."""
        q = unit(queries)
        out = np.zeros((len(q), len(numbers)))
        for at, cell in enumerate(numbers):
            if cell != NONE:
                near = np.maximum(0.0, angle(q @ self.centres[cell]) - self.cells[cell][0] - SLACK)
                out[:, at] = np.where(q.any(axis=1), np.cos(near), 0.0)
        return out

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """query_id, key, score: the k best by cosine; ties to the smaller key."""
        found = self._search(queries, k, digits)
        return found.where(F.col(self.key).isNotNull())

    def _search(self, queries: DataFrame, k: int, digits: int) -> DataFrame:
        """The same, and a row (query_id, null, how many vectors were scored) for each query."""
        from pyspark.sql.pandas.types import to_arrow_type

        from .similar import written

        asked = queries.where(F.size("embedding") > 0).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        schema = f"query_id {dict(asked.dtypes)['query_id']}, {self.key} {dict(self.table.dtypes)[self.key]}, score double"
        id_kind, numbers, out = to_arrow_type(asked.schema["query_id"].dataType), sorted(self.cells), None

        def best(df: DataFrame) -> DataFrame:
            ranked = df.where(F.col(self.key).isNotNull()).withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key))).where(F.col("rn") <= k).drop("rn")
            return ranked.union(df.where(F.col(self.key).isNull()).groupBy("query_id").agg(F.lit(None).cast(dict(self.table.dtypes)[self.key]).alias(self.key), F.sum("score").alias("score")))

        def scan(ids: list, vectors: np.ndarray, wanted: np.ndarray) -> DataFrame:
            by_cell = {numbers[c]: np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}
            sent = self.spark.sparkContext.broadcast((ids, vectors, by_cell))  # BLOCK queries at most
            return self.table.where(F.col("cell").isin(list(by_cell))).mapInArrow(_scan(sent, k, self.key, id_kind, digits), schema)

        for block in in_blocks(asked, asked.columns, BLOCK):
            if not block or not numbers:
                continue
            ids, vectors = [r["query_id"] for r in block], np.array([r["embedding"] for r in block], float)
            bound = self.bounds(vectors, numbers)
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, np.argsort(-bound, axis=1)[:, :FIRST], True, axis=1)
            tried = written(best(scan(ids, vectors, first)))
            per = tried.where(F.col(self.key).isNotNull()).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).collect()  # a row a query of the block
            low = {r["query_id"]: r["low"] for r in per if r["n"] >= k}
            floor = np.array([low.get(i, -np.inf) for i in ids])
            more = (bound >= floor[:, None] - 10.0**-digits) & ~first
            both = tried.union(scan(ids, vectors, more)) if more.any() else tried
            out = best(both) if out is None else out.union(best(both))
        return self.spark.createDataFrame([], schema) if out is None else out
