"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(1024 * x); scores are inner products, so they are exact. Queries come in blocks of `BLOCK`.
For a block every candidate is scored in each of a few passes. A pass counts scores in `BINS` bins of the range that is
left for each query, sums the counts over all tasks and narrows the range to the bin of the kth highest score, until the
bin is one value: the kth score itself. A task leaves out bins below its own kth score, which can't be above the global
one, so it sends k bins a query at most. A last pass keeps what scores higher, and of those that tie the smallest ids.

Defined cases: null vectors, or ones holding null, NaN or infinite components, and rows without id take no part, neither
as queries nor as candidates; a candidate with the query's own id is left out; vectors of another length than the query's
don't match; queries that repeat an id with another vector count once, the smallest vector; candidates that repeat are
all listed; fewer than k candidates give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_rows

SCALE = 1024
K = 10
BLOCK = 1024
BINS = 1024
EXACT = 1 << 53
MOST = (1 << 63) - 1024  # scores beyond what a long holds count as this one


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def integers(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given length, and their vectors as whole numbers in doubles."""
    sizes = column.value_lengths().to_numpy()
    rows = np.flatnonzero(sizes == dim)
    flat = column.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    return rows, np.floor(SCALE * flat[starts[rows][:, None] + np.arange(dim)]) if len(rows) else np.zeros((0, dim))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can lose a bit, else in Python's integers."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if bound < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = [[int(x) for x in v] for v in vectors.tolist()]
    out = [[sum(a * b for a, b in zip(map(int, q), v, strict=True)) for v in whole] for q in queries.tolist()]
    return np.clip(np.array(out, object), -MOST, MOST).astype(np.int64).reshape(len(queries), len(vectors))


def unsigned(scores: np.ndarray) -> np.ndarray:
    """Scores as unsigned numbers in the same order, so that no difference of two of them overflows."""
    return scores.view(np.uint64) ^ np.uint64(1 << 63)


def signed(keys: np.ndarray) -> np.ndarray:
    return (keys ^ np.uint64(1 << 63)).view(np.int64)


def _batches(batch: pa.RecordBatch, dim: int):
    rows, vectors = integers(batch.column(1), dim)
    ids = batch.column(0).to_numpy()[rows]
    for at in range(0, len(ids), 1024):
        yield ids[at : at + 1024], vectors[at : at + 1024]


def _count_pass(candidates: DataFrame, sent, k: int) -> DataFrame:
    """(q, bin, n): scores (unsigned) in the bins of each query's range, without bins under the task's own kth."""

    def run(batches):
        ids, queries, lo, step = sent.value
        table = np.zeros((len(ids), BINS + 1), np.int64)  # the last bin is above the range
        for batch in batches:
            for own, vectors in _batches(batch, queries.shape[1]):
                scores = unsigned(products(queries, vectors))
                ok = (scores >= lo[:, None]) & (own[None, :] != ids[:, None])
                bins = np.minimum((scores - lo[:, None]) // step[:, None], np.uint64(BINS)).astype(np.int64)
                flat = (np.arange(len(ids))[:, None] * (BINS + 1) + bins)[ok]
                table += np.bincount(flat, minlength=table.size).reshape(table.shape)
        above = table[:, ::-1].cumsum(axis=1)[:, ::-1] - table
        q, b = np.nonzero((table > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(table[q, b], pa.int64())], names=["q", "bin", "n"])

    return candidates.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _longest(candidates: DataFrame) -> float:
    """The largest squared length of a candidate, which bounds all scores."""
    return candidates.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double")))).first()[0] or 0.0


def kth_scores(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The kth highest score of each query, and how many of those that tie with it belong to the k."""
    bound = np.minimum(np.sqrt((queries * queries).sum(axis=1)) * np.sqrt(longest) * (1 + 1e-9) + 2, float(MOST)).astype(np.int64)
    lo, hi, need = unsigned(-bound), unsigned(bound), np.full(len(ids), k, np.int64)  # both ends belong to the range
    least = lo.copy()
    while (hi > lo).any():
        step = (hi - lo) // np.uint64(BINS) + np.uint64(1)
        sent = candidates.sparkSession.sparkContext.broadcast((ids, queries, lo, step))
        found = _count_pass(candidates, sent, k)
        above = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        sums = found.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        rows = sums.where(f"above < {k} AND above + n >= {k}").collect()  # a row for each query of the block
        fewer = np.ones(len(ids), bool)
        new_lo, new_hi = lo.copy(), lo.copy()
        for r in rows:
            fewer[r.q] = False
            new_lo[r.q] = lo[r.q] + np.uint64(r.bin) * step[r.q]
            new_hi[r.q] = new_lo[r.q] + min(step[r.q] - np.uint64(1), hi[r.q] - new_lo[r.q])
            need[r.q] = k - r.above
        need[fewer] = k  # under k candidates: all of them count
        new_lo[fewer] = new_hi[fewer] = least[fewer]
        lo, hi = new_lo, new_hi
        sent.unpersist()
    return signed(lo), need


def _keep_pass(candidates: DataFrame, sent, schema: str) -> DataFrame:
    """(query_id, vec_id, score) of scores above the kth, and of each task's smallest ids among those that tie."""

    def run(batches):
        ids, queries, kth, need = sent.value
        ties: dict[int, np.ndarray] = {}
        for batch in batches:
            for own, vectors in _batches(batch, queries.shape[1]):
                scores = products(queries, vectors)
                other = own[None, :] != ids[:, None]
                q, c = np.nonzero((scores > kth[:, None]) & other)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[c]), pa.array(scores[q, c])], names=["query_id", "vec_id", "score"])
                tie = (scores == kth[:, None]) & other
                for k in np.flatnonzero(tie.any(axis=1)).tolist():
                    ties[k] = np.sort(np.concatenate([ties.get(k, own[:0]), own[tie[k]]]))[: need[k]]
        q = np.repeat(np.fromiter(ties, np.int64, len(ties)), [len(v) for v in ties.values()])
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(np.concatenate([*ties.values(), ids[:0]])), pa.array(kth[q])], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    candidates = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    number = F.row_number().over(Window.partitionBy("part", "dim").orderBy("vec_id")) - 1
    parts = F.lit(max(1, -(-asked.count() // (4 * block))))
    dealt = asked.withColumn("dim", F.size("embedding")).withColumn("part", F.pmod(F.xxhash64("vec_id"), parts))
    blocks = scratch.table(dealt.withColumn("block", F.floor(number / block)), "queries")
    schema = "query_id long, vec_id long, score long"
    kept, longest = spark.createDataFrame([], schema), _longest(candidates)
    for part, dim, number in blocks.select("part", "dim", "block").distinct().orderBy("part", "dim", "block").toLocalIterator():
        rows = blocks.where((F.col("part") == part) & (F.col("dim") == dim) & (F.col("block") == number)).orderBy("vec_id").toArrow()
        ids = rows["vec_id"].to_numpy()  # `block` queries at most
        _, wanted = integers(rows["embedding"].combine_chunks(), dim)
        kth, need = kth_scores(candidates, ids, wanted, k, longest)
        sent = spark.sparkContext.broadcast((ids, wanted, kth, need))
        kept = kept.union(scratch.table(_keep_pass(candidates, sent, schema), f"kept-{part}-{dim}-{number}"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
