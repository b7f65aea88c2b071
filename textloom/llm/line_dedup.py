"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased. A key of at least `MIN_CHARS`
code points that two documents hold stays in the one with the smallest doc_id only. Documents come in batches of rising
doc_id. A run holds (key hash, owner), in buckets sorted by hash. Each batch merge-anti-joins the runs: what is left are
the keys it is the first to hold, which become a new run; two runs of one level are compacted into one of the next. A
line goes if its key was in a run already, or if a smaller doc_id of its own batch owns it.

Defined cases: a null or empty text is one empty line; a null doc_id neither owns nor loses lines; rows that share a
doc_id share their fate, as a key's owner decides by doc_id alone; short and empty lines always stay; an empty table
gives an empty result; other columns of the input pass through whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh_names, map_rows, raw, replace_column

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
BUCKET_ROWS = 4_000_000  # lines for each bucket of a run, if there are more than the shuffle's partitions would give


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of the line's key, None if it is too short to count. bytes.strip() and lower() are ASCII only."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            if doc is not None and text:
                found = {k for line in text.split(b"\n") if (k := line_key(line))}
                ids += [doc] * len(found)
                keys += found
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return each


class LineRuns:
    """The store: levels of sorted runs. add() takes one batch of (doc_id, key), later batches holding larger ids."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = FANOUT):
        self.scratch, self.buckets, self.fanout, self.levels = scratch, buckets, fanout, [[]]

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds the batch; returns the (doc_id, key) that lose their lines."""
        own = lines.groupBy("key").agg(F.min("doc_id").alias("owner"))
        for run in (r for level in self.levels for r in level):
            own = own.join(run, "key", "left_anti")
        path, run = self.scratch.sorted_run(own, "key", self.buckets)
        self.levels[0].append(run)
        plain = self.scratch.spark.read.schema(run.schema).parquet(path)  # without buckets: the plan may split a hot key
        return lines.join(plain, "key", "left").where("owner IS NULL OR owner < doc_id").select("doc_id", "key")

    def compact(self) -> None:
        """Merges full levels upwards. Runs hold disjoint keys, so a merge is a union in key order."""
        for at, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = level[0]
                for run in level[1:]:
                    merged = merged.union(run)
                self.levels[at] = []
                self.levels[at + 1 : at + 2] = [[*(self.levels[at + 1] if at + 1 < len(self.levels) else []), self.scratch.sorted_run(merged, "key", self.buckets)[1]]]


def dropped_keys(docs: DataFrame, batches: int = BATCHES, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, keys array of binary): the keys whose lines a document loses, for documents that lose any."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000)).first()[0] or []
    number = sum((F.col("doc_id") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    keyed = map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _keys, "doc_id long, key binary")
    lines = scratch.table(keyed.withColumn("batch", number), "lines", by="batch")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // BUCKET_ROWS)
    store, lost = LineRuns(scratch, buckets), None
    for k in range(len(cuts) + 1):
        gone = scratch.table(store.add(lines.where(F.col("batch") == k).select("doc_id", "key")), f"lost{k}")
        lost = gone if lost is None else lost.union(gone)
        if k < len(cuts):
            store.compact()
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _judged(docs: DataFrame, batches: int) -> tuple[DataFrame, str]:
    """docs with a column of lost keys."""
    name, doc = fresh_names(docs, "lost_keys", "lost_doc")
    lost = dropped_keys(docs, batches).select(F.col("doc_id").alias(doc), F.col("keys").alias(name))
    return docs.join(lost, docs["doc_id"] == lost[doc], "left").drop(doc), name


def keep_lines(text: bytes | None, lost: list[bytes] | None) -> tuple[list[bytes], int]:
    """The lines that stay, and how many there were."""
    lines = (text or b"").split(b"\n")
    if not lost:
        return lines, len(lines)
    gone = set(lost)
    return [x for x in lines if line_key(x) not in gone], len(lines)


def line_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with the lines removed from text; every row and column stays."""
    judged, name = _judged(docs, batches)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [t if not lost else b"\n".join(keep_lines(t, lost)[0]) for t, lost in zip(raw(batch.column("text")), batch.column(name).to_pylist(), strict=True)]
            return replace_column(batch, "text", pa.array(out, pa.binary()).cast(pa.string()), (name,))

        return each

    return map_rows(judged, make, docs.schema)


def line_dedup_digest(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every document."""
    judged, name = _judged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, gone, sha = [], [], []
            for t, lost in zip(raw(batch.column("text")), batch.column(name).to_pylist(), strict=True):
                kept, n = keep_lines(t, lost)
                total.append(n)
                gone.append(n - len(kept))
                sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

        return each

    return map_rows(judged, make, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR owner >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN owners USING (key) GROUP BY doc_id
"""
