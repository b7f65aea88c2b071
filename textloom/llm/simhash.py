"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; the vector of their bit counts lies, under Manhattan
distance, no further from another's than the fingerprints differ in bits. The segments form six groups. Vectors at
distance 2 or less differ in at most two groups, so they share a grid cell of counts in some four of them: each distinct
fingerprint joins the 15 cells it lies in. Within a cell the Manhattan distance over all segments bounds the pairs and
the exact bit difference verifies them; a cell gives a star for each linked set in it, never its pairs. A cell of more
than `CELL` fingerprints is dealt anew by exact bits: all but two of six parts of the free bits fixed, which leaves at
most 256 fingerprints a cell, so no cap drops a link. Components come from alternating stars.

Defined cases: null or wordless text has fingerprint zero and links like any other; a null doc_id keeps its fingerprint
but joins no component (null component_id, unless others share the fingerprint); rows sharing a doc_id are one node each
by fingerprint; an empty table gives an empty result; other columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, fresh_name, map_rows, raw

BITS = 2
CELL = 1024
WHOLE = 1 << 62  # no cell of the second grid is dealt again
SAMPLED = 64  # one fingerprint of so many tells which cells are large
SEED = 42
GROUPS = [range(0, 6), range(6, 11), range(11, 16), range(16, 21), range(21, 26), range(26, 32)]
FREE = list(combinations(range(6), 2))
SCHEMA = "cell int, key long, fp long, rep long"


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, SEED) for p in parts], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long (the 64 bits as signed)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t) for t in raw(batch.column(1))], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, fp long")


def counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of the 32 segments, a row for each fingerprint."""
    two = (fp[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    return np.array([0, 1, 1, 2], np.int8)[two.astype(np.int8)]


def _cells():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, rep = batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
        c, out = counts(fp).astype(np.int64), []
        for free in FREE:
            key = np.zeros(len(fp), np.int64)
            for s in (s for g in range(6) if g not in free for s in GROUPS[g]):
                key = key * 3 + c[:, s]
            out.append(key)
        n = len(fp)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(15, dtype=np.int32), n)), pa.array(np.concatenate(out)), pa.array(np.tile(fp.view(np.int64), 15)), pa.array(np.tile(rep, 15))], names=["cell", "key", "fp", "rep"])

    return each


def _parts(free: tuple[int, int]) -> list[np.uint64]:
    """Six masks that share out the bits of the two free groups."""
    bits = [b for g in free for s in GROUPS[g] for b in (2 * s, 2 * s + 1)]
    return [np.uint64(sum(1 << b for b in bits[k::6])) for k in range(6)]


def _subcells():
    masks = [[parts[a] | parts[b] for a, b in FREE] for parts in map(_parts, FREE)]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, fp, rep = batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
        table = np.array(masks, np.uint64)
        cells = np.concatenate([cell * 15 + k for k in range(15)]).astype(np.int32)
        keys = np.concatenate([fp & ~table[cell, k] for k in range(15)]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(keys), pa.array(np.tile(fp.view(np.int64), 15)), pa.array(np.tile(rep, 15))], names=["cell", "key", "fp", "rep"])

    return each


def linked(group: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest of its linked set) in each run of equal `group` values."""
    n, a, b, c, apart = len(fp), [], [], counts(fp), 1
    live = np.arange(n)
    while len(live := live[live < n - apart]):
        live = live[group[live] == group[live + apart]]
        near = live[np.abs(c[live] - c[live + apart]).sum(axis=1) <= BITS]
        near = near[np.bitwise_count(fp[near] ^ fp[near + apart]) <= BITS]
        a.append(near)
        b.append(near + apart)
        apart += 1
    if not a:
        return rep[:0], rep[:0]
    i, j = np.concatenate(a), np.concatenate(b)
    order = np.argsort(rep, kind="stable")
    label = np.empty(n, np.int64)
    label[order] = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            break
        label = new
    best = rep[order[label]]
    keep = best != rep
    return rep[keep], best[keep]


def _links(most: int):
    """Input sorted by (cell, key). Rows: hot = false, (u, v) a link; hot = true, a row (cell, fp, rep) of a cell of over `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold, full = None, None

        def links(x):
            g = np.cumsum(np.r_[0, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
            u, v = linked(g, x[2].view(np.uint64), x[3])
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), bool)), pa.array(np.zeros(len(u), np.int32)), pa.array(u), pa.array(v)], names=["hot", "cell", "u", "v"])

        def hot(x):
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(x[0]), bool)), pa.array(x[0]), pa.array(x[2]), pa.array(x[3])], names=["hot", "cell", "u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(k).to_numpy() for k in range(4)]
            if full is not None:
                same = (x[0] == full[0]) & (x[1] == full[1])
                yield hot([y[same] for y in x])
                x = [y[~same] for y in x]
                if not len(x[0]):
                    continue
                full = None
            if hold is not None:
                x = [np.concatenate(y) for y in zip(hold, x, strict=True)]
            cut = np.flatnonzero(np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
            sizes = np.diff(np.r_[cut, len(x[0])])
            big = np.repeat(sizes > most, sizes)
            if big.any():
                yield hot([y[big] for y in x])
                if big[-1]:
                    full = (x[0][-1], x[1][-1])
            tail = np.zeros(len(big), bool)
            tail[cut[-1] :] = not big[-1]
            mid = ~big & ~tail
            if mid.any():
                yield links([y[mid] for y in x])
            hold = [y[tail] for y in x] if tail.any() else None
        if hold is not None:
            yield links(hold)

    return run


def _dealt(df: DataFrame, most: int) -> DataFrame:
    return df.repartition("cell", "key").sortWithinPartitions("cell", "key", "fp").mapInArrow(_links(most), "hot boolean, cell int, u long, v long")


def links(prints: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, fp): fp, rep (the smallest doc_id) of each fingerprint, and links (u, v) of reps that connect what differs in BITS bits."""
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "nodes")
    cells = map_rows(nodes, _cells, SCHEMA, 8192)
    # cells that a sample shows to be large go to the second grid at once, so that no task has to read one whole
    seen = map_rows(nodes.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0), _cells, SCHEMA, 8192)
    large = scratch.table(seen.groupBy("cell", "key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > CELL).select("cell", "key"), "large")
    any_large = bool(large.limit(1).count())
    found = scratch.table(_dealt(cells.join(large, ["cell", "key"], "left_anti") if any_large else cells, CELL), "found")
    hot = found.where("hot").select("cell", F.col("u").alias("fp"), F.col("v").alias("rep"))
    if any_large:
        hot = hot.union(cells.join(large, ["cell", "key"], "left_semi").select("cell", "fp", "rep"))
    return nodes, found.where("NOT hot").select("u", "v").union(_dealt(map_rows(hot, _subcells, SCHEMA, 8192), WHOLE).select("u", "v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp long, component_id long for every row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs), "prints")
    nodes, edges = links(prints, scratch)
    stars = components(edges, scratch).select(F.col("u").alias("rep"), F.col("v").alias("low"))
    named = nodes.join(stars, "rep", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one whose doc_id is smallest. Rows without doc_id stay."""
    name = fresh_name(docs, "kept_id")
    kept = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"] == kept[name], "left_semi").union(docs.where("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
