"""Best-fit packing of documents into sequences of at most `CAPACITY` tokens, after dominance reduction.

A document is its byte-level BPE ids and a closing id. One longer than a sequence is cut so that all pieces but the first
are full. Pieces of one length are interchangeable, so the instance is its histogram of lengths: `CAPACITY` counts, however
many documents there are. On it, Martello and Toth's reduction takes the largest length and permanently fixes sets that
provably dominate every other set holding it (alone if nothing fits beside it; with a partner that fills the sequence, or
is at least as long as any others that could stand there; with the best two if no other two can replace them), all pieces
of these lengths at once. Best fit packs what remains, longest first, again in bulk. The plan is a short list of slots:
pieces of length L with ranks lo to hi - 1 go to sequences base, base + 1, ... at one offset. A piece's rank among its
length is the number of such pieces in earlier tasks, plus its number in its own task.

Defined cases: a null text is empty, and an empty one is a piece of the closing id alone; a null doc_id and repeated rows
are packed like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_rows

CAPACITY = 1024
CLOSING = 2
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}  # added tokens, which a text's characters give as with tokenizers

_encodings: dict[int, tiktoken.Encoding] = {}


def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The vocabulary of byte_bpe_50k.json as ranks: the same ids as tokenizers gives, at several times its speed."""
    key = zlib.crc32(ranks)
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
    return _encodings[key]


def read_ranks(spark: SparkSession, path: str | None = None):
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # under a megabyte, whatever the input


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than full."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, its task and its number among the task's pieces of that length, maybe ids."""
    ranks = read_ranks(docs.sparkSession, path)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids

    def make():
        enc, seen, task = encoding(ranks.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32), np.uint32(CLOSING)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc, k, start, length, zlib.crc32(part.tobytes()), task, int(seen[length]), part.view(np.int32) if with_ids else None)
                    seen[length] += 1
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            n = 7 + with_ids
            return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out[:n], kinds[:n], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][:n])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)


class Plan:
    """Sequences planned on a histogram; slots are (length, lo, hi, base, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences, self.slots = capacity, 0, []
        self.left = {n: k for n, k in histogram.items() if k > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)
        self.reduce()
        self.best_fit()

    def take(self, length: int, k: int) -> int:
        lo = self.used[length]
        self.used[length] += k
        self.left[length] -= k
        if not self.left[length]:
            del self.left[length]
            self.sizes.pop(bisect_left(self.sizes, length))
        return lo

    def fix(self, lengths: list[int]) -> None:
        """As many sequences of these lengths as there can be."""
        k = min(self.left[n] // lengths.count(n) for n in set(lengths))
        offset = 0
        for n in lengths:
            lo = self.take(n, k)
            self.slots.append((n, lo, lo + k, self.sequences, offset))
            offset += n
        self.sequences += k

    def dominating(self, length: int) -> list[int] | None:
        """A set with `length` that dominates all others with it, or None."""
        room = self.capacity - length
        have = {n: k - (n == length) for n, k in self.left.items() if n <= room and k > (n == length)}
        if not have:
            return [length]
        sizes = np.array(sorted(have))
        best = int(sizes[-1])
        small = int(sizes[0])
        second = small if have[small] > 1 else int(sizes[1]) if len(sizes) > 1 else room + 1
        if best == room or small + second > room:
            return [length, best]
        three = sorted(n for n in sizes[:3].tolist() for _ in range(min(3, have[n])))[:3]
        if len(three) == 3 and sum(three) <= room:
            return None
        sums = sizes[:, None] + sizes[None, :]
        ok = (sums <= room) & (sizes[:, None] >= sizes[None, :])
        single = np.array([have[n] > 1 for n in sizes.tolist()])
        np.fill_diagonal(ok, ok.diagonal() & single)
        if sums[ok].max() <= best:
            return [length, best]
        beside = sizes[ok[-1]]  # what fits with the best one
        if len(beside):
            other = int(beside[-1])
            x, y = np.nonzero(ok)
            if ((sizes[y] <= other) | (sums[x, y] <= best)).all():
                return [length, best, other]
        return None

    def reduce(self) -> None:
        at = len(self.sizes) - 1
        while at >= 0:
            found = self.dominating(self.sizes[at])
            if found:
                self.fix(found)
            else:
                at -= 1
            at = min(at, len(self.sizes) - 1)

    def best_fit(self) -> None:
        open_: dict[int, list] = {}  # room -> groups [base, sequences, slots (length, lo, offset)]
        rooms: list[int] = []

        def put(room: int, group: list) -> None:
            if room not in open_:
                open_[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_[room].append(group)

        while self.sizes:
            length = self.sizes[-1]
            at = bisect_left(rooms, length)
            count = self.left[length]
            if at < len(rooms):
                room = rooms[at]
                base, m, slots = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, slots = self.capacity, []
                base, m = self.sequences, -(-count // (room // length))
                self.sequences += m
            each = min(room // length, count)
            if (full := min(m, count // each)) < m:
                put(room, [base + full, m - full, [(n, lo + full, o) for n, lo, o in slots]])
            slots = list(slots)
            for k in range(each):
                slots.append((length, self.take(length, full), self.capacity - room + k * length))
            put(room - each * length, [base, full, slots])
        for groups in open_.values():
            for base, m, slots in groups:
                self.slots += [(n, lo, lo + m, base, o) for n, lo, o in slots]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cuts = scratch.table(pieces(docs, path, capacity, with_ids), "pieces")
    tasks = scratch.table(cuts.groupBy("task", "length").agg(F.count("*").alias("k")), "tasks")
    plan = Plan({r[0]: r[1] for r in tasks.groupBy("length").agg(F.sum("k")).collect()}, capacity)  # a row for each length
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(slots)  # grows with the number of lengths, not of documents
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("task", "length", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    ranked = cuts.join(base, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("base")).drop("base", "task")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def make():
        table = sent.value
        span = table[:, 2].max(initial=0) + 1
        keys = table[:, 0] * span + table[:, 1]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nth = batch.column("nth").to_numpy()
            row = table[np.searchsorted(keys, batch.column("length").to_numpy() * span + nth, side="right") - 1]
            out = [batch.column(n) for n in names] + [pa.array(row[:, 3] + nth - row[:, 1]), pa.array(row[:, 4])]
            more = ["ids"] * with_ids
            return pa.RecordBatch.from_arrays(out + [batch.column(n) for n in more], names=[*names, "sequence_id", "offset", *more])

        return each

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return map_rows(ranked, make, schema, 8192)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids in order, of pack(..., with_ids=True); a sequence never holds more than its capacity."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return rows.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
