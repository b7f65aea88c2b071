"""Product codes of vectors: eight parts, each named by the nearest of sixteen integer entries.

Components become integers, floor(`SCALE` * x). A part position's codebook starts as that part of the 16 smallest vec_ids; each of
`ROUNDS` rounds assigns every part to its nearest entry (squared distance, ties to the lower index) and moves entries to the
componentwise floor of their parts' mean; unused entries stay. Then parts are assigned once more.

Nearest entries by segment means: cut into blocks of w components, two parts are at least as far apart as
sum((block sums' difference)^2 / w) + (norm of one's residual - norm of the other's)^2, the residual being what the block
means leave. Bounds go from one block a part to blocks of two components; an entry whose bound is above the exact distance
of the best guess falls out, and what is left gets exact integer distances. Bounds are lowered by more than their rounding, so no
nearest entry is lost. A round moves, for each task, the counts and sums of its 128 entries and nothing else.

Defined cases: a vector that is null, or holds a null, NaN or what isn't finite as a 32-bit float, is dropped, as are
vectors of another length than that of the smallest vec_id (or of a length that eight doesn't divide); a row without vec_id
takes part but starts no entry; rows sharing a vec_id count each, by vec_id and then by components; fewer than 16 rows
give fewer entries; an empty table gives an empty result; other columns are ignored. Integers are exact however large (Python's own where 64 bits can't hold
a distance); an error beyond a long counts as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_rows, prepare

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
SLICE = 4096  # vectors compared at once
LIMB = 60  # bits of a sum that go in one column
LARGEST = 2**63 - 1
SUMS = "part int, entry int, place int, n long, low decimal(38,0), mid decimal(38,0), high decimal(38,0)"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python integers if distances could pass 64 bits."""
    y = np.floor(x.astype(np.float64) * SCALE)
    if not y.size or np.abs(y).max() < 2.0**29 and x.shape[-1] <= 64 * PARTS:
        return y.astype(np.int64)
    return np.array([[int(v) for v in row] for row in y], object).reshape(y.shape)


def _blocks(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Of parts (..., size): sums of blocks of w components as doubles, and the norm of what the blocks' means leave."""
    y = x.astype(np.float64).reshape(*x.shape[:-1], -1, w)
    sums = y.sum(axis=-1)
    rest = y - (sums / w)[..., None]
    return sums, np.sqrt((rest * rest).sum(axis=(-1, -2)))


def widths(size: int) -> list[int]:
    """Block widths from coarse to fine: the whole part, then halves down to two components."""
    out = [size]
    while out[-1] % 2 == 0 and out[-1] > 2:
        out.append(out[-1] // 2)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of parts x (n, size) and entries (k, size), integers: index of the nearest entry, its squared distance, and how many exact distances were taken."""
    n, k = len(x), len(book)
    exact = lambda rows, entries: ((x[rows] - book[entries]) ** 2).sum(axis=1)
    live, guess, best, taken = np.ones((n, k), bool), None, None, n
    # far above what rounding can add to a bound: 2^-40 of the squares that enter it
    scale = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] + (book.astype(np.float64) ** 2).sum(axis=1)[None, :]
    for w in widths(x.shape[1]):
        a, ra = _blocks(x, w)
        b, rb = _blocks(book, w)
        bound = (ra[:, None] - rb[None, :]) ** 2
        for block in range(a.shape[1]):
            bound += (a[:, block][:, None] - b[:, block][None, :]) ** 2 / w
        bound -= scale * 2.0**-40
        if guess is None:
            guess = bound.argmin(axis=1)
            best = exact(np.arange(n), guess)
            ceiling = best.astype(np.float64) * (1 + 2.0**-40)
        live &= bound <= ceiling[:, None]
    code = guess.copy()
    live[np.arange(n), guess] = False
    rows, entries = np.nonzero(live)
    if len(rows):
        taken += len(rows)
        found = exact(rows, entries)
        order = np.lexsort((entries, found, rows)) if found.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], found[i], entries[i])))
        rows, entries, found = rows[order], entries[order], found[order]
        first = np.r_[True, rows[1:] != rows[:-1]]
        rows, entries, found = rows[first], entries[first], found[first]
        better = (found < best[rows]) | (found == best[rows]) & (entries < code[rows])
        code[rows[better]], best[rows[better]] = entries[better], found[better]
    return code, best, taken


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Slices (n, PARTS, size) of integers."""
    for at in range(0, batch.num_rows, SLICE):
        x = integers(_vectors(batch.slice(at, SLICE), "vector"))
        yield x.reshape(len(x), PARTS, -1)


def _books(book: list) -> np.ndarray:
    """(PARTS, entries, size) of a codebook of Python integers."""
    small = max((abs(v) for part in book for entry in part for v in entry), default=0) < 2**29
    return np.array(book, np.int64 if small else object)


def _of_one_kind(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x.astype(object), book.astype(object)) if object in (x.dtype, book.dtype) else (x, book)


def _sums(book: list):
    """A row for each part, entry and place that the task's vectors use: how many, and their sum in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _books(book)
        size = entries.shape[2]
        counts, sums = np.zeros(entries.shape[:2], np.int64), np.zeros(entries.shape, object)
        for batch in batches:
            for whole in _parts(batch):
                for p in range(PARTS):
                    x, b = _of_one_kind(whole[:, p], entries[p])
                    code = nearest(x, b)[0]
                    counts[p] += np.bincount(code, minlength=len(b))
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order], first, axis=0).astype(object)  # below 2^63: SLICE values of 2^29 at most
        rows = [(p, e, k, int(counts[p, e]), int(sums[p, e, k])) for p, e in zip(*np.nonzero(counts), strict=True) for k in range(size)]
        mask, whole_numbers = (1 << LIMB) - 1, lambda values: pa.array(values, pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([r[c] for r in rows], pa.int32()) for c in range(3)), pa.array([r[3] for r in rows], pa.int64()),
             whole_numbers([r[4] & mask for r in rows]), whole_numbers([r[4] >> LIMB & mask for r in rows]), whole_numbers([r[4] >> 2 * LIMB for r in rows])],
            names=["part", "entry", "place", "n", "low", "mid", "high"],
        )

    return run


def _codes(book: list):
    def make():
        entries = _books(book)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, errors = [], []
            for whole in _parts(batch):
                code, error = np.empty((len(whole), PARTS), np.uint8), np.zeros(len(whole), object)
                for p in range(PARTS):
                    code[:, p], far, _ = nearest(*_of_one_kind(whole[:, p], entries[p]))
                    error += far.astype(object)
                codes += [row.tobytes().hex() for row in code]
                errors += [min(int(e), LARGEST) for e in error]
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

        return each

    return make


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id long, label, vector array of float: the rows that take part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    found = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col(vector).cast("array<float>").alias("vector"))
    return found.where(F.col("vector").isNotNull() & F.forall("vector", good) & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))


def first_books(rows: DataFrame) -> list:
    """The parts of the first `ENTRIES` vectors, and with them the length that counts."""
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(ENTRIES).select("vector").collect()
    whole = [r[0] for r in first if len(r[0]) == len(first[0][0])]
    if not whole:
        return []
    return [[[int(v) for v in integers(np.array([x], np.float32))[0].reshape(PARTS, -1)[p]] for x in whole] for p in range(PARTS)]


def train(rows: DataFrame, rounds: int = ROUNDS) -> list:
    """Codebooks by part and entry, of Python integers: bounded by ENTRIES vectors."""
    prepare(rows.sparkSession)
    book = first_books(rows)
    if not book:
        return book
    rows = rows.where(F.size("vector") == PARTS * len(book[0][0]))
    for _ in range(rounds):
        moved: dict[tuple[int, int], list[tuple[int, int]]] = {}
        sums = rows.select("vector").mapInArrow(_sums(book), SUMS).groupBy("part", "entry", "place").agg(*(F.sum(c).alias(c) for c in ("n", "low", "mid", "high")))
        for r in sums.collect():  # PARTS * ENTRIES * size rows, whatever the input
            moved.setdefault((r["part"], r["entry"]), []).append((r["place"], (int(r["low"]) + (int(r["mid"]) << LIMB) + (int(r["high"]) << 2 * LIMB)) // r["n"]))
        book = [[[v for _, v in sorted(moved[p, e])] if (p, e) in moved else entry for e, entry in enumerate(part)] for p, part in enumerate(book)]
    return book


def codebooks_sha256(book: list) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for entry in part for v in entry).encode()).hexdigest()


def encode(rows: DataFrame, book: list) -> DataFrame:
    """vec_id, label, code, error of what kept() gives."""
    size = PARTS * len(book[0][0]) if book else 0
    return map_rows(rows.where(F.size("vector") == size), _codes(book), f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long", SLICE)


def vector_codes(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row that takes part."""
    scratch = Scratch(vectors.sparkSession, "vector_codes")
    rows = kept(vectors, vector)
    book = train(rows, rounds)
    coded = scratch.table(encode(rows, book), "coded")
    most = F.lit(LARGEST)
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(F.col("label").alias("of"), F.least("total", most).cast("long").alias("label_error"))
    joined = coded.join(total, coded["label"].eqNullSafe(total["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(book)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """Rounds one after the other; a codebook is (part, entry, place, c)."""
    near = """near{k} AS (
  SELECT vec_id, part, entry, dist FROM (
    SELECT vec_id, part, entry, dist, row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) AS r FROM (
      SELECT x.vec_id, x.part, b.entry, sum((x.x - b.c) * (x.x - b.c)) AS dist FROM x JOIN book{k} b USING (part, place) GROUP BY ALL)) WHERE r = 1)"""
    move = """book{n} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT x.part, near{k}.entry, x.place, sum(x.x) AS s, count(*) AS n FROM x JOIN near{k} USING (vec_id, part) GROUP BY ALL) s USING (part, entry, place))"""
    steps = [s.format(k=k, n=k + 1) for k in range(ROUNDS) for s in (near, move)] + [near.format(k=ROUNDS)]
    return f"""WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(embedding) // {PARTS}) AS part, (i - 1) % (len(embedding) // {PARTS}) AS place, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, entry, place, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{(", " + chr(10)).join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE = _oracle()
