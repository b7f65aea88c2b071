"""Substring dedup by recompression of the token sequence.

Words are `[^\\x20\\x09-\\x0D]+`. A window is 50 consecutive words of one document; a word goes if a window covers it whose
word sequence also starts in a document with a smaller doc_id.

Recompression: rounds name maximal runs of one symbol and pairs of a "left" and a "right" symbol, which side a symbol is
on being a bit of its name. Names are 64-bit fingerprints of what they stand for, so all tasks give equal content equal
names without a shared dictionary, and the rounds run in one pass over a document. Each symbol carries its context: the
words that decided that it was formed. Wherever these words recur, the symbol recurs. A window owns the symbols whose
context starts in its first 50 - CONTEXT + 1 words; the longest one it owns (smallest name, then first) is its anchor, so
equal windows have equal anchors, and a word by itself is a symbol of level 0, so each window has one.

1. Each stretch of windows with one anchor gives a row. Its name is that of the CONTEXT words from the start of the anchor's
   context, which the windows hold.
2. Names that only one document has go. The texts of what stays, each once, give the stretches' forms: hashes of all their
   words. Among stretches of one name and form all but those in the smallest doc_id are repeats; copies are never expanded
   into pairs.
3. Stretches whose name has several forms are compared window by window, (name, window hash) against the smallest doc_id.

Names only bring candidates together, so that two contents might share one without harm. What decides is the 128-bit
BLAKE2 hash, under a key drawn for each run, of the words themselves, joined by single spaces.

Defined cases: null, empty and short texts have no window and stay whole; a row with null doc_id neither removes nor
loses words; rows that share a doc_id don't remove from each other, and rows equal in doc_id and text share their fate (they
are judged once); an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh_names, map_rows, raw, replace_column

WINDOW = 50
CONTEXT = 20
ROUNDS = 3
CHUNK = 1 << 19
FAR = 1 << 40
FEW = 500_000  # keys, of 16 bytes each, up to which they are broadcast

BASE, BASE2 = 0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B
SEED = 42  # that of Spark's xxhash64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i from 0 to n at least."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[base] = tuple(both)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hash(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of elements start..end-1, alike wherever they stand; prefix[i] sums value * base ** position below i."""
    return mix((prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start] + (end - start).astype(np.uint64))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


name = xxhash.xxh3_64_intdigest  # of a word; not more than a name, see above


class Words:
    """Keyed hashes of a text's words from one to another."""

    def __init__(self, text: bytes):
        words = text.split()
        self.joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size

    def digests(self, first: np.ndarray, n: np.ndarray, key: bytes) -> np.ndarray:
        """Rows of two 64-bit halves: the hash of the n words from `first` on."""
        joined, made = self.joined, []
        for a, b in zip(self.starts[first].tolist(), self.ends[first + n - 1].tolist(), strict=True):
            made.append(hashlib.blake2b(joined[a:b], digest_size=16, key=key).digest())
        return np.frombuffer(b"".join(made), "<i8").reshape(-1, 2)


def parse(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context start, rank) of all symbols whose context spans CONTEXT words at most; first marks documents' first words.

    The smallest rank is that of the longest symbol; of equally long ones, that of the smallest name.
    """
    name = words.copy()
    left = np.arange(len(words), dtype=np.int64)
    right = left + 1
    length = np.ones(len(words), np.int64)

    def rank(name: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (name >> np.uint64(4)) | (np.uint64(15) - np.minimum(length, 15).astype(np.uint64) << np.uint64(60))

    at, out = [left], [rank(name, length)]
    for level in range(1, ROUNDS + 1):
        # runs: the next symbol on either side decides where a run ends
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]] | first)
        end = np.r_[start[1:], len(name)]
        size = end - start
        name = np.where(size > 1, mix(name[start] * np.uint64(BASE2) + size.astype(np.uint64)), name[start])
        head, before, after = first[start], start - 1, np.minimum(end, len(first) - 1)
        last = np.r_[head[1:], True]
        l0 = np.minimum(np.where(head, -FAR, left[before]), np.where(last, FAR, left[after]))
        r0 = np.maximum(np.where(head, -FAR, right[before]), np.where(last, FAR, right[after]))
        left, right = np.minimum(l0, np.minimum.reduceat(left, start)), np.maximum(r0, np.maximum.reduceat(right, start))
        first, length = head, np.add.reduceat(length, start)
        # pairs of a left and a right symbol; a symbol without partner depends on the neighbour that might have been one
        side = (mix(name + np.uint64(level)) >> np.uint64(17)) & np.uint64(1)
        opens = side == 0
        pair = opens & np.r_[~opens[1:], False] & ~last
        second = np.r_[False, pair[:-1]]
        to_next, to_prev = opens & ~last, ~opens & ~first
        edge = (opens & last) | (~opens & first)
        nl, nr, pl, pr = np.r_[left[1:], FAR], np.r_[right[1:], -FAR], np.r_[FAR, left[:-1]], np.r_[-FAR, right[:-1]]
        l1 = np.where(edge, -FAR, np.minimum(left, np.where(to_next, nl, np.where(to_prev, pl, left))))
        r1 = np.where(edge, FAR, np.maximum(right, np.where(to_next, nr, np.where(to_prev, pr, right))))
        joined = np.where(pair, mix(mix(name) + np.r_[name[1:], np.uint64(0)] * np.uint64(BASE)), name)
        length = length + np.where(pair, np.r_[length[1:], 0], 0)
        keep = ~second
        name, left, right, first, length = joined[keep], l1[keep], r1[keep], first[keep], length[keep]
        ok = right - left <= CONTEXT
        at.append(left[ok])
        out.append(rank(name[ok], length[ok]))
    return np.concatenate(at), np.concatenate(out)


def anchors(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: first window, number of windows, anchor's name."""
    total, reach = len(words), WINDOW - CONTEXT + 1
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(total, bool)
    first[starts[sizes > 0]] = True
    at, rank = parse(words, first)
    best = np.full(total, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(best, at, rank)
    index, width = np.arange(total), 1
    while width < reach:  # leftmost smallest of ever wider spans
        step = min(width, reach - width)
        other = np.r_[index[step:], np.full(step, total - 1)]
        index = np.where(best[other] < best[index], other, index)
        width += step
    ok = np.zeros(total, bool)
    for s, n in zip(starts[sizes >= WINDOW], sizes[sizes >= WINDOW], strict=True):
        ok[s : s + n - WINDOW + 1] = True
    window = np.flatnonzero(ok)
    if not len(window):
        return window, window, best[:0]
    cut = np.flatnonzero(np.r_[True, (index[window[1:]] != index[window[:-1]]) | (np.diff(window) != 1)])
    at = index[window[cut]]
    return window[cut], np.diff(np.r_[cut, len(window)]), span_hash(prefix_sums(words, BASE), BASE, at, at + CONTEXT)


def chunks(texts: list[bytes]):
    """(from, to) so that the texts between hold about CHUNK bytes."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _check(text: bytes) -> int:
    """Tells texts of one doc_id apart, as xxhash64 does in Spark."""
    found = xxhash.xxh64_intdigest(text, SEED)
    return found - (found >> 63 << 64)


def _rows(parts: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*parts, strict=True), fields.values(), strict=True)] if parts else [pa.array([], k) for k in fields.values()]
    return pa.RecordBatch.from_arrays(columns, names=list(fields))


STRETCH = {"doc_id": pa.int64(), "chk": pa.int64(), "p": pa.int32(), "n": pa.int32(), "name": pa.int64()}
FORM = STRETCH | {"f1": pa.int64(), "f2": pa.int64()}
LOOKED = {"doc_id": pa.int64(), "chk": pa.int64(), "p": pa.int32(), "name": pa.int64(), "f1": pa.int64(), "f2": pa.int64()}


def _stretches():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(d, t) for d, t in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True) if d is not None and t and len(t) >= 2 * WINDOW - 1]
        out = []
        for a, b in chunks([t for _, t in pairs]):
            split = [t.split() for _, t in pairs[a:b]]
            sizes = np.array([len(words) for words in split], np.int64)
            names = np.fromiter(map(name, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
            if len(names) < WINDOW:
                continue
            p, n, found = anchors(names, sizes)
            starts = np.cumsum(sizes) - sizes
            doc = np.searchsorted(starts + sizes, p, side="right")
            out.append((np.array([d for d, _ in pairs[a:b]])[doc], np.array([_check(t) for _, t in pairs[a:b]])[doc], p - starts[doc], n, found.view(np.int64)))
        return _rows(out, STRETCH)

    return each


def _forms(key: bytes):
    """Rows (doc_id, chk, text, spans): each span with the hash of its words."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, chk, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            p, n, names = (np.array([s[k] for s in spans], np.int64) for k in ("p", "n", "name"))
            form = Words(text).digests(p, n + WINDOW - 1, key)
            out.append((np.full(len(p), doc), np.full(len(p), chk), p, n, names, form[:, 0], form[:, 1]))
        return _rows(out, FORM)

    return each


def _windows(key: bytes):
    """Rows (doc_id, chk, text, spans): each window of the spans, with its hash."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, chk, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            n = np.array([s["n"] for s in spans])
            p = np.repeat(np.array([s["p"] for s in spans]) - (np.cumsum(n) - n), n) + np.arange(n.sum())
            form = Words(text).digests(p, np.full(len(p), WINDOW), key)
            out.append((np.full(len(p), doc), np.full(len(p), chk), p, np.repeat(np.array([s["name"] for s in spans], np.int64), n), form[:, 0], form[:, 1]))
        return _rows(out, LOOKED)

    return each


def _schema(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {'int' if kind == pa.int32() else 'long'}" for name, kind in fields.items())


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, chk, spans array of (p, n)): the windows p..p+n-1 that start in a smaller doc_id too. chk tells texts of one doc_id apart."""
    scratch, key = Scratch(docs.sparkSession, "substrings"), secrets.token_bytes(16)
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    every = scratch.table(map_rows(given, _stretches, _schema(STRETCH)), "every")
    # small sides are written, so that both sides of each join are dealt by its key alone and the plan may split a hot one
    shared = scratch.table(every.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("name"), "shared")
    some = every.join(shared, "name", "left_semi").groupBy("doc_id", "chk").agg(F.collect_set(F.struct("p", "n", "name")).alias("spans"))
    some = scratch.table(some, "some")
    scratch.drop("every", "shared")
    held = matched(given.withColumn("chk", F.xxhash64("text")), some, ["doc_id", "chk"], scratch, "held_ids").dropDuplicates(["doc_id", "chk"])
    held = scratch.table(held.select("doc_id", "chk", "text", "spans"), "held")
    formed = scratch.table(map_rows(held, lambda: _forms(key), _schema(FORM)), "formed")
    forms = scratch.table(formed.groupBy("name", "f1", "f2").agg(F.min("doc_id").alias("low")), "forms")
    many = scratch.table(forms.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name"), "many")
    placed = scratch.table(formed.join(forms, ["name", "f1", "f2"]).select("doc_id", "chk", "p", "n", "name", "low"), "placed")
    scratch.drop("some", "formed")
    open_ = placed.where("low = doc_id").join(many, "name", "left_semi").groupBy("doc_id", "chk").agg(F.collect_list(F.struct("p", "n", "name")).alias("spans"))
    texts = held.select("doc_id", "chk", "text").join(scratch.table(open_, "open"), ["doc_id", "chk"])
    looked = scratch.table(map_rows(texts, lambda: _windows(key), _schema(LOOKED)), "looked")
    least = scratch.table(looked.groupBy("name", "f1", "f2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name", "f1", "f2", "low"), "least")
    single = looked.join(least, ["name", "f1", "f2"]).where("low < doc_id").select("doc_id", "chk", "p", F.lit(1).alias("n"))
    whole = placed.where("low < doc_id").select("doc_id", "chk", "p", "n")
    spans = scratch.table(whole.union(single).groupBy("doc_id", "chk").agg(F.collect_set(F.struct("p", "n")).alias("spans")), "spans")
    scratch.drop("held", "held_ids", "forms", "many", "placed", "open", "looked", "least")
    return spans


def matched(texts: DataFrame, found: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """texts joined with `found`, a written table. If that has few rows, their keys go to the texts, and only texts that match are moved."""
    if found.count() <= FEW:
        texts = texts.join(F.broadcast(scratch.table(found.select(*keys), name)), keys, "left_semi")
    return texts.join(found, keys)


def covered(n_words: int, spans: list[dict] | None) -> np.ndarray:
    """Which words the windows of the spans cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        edge[s["p"]] += 1
        edge[s["p"] + s["n"] + WINDOW - 1] -= 1
    return np.cumsum(edge)[:n_words] > 0


def _judged(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of spans. If few texts have any, only these are moved to meet them."""
    scratch = Scratch(docs.sparkSession, "spans")
    name, doc, chk = fresh_names(docs, "repeat_spans", "repeat_doc", "repeat_chk")
    found = repeats(docs).select(F.col("doc_id").alias(doc), F.col("chk").alias(chk), F.col("spans").alias(name))
    on = (docs["doc_id"] == F.col(doc)) & (F.xxhash64(docs["text"].cast("string")) == F.col(chk))
    if found.count() > FEW:
        return docs.join(found, on, "left").drop(doc, chk), name
    ids = F.broadcast(scratch.table(found.select(doc, chk), "ids"))
    plain = docs.join(ids, on, "left_anti").withColumn(name, F.lit(None).cast(found.schema[name].dataType))
    return plain.union(docs.join(ids, on, "left_semi").join(found, on).drop(doc, chk)), name


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs without the repeated words; a text that loses some has the rest joined by single spaces. Every row stays."""
    judged, name = _judged(docs)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t, spans in zip(raw(batch.column("text")), batch.column(name).to_pylist(), strict=True):
                if spans:
                    words = t.split()
                    t = b" ".join(compress(words, (~covered(len(words), spans)).tolist()))
                out.append(t)
            return replace_column(batch, "text", pa.array(out, pa.binary()).cast(pa.string()), (name,))

        return each

    return map_rows(judged, make, docs.schema)


def substring_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    judged, name = _judged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, gone, sha = [], [], []
            for t, spans in zip(raw(batch.column("text")), batch.column(name).to_pylist(), strict=True):
                words = (t or b"").split()
                total.append(len(words))
                if spans:
                    words = list(compress(words, (~covered(len(words), spans)).tolist()))
                gone.append(total[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

        return each

    return map_rows(judged, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM split WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
hit AS (SELECT doc_id, p FROM windows JOIN low USING (h) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""
