"""Spelling variants: words one inserted, deleted or replaced code point apart, grouped under their most frequent form.

Rolling-hash deletions: a word of n code points has n strings that lack one of them. Prefix and suffix sums of a polynomial
hash modulo 2^64 give the hashes of all of these at once, as integers, whatever the word's length. Two words of one length are
near if they agree without the same place; two of lengths n and n + 1 if the longer one without some place is the shorter.
So the keys are (hash, place, length) for replacements, and hashes of deletions beside hashes of whole words for the rest.
Keys are dealt by their leading bits and sorted; only groups of two words and more go on, get their strings, and are
verified on these, so that a collision costs time but links nothing.

No pairs are made: words that agree but for one place are all near to each other, so a group's size and its two best
words say all of its members; a whole word and those that have it as a deletion likewise. A group has at most a word
for each code point of the alphabet (and place, for deletions), however frequent the words; counts are added up before
they are shuffled. Forms have more occurrences than their words, so following them ends; roots are found by doubling the steps.

Defined cases: a null text has no words; a row without doc_id loses no code points; rows that repeat count each; an empty table
gives an empty result; other columns are ignored; words of any length are whole words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare, raw

LETTERS = r"[A-Za-zÀ-ÿ]"
SPOILED = 199  # of so many occurrences one loses a code point
CHARS = 6
TIMES = 5
RATIO = 5
HELD = 200_000  # distinct words of a task that are counted before they are sent on
WHOLE, DELETED = -1, -2  # places of a key that isn't of a replacement
SLICE = 1 << 16  # keys in a batch
RADIX = 20  # leading bits of a key by which it is dealt
BASE, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words over a task's texts, sent on when there are many."""
    find = re.compile(f"{LETTERS}{{{CHARS},}}").findall

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            for word, n in Counter(find(text.lower().decode())).items() if text else ():  # bytes.lower() is ASCII only
                if doc is not None and (h := zlib.crc32(f"{doc}:{word}".encode())) % SPOILED == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= CHARS:
                    held[word] += n
            if len(held) >= HELD:
                yield rows(held)
                held.clear()
    if held:
        yield rows(held)


def words(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n long: the distinct words of CHARS code points and `times` occurrences."""
    prepare(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_runs, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads hashes over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length, a row of code points each: hashes of the whole words, and of what is left without each place."""
    n = points.shape[1]
    power, c = _powers(n), points.astype(np.uint64) * np.uint64(START) ^ (points.astype(np.uint64) << np.uint64(7))
    whole = c * power[::-1]  # the code point at place j counts power n - 1 - j
    after = np.zeros_like(c)  # those behind the place keep their powers
    after[:, :-1] = np.cumsum(whole[:, :0:-1], axis=1, dtype=np.uint64)[:, ::-1]
    before = np.zeros_like(c)  # those before it lose one
    if n > 1:
        before[:, 1:] = np.cumsum(c[:, :-1] * power[: n - 1][::-1], axis=1, dtype=np.uint64)
    return whole.sum(axis=1, dtype=np.uint64), before + after


def keys(ids: np.ndarray, found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, place, id) of words: place of the replacement, WHOLE or DELETED."""
    sizes = np.array(list(map(len, found)))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for part in np.array_split(at, max(1, len(at) * int(n) // SLICE)):
            points = np.frombuffer("".join(found[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), n)
            whole, less = hashes(points)
            own, place = ids[part], np.arange(n)
            yield mixed(whole + np.uint64(START)), np.full(len(part), WHOLE), own
            yield mixed(less + mixed(place.astype(np.uint64) * np.uint64(BASE) + np.uint64(n))[None, :]).ravel(), np.tile(place, len(part)), np.repeat(own, n)
            # a code point that stands twice in a row gives one string without it
            fresh = np.ones(points.shape, bool)
            fresh[:, 1:] = points[:, 1:] != points[:, :-1]
            yield mixed(less + np.uint64(START))[fresh], np.full(int(fresh.sum()), DELETED), np.repeat(own, fresh.sum(axis=1))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for columns in keys(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
            for at in range(0, len(columns[0]), SLICE):
                key, place, own = (x[at : at + SLICE] for x in columns)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(own)], names=["key", "place", "id"])


def _whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches anew, none of which ends within a run of equal values of `by`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(by).to_numpy()
        cut = int(np.searchsorted(values, values[-1])) if values[0] != values[-1] else 0
        if cut or held and held[-1].column(by)[-1].as_py() != values[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys sorted by key and place: those of groups of two words and more; a deletion must be a whole word."""
    for batch in _whole_groups(batches, "key"):
        key, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        kind = np.where(place < 0, WHOLE, place)  # whole words and deletions meet
        start = np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]
        group = np.cumsum(start) - 1
        size = np.bincount(group)
        keep = size[group] > 1
        wholes = np.bincount(group, weights=place == WHOLE)
        keep &= (place >= 0) | (wholes[group] > 0)
        yield batch.filter(pa.array(keep))


def _best(found: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The two best of (n, word, id): most occurrences, then the smaller word."""
    return sorted(found, key=lambda x: (-x[0], x[1]))[:2]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups with their strings: (id, n_near, best n, best word) for each word that has others near it there."""
    for batch in _whole_groups(batches, "key"):
        groups: dict[tuple, list[tuple[int, str, int]]] = {}
        wholes: dict[int, list[tuple[int, str, int]]] = {}
        longer: list[tuple[int, tuple[int, str, int]]] = []
        for key, place, own, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place >= 0:
                groups.setdefault((key, place, word[:place], word[place + 1 :]), []).append((n, word, own))
            elif place == WHOLE:
                wholes.setdefault(key, []).append((n, word, own))
            else:
                longer.append((key, (n, word, own)))
        out: list[tuple[int, int, int, str]] = []
        for members in groups.values():
            if len(members) > 1:
                best, second = _best(members)
                out += [(own, len(members) - 1, *(second if own == best[2] else best)[:2]) for _, _, own in members]
        above: dict[tuple[int, str, int], list[tuple[int, str, int]]] = {}
        for key, member in longer:
            for whole in wholes.get(key, ()):
                if one_less(member[1], whole[1]):
                    above.setdefault(whole, []).append(member)
                    out.append((member[2], 1, *whole[:2]))
        out += [(whole[2], len(members), *_best(members)[0][:2]) for whole, members in above.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "n_near", "n", "word"])


def one_less(longer: str, word: str) -> bool:
    """Whether `word` is `longer` without one code point."""
    if len(longer) != len(word) + 1:
        return False
    low, high = 0, len(word)
    while low < high:  # the length of their common start
        mid = (low + high + 1) // 2
        if longer[low:mid] == word[low:mid]:
            low = mid
        else:
            high = mid - 1
    return longer[low + 1 :] == word[low:]


def near_words(found: DataFrame, scratch: Scratch) -> DataFrame:
    """id, n_near, best struct(lost, word): of `found` (id, word, n), what words with others near them have; lost is -n."""
    radix = F.shiftrightunsigned("key", 64 - RADIX)
    ordered = lambda df: df.repartition(radix).sortWithinPartitions("key", "place")
    shared = scratch.table(ordered(found.select("id", "word").mapInArrow(_keys, "key long, place int, id long")).mapInArrow(_shared, "key long, place int, id long"), "shared")
    named = shared.join(found, "id").select("key", "place", "id", "word", "n")
    near = ordered(named).mapInArrow(_judged, "id long, n_near long, n long, word string")
    return near.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("lost"), "word")).alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of (word, form): where following forms ends. Each round doubles the steps that a row has gone."""
    now = scratch.table(forms.select("word", F.col("form").alias("root")), "steps0")
    turn = 0
    while True:
        turn += 1
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = scratch.table(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"steps{turn}")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    scratch = Scratch(docs.sparkSession, "variants")
    found = scratch.table(words(docs, times).withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"), "words")
    near = near_words(found, scratch).withColumnRenamed("word", "near_word")
    judged = found.join(near, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.lost")).alias("form_n"))
    wins = F.col("form_n") >= F.lit(ratio) * F.col("n")
    judged = scratch.table(judged.select("word", "n", "n_near", F.when(wins, F.col("form")).alias("form"), F.when(wins, F.col("form_n")).alias("form_n")), "judged")
    ends = roots(judged.where("form IS NOT NULL"), scratch)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
