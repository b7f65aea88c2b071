"""Token counts that follow edits.

A document's pre-tokens (the pieces that the byte-level vocabulary encodes one by one) are the leaves of a segment tree
over blocks of `BLOCK` of them; nodes hold sums of characters and tokens. An edit finds its block by characters, splits
anew from the first pre-token that the changed characters could have influenced (`CONTEXT` characters of look-ahead) until
a boundary falls on an old one behind the edit, and updates the sums on the way to the root. All else keeps its counts.
A tree is stored as two arrays, characters and tokens of each pre-token, beside the text.

Defined cases: a null text is empty and has no pre-token; null or missing edits leave a document as it is; start and stop
are clamped to the text, a stop before the start is an insertion, null bounds are 0 and a null replacement is empty;
edits apply in the array's order, each to the text the one before left; a null doc_id is kept; rows that repeat are
treated alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows
from .packing import SPECIAL, encoding, read_ranks
from .pieces import Memo

BLOCK = 32
CONTEXT = 16  # more than an added token has characters
PATTERN = regex.compile(public_tokenizers.PATTERN)
ADDED = "|".join(map(regex.escape, SPECIAL))
#: PATTERN for texts with added tokens, which end whatever stands before them as the end of the text would.
AROUND = regex.compile(rf"{ADDED}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{ADDED})[^\s\p{{L}}\p{{N}}])+|\s+(?={ADDED})|\s+(?!\S)|\s+")
REMEMBERED_CHARS = 64


class Counter:
    """Tokens of a pre-token; short ones are remembered."""

    def __init__(self, ranks: bytes):
        self.encode = encoding(ranks).encode_ordinary
        self.memo = Memo(lambda t: 1 if t in SPECIAL else len(self.encode(t)))

    def __call__(self, part: str) -> int:
        return self.memo[part] if len(part) <= REMEMBERED_CHARS else len(self.encode(part))


class TokenTree:
    """Blocks of pre-tokens under a segment tree of (characters, tokens)."""

    def __init__(self, parts: list[str], counts: list[int], counter: Counter):
        self.counter, self.encoded = counter, 0
        self.build([(parts[k : k + BLOCK], counts[k : k + BLOCK]) for k in range(0, len(parts), BLOCK)])

    def build(self, blocks: list[tuple[list[str], list[int]]]) -> None:
        self.blocks = blocks or [([], [])]
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * 2 * self.leaves, [0] * 2 * self.leaves
        for k, (parts, counts) in enumerate(self.blocks):
            self.chars[self.leaves + k], self.tokens[self.leaves + k] = sum(map(len, parts)), sum(counts)
        for k in range(self.leaves - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def update(self, block: int) -> None:
        k = self.leaves + block
        self.chars[k], self.tokens[k] = sum(map(len, self.blocks[block][0])), sum(self.blocks[block][1])
        while k := k // 2:
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, char: int) -> tuple[int, int]:
        """The block that holds a character (the last one for the end of the text), and where it begins."""
        if char >= self.chars[1]:
            last = len(self.blocks) - 1
            return last, self.chars[1] - self.chars[self.leaves + last]
        k, start = 1, 0
        while k < self.leaves:
            k *= 2
            if char >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.leaves, start

    @property
    def count(self) -> int:
        return self.tokens[1]

    def parts(self) -> list[str]:
        return [p for parts, _ in self.blocks for p in parts]

    def text(self) -> str:
        return "".join(self.parts())

    def edit(self, start: int, stop: int, new: str) -> None:
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        first, at = self.find(max(0, start - CONTEXT))
        last, end = self.find(min(size, stop + CONTEXT))
        end += self.chars[self.leaves + last]
        while True:
            old = [p for parts, _ in self.blocks[first : last + 1] for p in parts]
            counts = [c for _, n in self.blocks[first : last + 1] for c in n]
            found = self.resplit(old, counts, start - at, stop - at, new, end == size)
            if found:
                break
            last += 1
            end += self.chars[self.leaves + last]
        parts, counts = found
        if len(parts) <= 4 * BLOCK:
            for k in range(first, last + 1):
                self.blocks[k] = (parts, counts) if k == first else ([], [])
                self.update(k)
        else:
            cut = [(parts[k : k + BLOCK], counts[k : k + BLOCK]) for k in range(0, len(parts), BLOCK)]
            self.build([b for b in (*self.blocks[:first], *cut, *self.blocks[last + 1 :]) if b[0]])

    def resplit(self, old: list[str], counts: list[int], start: int, stop: int, new: str, at_end: bool):
        """Parts and counts of the blocks' text after the edit, or None if more text behind it is needed."""
        keep, at = 0, 0
        while keep < len(old) and at + len(old[keep]) + CONTEXT <= start:
            at += len(old[keep])
            keep += 1
        tail = "".join(old[keep:])
        text = tail[: start - at] + new + tail[stop - at :]
        bounds, pos = {}, at  # old boundaries behind the edit, in the new text, and the pre-token that starts there
        shift = len(new) - (stop - start)
        for k in range(keep, len(old)):
            if pos >= stop:
                bounds[pos - at + shift] = k
            pos += len(old[k])
        parts, n, here = old[:keep], counts[:keep], 0
        for m in pattern(text).finditer(text):
            if here in bounds and here >= start - at + len(new):
                k = bounds[here]
                return parts + old[k:], n + counts[k:]
            if not at_end and m.end() + CONTEXT > len(text):
                return None
            parts.append(m[0])
            n.append(self.counter(m[0]))
            self.encoded += 1
            here = m.end()
        return (parts, n) if at_end else None


def pattern(text: str) -> regex.Pattern:
    return AROUND if any(t in text for t in SPECIAL) else PATTERN


def split(text: str | None) -> list[str]:
    return pattern(text or "").findall(text or "")


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, chars array, tokens array: the leaves of every document's tree."""
    ranks = read_ranks(docs.sparkSession, path)

    def make():
        counter = Counter(ranks.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [split(t) for t in batch.column(1).to_pylist()]
            chars = pa.array([[len(p) for p in x] for x in parts], pa.list_(pa.int32()))
            tokens = pa.array([[counter(p) for p in x] for x in parts], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), chars, tokens], names=["doc_id", "text", "chars", "tokens"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, text string, chars array<int>, tokens array<int>")


def apply_edits(kept: DataFrame, path: str | None = None, with_text: bool = True) -> DataFrame:
    """Trees with a column edits, array of (start int, stop int, new string): doc_id, the tree after the edits, n_tokens
    before, n_tokens_edited, n_pretokens, n_reencoded. Without with_text only the numbers."""
    ranks = read_ranks(kept.sparkSession, path)
    numbers = "n_pretokens long, n_tokens long, n_tokens_edited long, n_reencoded long"

    def make():
        counter = Counter(ranks.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[] for _ in range(7)]
            for text, chars, tokens, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "chars", "tokens", "edits")), strict=True):
                parts, at = [], 0
                for n in chars or ():
                    parts.append(text[at : at + n])
                    at += n
                tree = TokenTree(parts, tokens or [], counter)
                before = tree.count
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                row = (len(parts), before, tree.count, tree.encoded)
                if with_text:
                    row += (tree.text(), [len(p) for p in tree.parts()], [c for _, n in tree.blocks for c in n])
                for o, x in zip(out, row, strict=False):
                    o.append(x)
            kinds = (pa.int64(),) * 4 + ((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())) if with_text else ())
            names = ["n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded", "text", "chars", "tokens"]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=False))], names=["doc_id", *names[: len(kinds)]])

        return each

    schema = f"doc_id long, {numbers}" + ", text string, chars array<int>, tokens array<int>" * with_text
    return map_rows(kept.select("doc_id", "text", "chars", "tokens", "edits"), make, schema)


def redactions(kept: DataFrame) -> DataFrame:
    """Three edits a document: a heading put in front, twelve characters in the middle blacked out, the last one dropped."""
    n = F.length(F.coalesce("text", F.lit("")))
    one = lambda start, stop, new: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(new).alias("new"))
    middle = F.floor((n + 8) / 2)
    return kept.withColumn("edits", F.array(one(F.lit(0), F.lit(0), "[copy] \n"), one(middle, middle + 12, "[...]"), one(F.lit(1 << 30), F.lit(1 << 30), " (end)")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_edits(redactions(trees(spark.read.parquet(f"{sf_dir}/documents.parquet"))), with_text=False)
