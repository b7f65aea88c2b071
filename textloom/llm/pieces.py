"""Encoding and decoding with a SentencePiece model of the merge type, exactly.

Encoding by backtracking: an Aho-Corasick automaton gives the longest piece at a position; it may follow the piece before
if merging both their characters anew gives just these two; otherwise the next shorter piece is tried, and a position
from which nothing went on is marked as failed in a bitfield and never entered again. A sequence whose neighbours are all
compatible is the one that merging gives, so no merge of the whole text is ever run.

Texts are cut before each run of spaces and around line breaks, where no piece of the model reaches across (else not at
all); what was cut off is remembered in a table of bounded size. Characters outside the model become bytes.

Defined cases: a null text is the empty one, which has no ids; any other text gets the model's one space in front.
Other columns of the input are ignored; rows that repeat are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import groupby

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, resident

MODEL = "piece_bpe_32k.model"
NORMAL, CONTROL, BYTE = 1, 3, 6
REMEMBERED = 300_000
LONGEST = 64  # longer keys are made anew each time, which bounds what a worker remembers in bytes


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message: int, 4 or 8 raw bytes, or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Memo(dict):
    """Remembers what `make` gives for a key of up to `longest` elements: the last `limit` new keys at least, twice as many at most."""

    def __init__(self, make, limit: int = REMEMBERED, longest: int = LONGEST):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class PieceCoder:
    def __init__(self, model: bytes):
        self.pieces, self.kinds, scores, prefix = [], [], [], True
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2 and dict(fields(value)).get(3, 1) != 2:
                raise ValueError("the model isn't of the merge type")
            elif number == 3:
                spec = dict(fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only the identity normalizer that keeps white space is known")
        if not set(self.kinds) <= {1, 2, CONTROL, BYTE}:
            raise ValueError("the model has user-defined or unused pieces")
        self.space = " " if prefix else ""
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(2)
        named = {p.replace("▁", " "): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in named.items()}
        self.known = set().union(*named)
        made = [p for p in named if len(p) == 1 or self.merge(p) == [p]] + [c for c in self.known if c not in named]
        self.ids = {p: [named[p]] if p in named else self.fallback(p) for p in made}
        self.automaton = ahocorasick.Automaton()
        for p in made:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.longest = max(map(len, made))  # a step of the automaton is given no more, as it costs time in proportion to what it gets
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in made}
        self.compatible = Memo(lambda pair: self.merge(pair[0] + pair[1]) == [*pair], 1_000_000)
        apart = not any(re.search(r"[^ ] |\n", p) for p in named)
        self.cut = re.compile(r" *[^ \n]+| +|\n" if apart else r"(?s).+").findall
        self.encoded = Memo(self.encode_part)
        self.both = Memo(self.code_part, 400_000)
        self.plain = [p.replace("▁", " ") for p in self.pieces]
        self.odd = {i for i, k in enumerate(self.kinds) if k != NORMAL}

    def merge(self, text: str) -> list[str]:
        """Merging by definition: always the pair of the best score, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -float("inf"):
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fallback(self, text: str) -> list[int]:
        """Ids of what no piece has."""
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]

    def split(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all known."""
        out, at, size, failed = [], 0, len(text), bytearray((len(text) >> 3) + 1)
        longest, compatible, shorter, most = self.automaton.iter_long, self.compatible, self.shorter, self.longest
        piece = next(longest(text[:most]))[1]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or compatible[out[-1], piece]):
                out.append(piece)
                if end == size:
                    return out
                at = end
                piece = next(longest(text[at : at + most]))[1]
                continue
            piece = shorter[piece]
            if piece is None:  # nothing goes on from here: the piece before must be shorter
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)

    def encode_part(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return [i for p in self.split(text) for i in self.ids[p]]
        out = []
        for known, run in groupby(text, self.known.__contains__):
            part = "".join(run)
            out += [i for p in self.split(part) for i in self.ids[p]] if known else self.fallback(part)
        return out

    def parts(self, text: str) -> list[str]:
        return self.cut((self.space + text).replace("▁", " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in self.encoded[p]]

    def decode_part(self, ids: list[int]) -> str:
        if self.odd.isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out = []
        for is_byte, run in groupby(ids, lambda i: self.kinds[i] == BYTE):
            if not is_byte:
                out += [self.plain[i] if self.kinds[i] == NORMAL else " ⁇ " if i == self.unknown else "" for i in run]
                continue
            data = bytes(int(self.pieces[i][3:5], 16) for i in run)
            while data:  # a character, or U+FFFD for one byte that begins none
                for size in range(1, 5):
                    try:
                        out.append(data[:size].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    size = 1
                data = data[size:]
        return "".join(out)

    def code_part(self, part: str) -> tuple[str, str]:
        """Ids joined by commas, and what they decode to."""
        ids = self.encode_part(part)
        text = self.decode_part(ids)
        return ",".join(map(str, ids)), part if text == part else text

    def decode(self, ids: list[int]) -> str:
        """Only the space of a first piece is the one that encoding put in front."""
        text = self.decode_part(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), self.unknown)
        return text.removeprefix(self.space) if self.kinds[first] == NORMAL else text


def coder(model: bytes) -> PieceCoder:
    """One coder for each model and worker process."""
    return resident(__name__, hashlib.md5(model).digest(), lambda: PieceCoder(model))


def _model(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # half a megabyte, whatever the input


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array of int."""
    model = _model(docs.sparkSession, path)

    def make():
        c = coder(model.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of the ids; null ids give an empty text."""
    model = _model(encoded.sparkSession, path)

    def make():
        c = coder(model.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [c.decode([i for i in ids or [] if i is not None]) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return each

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def encode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    model = _model(docs.sparkSession, path)

    def make():
        c = coder(model.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                both = list(map(c.both.__getitem__, c.parts(text or "")))
                ids = ",".join([x for x, _ in both])
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256("".join([x for _, x in both]).removeprefix(c.space).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
