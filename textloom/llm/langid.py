"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds the whole texts of a bounded sample of labelled documents: lower-cased, with one space
for each run of what is neither letter nor mark. A text is parsed against each automaton: every phrase is the longest match
from where the last one ended, one character at least, across words. The language that needs the fewest bits a character
wins: phrases times the logarithm of the learned text's length, which is what a phrase's place in that text takes.

The automata are double arrays, and all texts of a batch are parsed at once in segments of `SEGMENT` characters. A segment
is first parsed as if a phrase began with it; then anew with the state that the segment before ends in, up to the first
place where both parses begin a phrase, from which they agree. Texts with a segment in which they never meet are parsed
one character after another.

Defined cases: a null text, or one without letters (Unicode category L), is `und` with score 0; ties go to the alphabetically
first language; without any learned language all is `und`; rows whose lang, text or doc_id is null teach nothing and are
predicted like others (held_out is null where doc_id is); of rows that share lang and doc_id the smallest text teaches; rows
that repeat are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_rows

SAMPLE = 80  # labelled documents of each language that are learned from, the first by a hash of doc_id
LEARNED = 200_000  # characters of all languages after which no further document is learned from; documents are taken whole
STRANGE = 6.5  # bits a character beyond which a text is in none of the languages: theirs take 2 to 3, short ones with keys up to 5
START = 40  # bits that are not counted, so that a key does not decide on a short text
SEGMENT = 512
CELLS = 1 << 22  # characters times languages that are parsed at once
SPACE = 0


class SuffixAutomaton:
    """All substrings of the texts; edges[state] maps a character to the next state."""

    def __init__(self, texts: list):
        self.edges: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        for text in texts:
            last = 0
            for c in text:
                last = self.extend(last, c)
        del self.link, self.size  # matching needs the edges only

    def extend(self, last: int, c) -> int:
        if c in self.edges[last]:
            q = self.edges[last][c]
            return q if self.size[q] == self.size[last] + 1 else self.split(last, c, q)
        state = self.add(self.size[last] + 1, {})
        p = last
        while p != -1 and c not in self.edges[p]:
            self.edges[p][c] = state
            p = self.link[p]
        if p == -1:
            self.link[state] = 0
        else:
            q = self.edges[p][c]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self.split(p, c, q)
        return state

    def add(self, size: int, edges: dict) -> int:
        self.edges.append(edges)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def split(self, p: int, c, q: int) -> int:
        clone = self.add(self.size[p] + 1, dict(self.edges[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.edges[p].get(c) == q:
            self.edges[p][c] = clone
            p = self.link[p]
        return clone

    def phrases(self, text) -> int:
        """Phrases of the cross-parse: longest matches, one after another."""
        edges, state, n = self.edges, 0, 0
        for c in text:
            nxt = edges[state].get(c)
            if nxt is None or state == 0:
                n += 1
                nxt = edges[0].get(c, 0)
            state = nxt
        return n


def double_array(edges: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, cells): the edge of state s by character c is cells[base[s] + c], a state in its low half, if s is its high half."""
    base, used, low, at = [0] * len(edges), bytearray(2 * width), 0, 0
    place: dict[int, int] = {}
    for s in sorted(range(len(edges)), key=lambda s: (-len(edges[s]), s)):
        own = sorted(edges[s])
        if not own:
            continue
        if len(own) == 1:
            low = used.index(0, max(low, own[0]))
            at = low - own[0]
        else:
            at, tried = max(0, low - own[0]), 0
            while any(used[at + c] for c in own):
                at, tried = at + 1, tried + 1
            if tried > 64:
                low = max(low, at + own[0] - 64)
        for c in own:
            used[at + c] = 1
            place[at + c] = s << 32 | edges[s][c]
        base[s] = at
        if len(used) < at + 3 * width:
            used += bytearray(len(used))
    cells = np.full(max(place, default=0) + 2 * width + 1, -1, np.int64)
    cells[np.fromiter(place, np.int64, len(place))] = np.fromiter(place.values(), np.int64, len(place))
    return np.array(base, np.int32), cells


def character_kinds() -> np.ndarray:
    """For each code point: 2 if a letter, 1 if a mark, else 0."""
    first = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)).encode(), np.uint8)
    return np.where(first == ord("L"), 2, np.where(first == ord("M"), 1, 0)).astype(np.int8)


_kinds: list[np.ndarray] = []


def normal(text: str | None) -> tuple[np.ndarray, bool]:
    """Code points of the lower-cased text with SPACE for what separates words, one at a time and at both ends; whether it has letters."""
    if not _kinds:
        _kinds.append(character_kinds())
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    kind = _kinds[0][points]
    points = np.concatenate([[SPACE], np.where(kind > 0, points, SPACE), [SPACE]]).astype(np.int64)
    keep = np.r_[True, (points[1:] != SPACE) | (points[:-1] != SPACE)]
    return points[keep], bool((kind == 2).any())


class Models:
    """What the languages' automata need for parsing; small enough to send to all workers."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        points = {lang: [normal(t)[0] for t in texts[lang]] for lang in self.names}
        alphabet = np.unique(np.concatenate([np.zeros(1, np.int64), *(p for lang in self.names for p in points[lang])]))
        self.alphabet, self.width = alphabet, len(alphabet) + 1  # the last code is any other character
        self.tables, self.bits = [], []
        for lang in self.names:
            found = double_array(SuffixAutomaton([self.codes(p).tolist() for p in points[lang]]).edges, self.width)
            self.tables.append(found)
            self.bits.append(float(np.log2(2 + sum(map(len, points[lang])))))

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet))


class Parser:
    def __init__(self, models: Models):
        self.models, self.names = models, models.names
        sizes = [len(b) for b, _ in models.tables]
        spans = [len(c) for _, c in models.tables]
        self.root = np.cumsum([0, *sizes])[:-1]  # states and cells of all languages in one table
        start = np.cumsum([0, *spans])[:-1]
        self.base = np.concatenate([b + s for (b, _), s in zip(models.tables, start, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.cells = np.concatenate([np.where(c >= 0, c + (r << 32) + r, -1) for (_, c), r in zip(models.tables, self.root, strict=True)] or [np.zeros(0, np.int64)])
        self.table = np.full(sys.maxunicode + 1, len(models.alphabet), np.int32)
        self.table[models.alphabet] = np.arange(len(models.alphabet))
        every = np.arange(models.width)
        self.first = np.stack([self.step(np.full(models.width, r), every)[0] for r in self.root]) if self.names else None
        self.first = np.where(self.first < 0, self.root[:, None], self.first) if self.names else None

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, -1 where there is none."""
        cell = self.cells[self.base[state] + c]
        hit = cell >> 32 == state
        return np.where(hit, cell & 0xFFFFFFFF, -1), hit

    def one(self, codes: np.ndarray, lang: int) -> int:
        """Phrases of one text, a character at a time."""
        root, n = int(self.root[lang]), 0
        state, base, cells, first = root, memoryview(self.base), memoryview(self.cells), self.first[lang].tolist()
        for c in codes.tolist():
            cell = cells[base[state] + c]
            if state == root or cell >> 32 != state:
                n += 1
                state = first[c]
            else:
                state = cell & 0xFFFFFFFF
        return n

    def counts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and (size + len(texts[to])) * len(self.names) <= CELLS:
                size += len(texts[to])
                to += 1
            few = max(1, CELLS // max(size, 1))
            for k in range(0, len(self.names), few):
                out[at:to, k : k + few] = self._parse(texts[at:to], range(k, min(k + few, len(self.names))))
            at = to
        return out

    def _parse(self, texts: list[np.ndarray], langs: range) -> np.ndarray:
        flat = self.table[np.concatenate(texts)]
        sizes = np.array([len(t) for t in texts])
        parts = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), parts)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = (np.cumsum(sizes) - sizes)[doc] + part * SEGMENT
        length = np.minimum(SEGMENT, sizes[doc] - part * SEGMENT)
        order = np.argsort(-length, kind="stable")  # lanes that are still going come first
        g, n = len(langs), len(doc)
        start, length, doc, part = (x[order] for x in (start, length, doc, part))
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        root, first = self.root[langs.start : langs.stop, None], self.first[langs.start : langs.stop]
        state = np.repeat(root, n, axis=1)
        marks = np.zeros((SEGMENT, g, n), bool)
        live = n
        rows = np.arange(g)[:, None]
        for t in range(int(length.max(initial=0))):
            while length[live - 1] <= t:
                live -= 1
            s, c = state[:, :live], flat[start[:live] + t]
            nxt, hit = self.step(s, c[None, :])
            new = ~hit | (s == root)
            marks[t, :, :live] = new
            state[:, :live] = np.where(new, first[rows, c[None, :]], nxt)
        own = self._joined(marks, state, flat, start, length, doc, part, parts, order, back, langs)
        out = np.zeros((len(texts), g), np.int64)
        np.add.at(out, doc, (marks.sum(axis=0, dtype=np.int64) + own[0]).T)
        for lang, k in own[1]:
            out[k, lang] = self.one(self.table[texts[k]], langs[lang])
        return out

    def _joined(self, marks, state, flat, start, length, doc, part, parts, order, back, langs):
        """Corrections (languages, segments) for segments that follow another one, and the (language, text) left to parse singly.

        A segment is parsed anew from the state in which the one before ends, as long as its parse has no common phrase
        start with the first one; if it ends without, that changes the state in which the next one begins.
        """
        g, n = len(langs), len(doc)
        root, first = self.root[langs.start : langs.stop], self.first[langs.start : langs.stop]
        final, change = state.copy(), np.zeros((g, n), np.int64)
        lang, lane = (x.ravel() for x in np.meshgrid(np.arange(g), np.flatnonzero(part > 0), indexing="ij"))
        enter = state[lang, back[order[lane] - 1]] if len(lane) else np.zeros(0, np.int64)
        keep = enter != root[lang]
        lang, lane, enter, turn = lang[keep], lane[keep], enter[keep], 0
        while len(lane) and (turn < 4 or len(lane) >= 32):
            change[lang, lane] = 0
            end, going, s, t = final[lang, lane], np.arange(len(lane)), enter.copy(), 0
            while len(going):
                over = length[lane[going]] <= t
                end[going[over]] = s[going[over]]
                going = going[~over]
                if not len(going):
                    break
                own, at, of = s[going], lane[going], lang[going]
                c = flat[start[at] + t]
                nxt, hit = self.step(own, c)
                new = ~hit | (own == root[of])
                seen = marks[t, of, at]
                change[of, at] += new.astype(np.int64) - seen
                s[going] = np.where(new, first[of, c], nxt)
                met = new & seen
                end[going[met]] = state[of[met], at[met]]
                going, t = going[~met], t + 1
            moved = (end != final[lang, lane]) & (part[lane] + 1 < parts[doc[lane]])
            final[lang, lane] = end
            lang, lane, enter, turn = lang[moved], back[order[lane[moved]] + 1], end[moved], turn + 1
        return change, {(int(x), int(doc[k])) for x, k in zip(lang, lane, strict=True)}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits a character) of each text, without the first START. The score is the winner's share of the inverse bits."""
        found = [normal(t) for t in texts]
        known = [k for k, (_, letters) in enumerate(found) if letters and self.names]
        out: list[tuple[str, float, float]] = [("und", 0.0, 0.0)] * len(texts)
        counts = self.counts([found[k][0] for k in known]) if known else np.zeros((0, 1), np.int64)
        for k, own in zip(known, counts, strict=True):
            bits = own * np.array(self.models.bits)
            best = int(bits.argmin())
            out[k] = (self.names[best], float((1 / bits[best]) / (1 / bits).sum()), float(max(bits[best] - START, 0.0) / len(found[k][0])))
        return out


def folds(docs: DataFrame, fold: int = 4):
    """crc32 of doc_id's decimal text, modulo fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold


def learn(docs: DataFrame, sample: int = SAMPLE, held_fold: int | None = 2, learned: int = LEARNED) -> Models:
    """Automata of whole documents: of each language the first by a hash of doc_id, until they are `sample` documents or hold its share of `learned` characters.

    Documents of the held-out fold teach nothing; with held_fold None all may. However many languages there are, all are
    learned, each from one document at least, and the driver gets `learned` characters and one document a language at most.
    """
    usable = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", "text")
    if held_fold is not None:
        usable = usable.where(folds(usable) != held_fold)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    picked = ids.withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= sample).select("lang", "doc_id", "h").distinct()
    picked = Scratch(docs.sparkSession, "languages").table(picked, "picked")  # `sample` rows a language: written, so that their size is known
    texts = usable.join(picked, ["lang", "doc_id"]).groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
    sized = texts.withColumn("before", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    languages = max(1, picked.select("lang").distinct().count())
    rows = sized.where(F.coalesce("before", F.lit(0)) < learned / languages).select("lang", "text").collect()
    found: dict[str, list[str]] = {}
    for lang, text in sorted(map(tuple, rows)):
        found.setdefault(lang, []).append(text)
    return Models(found)


def predictions(docs: DataFrame, models: Models) -> DataFrame:
    """docs with lang_pred, score and bits a character appended under names given by `predicted_columns`."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by LEARNED

    def make():
        p = Parser(sent.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, bits = zip(*p.predict(batch.column("text").cast(pa.string()).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            own = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *predicted_columns(batch.schema.names)])

        return each

    own = zip(predicted_columns(docs.columns), (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)
    return map_rows(docs, make, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in own)]))


def predicted_columns(taken: list[str]) -> list[str]:
    out = []
    for name in ("lang_pred", "lang_score", "lang_bits"):
        while name.lower() in {t.lower() for t in taken}:
            name += "_"
        out.append(name)
    return out


def language_filter(docs: DataFrame, sample: int = SAMPLE, strange: float = STRANGE) -> DataFrame:
    """docs without those that have no letters or are in none of the learned languages. Without labels nothing is rejected but `und`."""
    models = learn(docs, sample, None)
    lang, _, bits = predicted_columns(docs.columns)
    if not models.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predictions(docs, models)
    return found.where((F.col(lang) != "und") & (F.col(bits) <= strange)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predictions(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", (folds(docs) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
