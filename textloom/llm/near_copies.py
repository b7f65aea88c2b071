"""The wider pass of SimHash near-dedup: near copies whose fingerprints lie farther apart than an exact grid join can reach.

Groups are what both relations connect: SimHash's links (simhash.py), and similarity. For the latter a document is the set
of 64-bit hashes of its runs of `WORDS` words (all its words, if fewer); documents of one set are one node. Nodes of Jaccard
similarity `LEAST` link. Under any order of the shingles, two such sets share one of their first n - ceil(LEAST * n) + 1 elements, so nodes that
share such an element are all the candidates. The order is by hash, those that are frequent in a sample last, which keeps
the lists of an element short but drops nothing. Parity sketches (see operators/similar.py) exclude pairs that differ in too
many elements, and the whole sets of the others are compared. A list of up to `LIST` nodes gives all its pairs. A longer one
is first compared with its smallest node, its centre. Where nodes of one centre aren't linked then, they are dealt in blocks
of about `BLOCK`, blocks meet by twos in units of work of bounded size, and a unit gives only pairs that sketches allow.

Defined cases: wordless and null texts are copies of each other; a row without doc_id is no node; rows sharing a doc_id are
one node each by set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.similar import folded, most_apart
from .common import Scratch, components, fresh_name, map_rows, raw
from .simhash import fingerprint
from .simhash import links as simhash_links

WORDS = 5
LEAST = 0.8
LIST = 64
BLOCK = 256
NARROW, WIDE = 512, 1 << 17  # bits of sketches; in between twice the size of the set at least
SAMPLED = 16  # one node of so many is asked for frequent shingles
FREQUENT = 8  # times that it occurs in the sample
MOST = 100_000  # frequent shingles that the driver gets
FEW = 1_000_000  # ids, of 8 bytes each, up to which they are broadcast
SEED = 42
MIX = np.uint64(0x9FB21C651E98DF25)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Hashes of runs of words, made of the words' own hashes, each of which is taken once."""
    found = (text or b"").lower().split()
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in found), np.uint64, len(found))
    run = min(words, len(own))
    x = np.full(max(1, len(own) - run + 1), run, np.uint64)
    for k in range(run):
        x = x * MIX + own[k : len(own) - run + 1 + k]
    x = (x ^ (x >> np.uint64(32))) * MIX
    return np.unique(x ^ (x >> np.uint64(29))).view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of elements that end in the same bits."""
    bits = min(max(NARROW, 1 << (2 * len(s)).bit_length()), WIDE)
    odd = np.bincount(s & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def prefix(s: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """The elements of which similar sets share one."""
    n = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1
    if not len(frequent):
        return s[:n]
    last = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return np.concatenate([s[~last], s[last]])[:n]


def _sets(docs: DataFrame, words: int, make_row, kind: str, with_print: bool = False) -> DataFrame:
    """doc_id, h (names the set), n, sketch, data, and SimHash's fingerprint fp if it is asked for."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = raw(batch.column(1))
            found = [shingles(t, words) for t in texts]
            own = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array(list(map(len, found)), pa.int32()), pa.array(list(map(sketch, found)), pa.binary())]
            own.append(pa.array([make_row(s) for s in found], pa.binary() if kind == "binary" else pa.list_(pa.int64())))
            if with_print:
                own.append(pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), *own], names=["doc_id", "h", "n", "sketch", "data", *(["fp"] * with_print)])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, f"doc_id long, h binary, n int, sketch binary, data {kind}" + ", fp long" * with_print)


def _possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that sketches don't exclude."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b, n, m in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "an", "bn")), strict=True):
                bits = 8 * min(len(a), len(b))
                keep.append(int(np.bitwise_count(folded(a, bits) ^ folded(b, bits)).sum()) <= most_apart(n, m, least))
            return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        return each

    side = lambda k, name: nodes.select(F.col("rep").alias(k), F.col("sketch").alias(name), F.col("n").alias(f"{name}n"))
    return map_rows(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b", "an", "bn"), make, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        return each

    side = lambda k, name: sets.select(F.col("rep").alias(k), F.col("data").alias(name))
    return map_rows(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b"), make, "u long, v long")


def apart(sketches: list[bytes], n: np.ndarray, others: list[bytes], m: np.ndarray, least: float) -> np.ndarray:
    """Which sets (rows) and others (columns) may be similar, by their sizes and sketches."""
    out = np.zeros((len(n), len(m)), bool)
    sizes = (n[:, None] >= least * m[None, :] - 1e-9) & (m[None, :] >= least * n[:, None] - 1e-9)
    most = most_apart(n[:, None], m[None, :], least)
    widths, other_widths = np.array(list(map(len, sketches))), np.array(list(map(len, others)))
    for w in np.unique(widths):
        for v in np.unique(other_widths):
            a, b, bits = np.flatnonzero(widths == w), np.flatnonzero(other_widths == v), 8 * int(min(w, v))
            x, y = np.stack([folded(sketches[k], bits) for k in a]), np.stack([folded(others[k], bits) for k in b])
            if not sizes[np.ix_(a, b)].any():
                continue
            differ = np.zeros((len(a), len(b)), np.int32)
            for word in range(x.shape[1]):
                differ += np.bitwise_count(x[:, word][:, None] ^ y[:, word][None, :])
            out[np.ix_(a, b)] = differ <= most[np.ix_(a, b)]
    return out & sizes


def _units(least: float):
    """Input (unit, mine, rep, n, low, sketch), sorted by unit: pairs of unlinked nodes, one of which is in the first block if two meet."""

    def pairs(x):
        rep, n, low, mine = (np.array([r[k] for r in x]) for k in ("rep", "n", "low", "mine"))
        a = np.flatnonzero(mine == mine.min())
        b = a if mine.min() == mine.max() else np.flatnonzero(mine != mine.min())
        ok = apart([x[k]["sketch"] for k in a], n[a], [x[k]["sketch"] for k in b], n[b], least) & (low[a][:, None] != low[b][None, :])
        i, j = np.nonzero(ok)
        u, v = rep[a][i], rep[b][j]
        keep = (u < v) if a is b else np.ones(len(u), bool)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)[keep]), pa.array(np.maximum(u, v)[keep])], names=["u", "v"])

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["unit"] != held[0]["unit"]:
                    yield pairs(held)
                    held = []
                held.append(row)
        if held:
            yield pairs(held)

    return run


def _unlinked(members: DataFrame, nodes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of members (centre, rep, n, low) of one centre that have different `low` and that sketches don't exclude."""
    sizes = scratch.table(members.groupBy("centre").agg(F.count("*").alias("k"), F.min("low").alias("a"), F.max("low").alias("b")).where("a < b").select("centre", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "sizes")
    dealt = members.join(sizes, "centre").withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.join(nodes.select("rep", "sketch"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.struct("centre", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    rows = dealt.select(unit.alias("unit"), "mine", "rep", "n", "low", "sketch").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(_units(least), "u long, v long").distinct()


def near_links(docs: DataFrame, words: int = WORDS, least: float = LEAST, with_print: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, rep, and fp if it is asked for) for every row of docs, rep being the smallest doc_id of its set, and the links (u, v) of similar sets' reps."""
    scratch = Scratch(docs.sparkSession, "near_copies")
    some = _sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0), words, lambda s: s.tolist(), "array<long>")
    top = some.dropDuplicates(["h"]).select(F.explode("data").alias("s")).groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") >= FREQUENT).orderBy(F.desc("k"), "s").limit(MOST)
    top = scratch.table(top.select("s"), "frequent")
    frequent = np.sort(np.array([r[0] for r in top.collect()], np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    prints = scratch.table(_sets(docs, words, lambda s: prefix(s, sent.value, least), "array<long>", with_print), "prints")
    names = scratch.table(prints.drop("n", "sketch", "data"), "names")
    nodes = scratch.table(prints.where("doc_id IS NOT NULL").groupBy("h").agg(F.min(F.struct("doc_id", "n", "sketch", "data")).alias("x")).select("h", F.col("x.doc_id").alias("rep"), "x.n", "x.sketch", "x.data"), "nodes")
    scratch.drop("prints")
    places = nodes.select(F.explode("data").alias("s"), F.struct("rep", "n").alias("x"))
    # frequent shingles are counted before any exchange, and nodes of long lists of these are not moved; others have long lists by chance only
    heads = scratch.table(places.join(F.broadcast(top), "s", "left_semi").groupBy("s").agg(F.count("*").alias("k"), F.min("x").alias("c")).where("k > 1"), "heads")
    often = places.join(F.broadcast(heads), "s")
    by = Window.partitionBy("s")
    seldom = places.join(F.broadcast(top), "s", "left_anti").withColumn("k", F.count("*").over(by)).withColumn("c", F.min("x").over(by)).where("k > 1")
    part = F.when(F.col("k") > LIST, F.col("x.rep"))  # a short list is one row, a long one has a row for each node: none is held whole
    gathered = lambda df: df.groupBy("s", "k", "c", part.alias("part")).agg(F.array_sort(F.collect_list("x")).alias("xs")).select("k", "c", "xs")
    lists = scratch.table(gathered(seldom).union(gathered(often.where(F.col("k") <= LIST))), "lists")
    long = scratch.table(often.where(F.col("k") > LIST).select("c", F.array("x").alias("xs")).union(lists.where(F.col("k") > LIST).select("c", "xs")), "long")
    near = (F.col("p.n") >= least * F.col("q.n") - 1e-9) & (F.col("q.n") >= least * F.col("p.n") - 1e-9) & (F.col("p.rep") < F.col("q.rep"))
    pair = lambda df: df.where(near).select(F.col("p.rep").alias("u"), F.col("q.rep").alias("v"))
    short = lists.where(F.col("k") <= LIST).select("xs", F.explode("xs").alias("p")).select("p", F.explode("xs").alias("q"))
    first = pair(short).union(pair(long.select(F.col("c").alias("p"), F.explode("xs").alias("q"))))
    pairs = scratch.table(first.distinct(), "pairs")
    likely = scratch.table(_possible(pairs, nodes, least), "likely")
    edges = scratch.table(_verified(likely, _whole(docs, nodes, likely, words, scratch, "used"), least), "links")
    members = scratch.table(long.select(F.col("c.rep").alias("centre"), F.explode("xs").alias("x")).select("centre", "x.rep", "x.n").distinct(), "members")
    if members.limit(1).count():
        stars = components(edges, Scratch(docs.sparkSession, "near_stars")).select(F.col("u").alias("rep"), F.col("v").alias("low"))
        named = scratch.table(members.join(stars, "rep", "left").select("centre", "rep", "n", F.coalesce("low", "rep").alias("low")), "named")
        rest = scratch.table(_unlinked(named, nodes, least, scratch).join(pairs, ["u", "v"], "left_anti"), "rest")
        edges = scratch.table(edges.union(_verified(rest, _whole(docs, nodes, rest, words, scratch, "used_rest"), least)), "all_links")
    return names.join(nodes.select("h", "rep"), "h", "left"), edges


def near_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, h, component_id long for every row of docs."""
    names, edges = near_links(docs, words, least)
    stars = components(edges, Scratch(docs.sparkSession, "near_components")).select(F.col("u").alias("rep"), F.col("v").alias("low"))
    return names.join(stars, "rep", "left").select("doc_id", "h", F.coalesce("low", "rep").alias("component_id"))


def _whole(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, scratch: Scratch, name: str) -> DataFrame:
    """rep, data: the whole sets of the pairs' nodes."""
    used = pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    wanted = scratch.table(nodes.select("rep", "h").join(used, "rep", "left_semi"), name)  # written, so that its size is known
    column = fresh_name(docs, "used_id")
    again = docs.join(wanted.select(F.col("rep").alias(column)), docs["doc_id"] == F.col(column), "left_semi")
    found = _sets(again, words, lambda s: s.tobytes(), "binary").withColumnRenamed("h", "g")
    return found.join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("g") == F.col("h"))).select("rep", "data").dropDuplicates(["rep"])


def near_dedup(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs with one document, the smallest doc_id, of each group that SimHash's links and near copies connect. Rows without doc_id stay."""
    scratch = Scratch(docs.sparkSession, "near_dedup")
    names, edges = near_links(docs, words, least, True)
    names = scratch.table(names.where("doc_id IS NOT NULL").select("doc_id", "fp", "rep").distinct(), "names")
    prints, near = simhash_links(names.select("doc_id", "fp"), scratch)
    both = scratch.table(names.join(prints.select("fp", F.col("rep").alias("a")), "fp").select("doc_id", "rep", "a").distinct(), "both")
    # a doc_id names its group under either relation, so that links of both connect the same nodes
    stars = components(both.select(F.col("a").alias("u"), F.col("rep").alias("v")).union(edges.select("u", "v")).union(near.select("u", "v")), scratch).select(F.col("u").alias("a"), F.col("v").alias("low"))
    low = both.join(stars, "a", "left").groupBy("doc_id").agg(F.max(F.coalesce("low", "a")).alias("low"))  # a doc_id goes if all of its texts have a smaller one
    name = fresh_name(docs, "gone_id")
    gone = scratch.table(low.where("low < doc_id").select(F.col("doc_id").alias(name)), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, docs["doc_id"] == gone[name], "left_anti")
