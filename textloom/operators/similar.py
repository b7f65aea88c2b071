"""Pairs of texts with similar sets of tokens, without loss and without moving their sets for each pair.

A text is the set of its words of two characters or more and its single CJK characters; texts of one set are one node. Two sets of
Jaccard similarity `least`, sizes n and m, differ in no more than (1 - least) / (1 + least) * (n + m) tokens. Three things that a node
tells in some dozens of bytes are never further apart than its set: its size, how many of its tokens are frequent, and a parity
sketch (bits that the hashes of its tokens flip). Nodes lie in blocks by size; cells of two blocks whose sizes allow a pair are
compared in tasks, by windows on the number of frequent tokens and counts of differing bits. Sets go to a cell once for all pairs
that are left in it, and decide. The frequent tokens, which a sample shows, change what is compared, never what is found.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import similarity_tokens, text

SAMPLED = 16  # one node of so many is asked for frequent tokens
FREQUENT = 4  # times that a token occurs in the sample
MOST = 2000  # frequent tokens that tasks get
BLOCKS = 40  # that nodes are dealt to, or more where these would be large
LEAST, LARGEST = 1024, 1 << 16  # nodes in a block
TOKENS = 512  # times the nodes of a block: tokens in it
ROWS = 8  # of a block that meet another at a time
TASKS = 512  # that cells are dealt to at most
PAIRS = 50_000  # to be judged from which on those of a cell are dealt out
HELD = 1_000_000  # tokens of split sets that a task keeps
SENT = 1_000_000  # rows of one or two numbers that tasks get


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse if that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df in the shared folder, without lineage."""
    _shared(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame) -> DataFrame:
    """df in the shared folder, without lineage, in compressed columns: for what has many rows."""
    path = folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folded(s: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(s, "<u8")
    return np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)


def most_apart(n, m, least: float):
    """The largest symmetric difference of sets of n and m with that similarity."""
    return np.floor((1 - least) / (1 + least) * (n + m) + 1e-6)


def _bits(n):
    """Of the sketch of a set of n."""
    return 1 << max(6, (3 * n // 2 - 1).bit_length())


def _sketched(sent):
    """rep, n, c and sketch of a node: its size, its frequent tokens, the bits that its tokens flip."""

    def run(batches):
        frequent = np.array(sent.value, np.int64)
        for batch in batches:
            lists = batch.column(1)
            row, hashes, rows = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy(), np.arange(batch.num_rows + 1)
            at, common = np.searchsorted(row, rows).tolist(), np.bincount(row[np.isin(hashes, frequent)], minlength=batch.num_rows)
            made = [np.packbits(np.bincount(hashes[lo:hi] & (_bits(hi - lo) - 1), minlength=_bits(hi - lo)) & 1).tobytes() for lo, hi in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int32()), pa.array(common, pa.int32()), pa.array(made, pa.binary())], names=["rep", "n", "c", "sketch"])

    return run


def _blocks(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(lo, hi, parts): neighbouring sizes whose sketches are of one length; a size that alone is too many is in parts. sizes: (n, nodes), rising."""
    most = min(LARGEST, max(LEAST, sum(k for _, k in sizes) // BLOCKS))
    out, nodes, tokens = [], 0, 0
    for n, k in sizes:
        if out and _bits(out[-1][0]) == _bits(n) and nodes + k <= most and tokens + n * k <= most * TOKENS:
            out[-1] = (out[-1][0], n, 1)
        else:
            out.append((n, n, -(-k // min(most, max(LEAST, most * TOKENS // n)))))
            nodes = tokens = 0
        nodes, tokens = nodes + k, tokens + n * k
    return out


def _near(least: float):
    """(cell, a, b): nodes of a cell's two blocks, or of its one, that may be similar. rows: cell, rep, n, c, sketch, whether it is of the second block."""

    def block(table: pa.Table, bits: int):
        table = table.sort_by("c")
        sketches = np.array([folded(s, bits) for s in table["sketch"].to_pylist()])
        return table["rep"], table["n"].to_numpy().astype(np.int64), table["c"].to_numpy().astype(np.int64), np.ascontiguousarray(sketches.T)

    def run(rows: pa.Table) -> pa.Table:
        schema = pa.schema([("cell", pa.int32()), ("a", rows.schema.field("rep").type), ("b", rows.schema.field("rep").type)])
        cell, one = rows["cell"][0].as_py(), rows["one"][0].as_py()
        left, right = (rows, rows) if one else (rows.filter(pc.invert(rows["second"])), rows.filter(rows["second"]))
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        bits = 8 * min(len(left["sketch"][0].as_py()), len(right["sketch"][0].as_py()))
        (a_reps, n, a_c, x), (b_reps, m, b_c, y) = block(left, bits), block(right, bits)
        words, kind = bits // 64, np.uint16 if bits < 1 << 16 else np.uint32
        first, most, found = -(-words // 2), most_apart(n, m.max(), least), []
        for at in range(0, len(n), ROWS):
            own = slice(at, at + ROWS)
            # with c frequent tokens each, |c_b - c_a| + |(m - c_b) - (n - c_a)| is no more than what two sets may differ in
            lo = np.searchsorted(b_c, (a_c[own] + (m.min() - n[own] - most[own]) / 2).min())
            hi = np.searchsorted(b_c, (a_c[own] + (m.max() - n[own] + most[own]) / 2).max(), "right")
            lo = max(lo, at) if one else lo
            if lo >= hi:
                continue
            differ = np.zeros((len(n[own]), hi - lo), kind)
            for w in range(first):
                differ += np.bitwise_count(x[w, own][:, None] ^ y[w, lo:hi])
            i, j = np.nonzero(differ <= most_apart(n[own, None], m[lo:hi], least))
            apart, i, j = differ[i, j], i + at, j + lo
            apart = apart + np.bitwise_count(x[first:, i] ^ y[first:, j]).sum(axis=0)
            keep = (apart <= most_apart(n[i], m[j], least)) & (i < j if one else True)
            found.append((i[keep], j[keep]))
        i, j = (np.concatenate(z) if found else np.zeros(0, np.int64) for z in (zip(*found, strict=True) if found else ((), ())))
        return pa.Table.from_arrays([pa.array(np.full(len(i), cell), pa.int32()), a_reps.take(pa.array(i)), b_reps.take(pa.array(j))], schema=schema)

    return run


def _judged(least: float):
    """(a, b): pairs of a cell, or of a part of it, whose sets are similar. sets: rep, words."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        own: dict = {}
        mean = pc.sum(pc.count_substring(sets["words"], " ")).as_py() // sets.num_rows + 1
        for rep, words in zip(sets["rep"].to_pylist(), sets["words"].to_pylist(), strict=True):
            own.setdefault(rep, []).append(words)
        split = lru_cache(max(2, HELD // mean))(lambda words: frozenset(words.split(" ")))

        def similar(a: str, b: str) -> bool:
            g, h = split(a), split(b)
            both = len(g & h)
            return both >= least * (len(g) + len(h) - both) - 1e-9

        pairs = pairs.select(["a", "b"]).sort_by("a")
        keep = [any(similar(g, h) for g in own[a] for h in own[b]) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)]
        return pairs.filter(pa.array(keep, pa.bool_()))

    return run


def sets(records: DataFrame, content: str, key: str) -> DataFrame:
    """key, h (names the set), tokens."""
    rows = records.select(F.col(key).alias("key"), F.array_sort(similarity_tokens(text(content))).alias("tokens"))
    return rows.withColumn("h", F.md5(F.concat_ws(" ", "tokens")))


def links(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b) with a < b: the reps of nodes (rep, tokens) whose sets have the similarity. Tokens are moved only of nodes that may be in a pair."""
    spark, kind = nodes.sparkSession, dict(nodes.dtypes)["rep"]
    full = nodes.where((F.size("tokens") > 0) & F.col("rep").isNotNull()).select("rep", "tokens")
    named = full.select("rep", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    seen = named.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).select(F.explode("tokens").alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    frequent = [r["x"] for r in seen.where(F.col("k") >= FREQUENT).orderBy(F.desc("k"), "x").limit(MOST).collect()]
    made = packed(named.mapInArrow(_sketched(spark.sparkContext.broadcast(frequent)), f"rep {kind}, n int, c int, sketch binary"))
    sizes = [tuple(r) for r in made.groupBy("n").agg(F.count("*")).orderBy("n").collect()]  # a row for each size that sets have
    blocks = _blocks(sizes)
    parts = [(lo, hi, of, k) for lo, hi, of in blocks for k in range(of)]
    cells = [(i, j) for i, x in enumerate(parts) for j, y in enumerate(parts[i:], i) if abs(y[0] - x[1]) * (y[0] > x[1]) <= most_apart(x[1], y[0], least)]
    of = F.broadcast(spark.createDataFrame([(n, i, of, k) for i, (lo, hi, of, k) in enumerate(parts) for n, _ in sizes if lo <= n <= hi], "n int, block int, of int, part int"))
    placed = made.join(of, "n").where(F.pmod(F.xxhash64("rep", F.lit("part")), F.col("of")) == F.col("part"))
    sides = spark.createDataFrame([(k, x, i == j, x != i) for k, (i, j) in enumerate(cells) for x in sorted({i, j})], "cell int, block int, one boolean, second boolean")
    # cells are few bytes and much work: they are dealt to many tasks
    rows = placed.join(F.broadcast(sides), "block").select("cell", "rep", "n", "c", "sketch", "one", "second").repartition(min(max(1, len(cells)), TASKS), "cell")
    near = rows.groupBy("cell").applyInArrow(_near(least), f"cell int, a {kind}, b {kind}").where("a <> b")
    pairs = packed(near.select("cell", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    many = pairs.groupBy("cell").agg(F.ceil(F.sqrt(F.count("*") / PAIRS)).alias("of"))
    part = lambda x: F.pmod(F.xxhash64(x), F.col("of"))
    pairs = packed(pairs.join(F.broadcast(many), "cell").select("cell", part("a").alias("i"), part("b").alias("j"), "a", "b"))
    wanted = packed(pairs.select("cell", "i", "j", F.col("a").alias("rep")).union(pairs.select("cell", "i", "j", F.col("b").alias("rep"))).distinct())
    few = full.select("rep", F.concat_ws(" ", "tokens").alias("words")).join(_sent(wanted), "rep")
    dealt = lambda df: df.repartition(min(max(1, len(cells)), TASKS), "cell", "i", "j").groupBy("cell", "i", "j")
    return written(dealt(pairs).cogroup(dealt(few)).applyInArrow(_judged(least), f"a {kind}, b {kind}").distinct())


def _sent(rows: DataFrame) -> DataFrame:
    """Written rows of a few numbers, to be sent to the tasks while they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def first_kept(records: DataFrame, content: str, key: str, least: float) -> DataFrame:
    """key, kept_key: in order of key, a record joins the first kept one of similarity `least`, or is kept."""
    return _greedy(*_linked(records, content, key, least))


def pairs(records: DataFrame, content: str, key: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) of similar texts with different sets, each named by the smallest key of its set, and (key, rep) of all records."""
    rows, nodes, edges = _linked(records, content, key, least)
    return edges, rows.join(nodes.select("h", "rep"), "h").select("key", "rep")


def _linked(records: DataFrame, content: str, key: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, h), a node (h, rep, id) for each set, and the links of similar ones by id, which is rep."""
    made = packed(sets(records, content, key))
    rows = made.select("key", "h")
    nodes = packed(rows.groupBy("h").agg(F.min("key").alias("rep")))
    copies = packed(rows.join(nodes, "h").where("rep IS NULL OR key IS NULL OR key <> rep").select("key", F.xxhash64("h").alias("of")).distinct())
    same = F.col("copy.key").eqNullSafe(F.col("made.key")) & (F.xxhash64("made.h") == F.col("copy.of"))
    first = made.alias("made").join(_sent(copies).alias("copy"), same, "left_anti")  # a record for each set
    edges = links(first.select(F.col("key").alias("rep"), "tokens"), least)
    return rows, nodes.select("h", "rep", F.col("rep").alias("id")), edges


def _greedy(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rounds: a node without a smaller undecided neighbour is kept, its neighbours go."""
    left, gone = edges, None
    while left.limit(1).count():
        roots = left.select(F.col("a").alias("r")).distinct().join(left.select(F.col("b").alias("r")).distinct(), "r", "left_anti")
        out = written(left.join(roots, left["a"] == roots["r"], "left_semi").select(F.col("b").alias("x")).distinct())
        gone = out if gone is None else gone.union(out)
        rest = left.join(roots, left["a"] == roots["r"], "left_anti")
        left = written(rest.join(out, rest["a"] == out["x"], "left_anti").join(out, F.col("b") == out["x"], "left_anti"))
    names = nodes.select("id", "h", "rep")
    if gone is not None:
        kept = edges.join(gone, edges["a"] == gone["x"], "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_semi").groupBy("b").agg(F.min("a").alias("a"))
        to = kept.join(nodes.select(F.col("id").alias("a"), F.col("rep").alias("to")), "a").select(F.col("b").alias("id"), "to")
        names = names.join(to, "id", "left").select("h", F.coalesce("to", "rep").alias("kept_key"))
    else:
        names = names.select("h", F.col("rep").alias("kept_key"))
    return rows.select("key", "h").join(names, "h").select("key", "kept_key")
