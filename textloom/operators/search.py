"""Retrieval over chunks, batched by query.

chunks: kb, doc_id, chunk_id, chunk_index, section_path, content, embedding where vectors are searched.
queries: query_id, query, embedding. Queries are a stated set; they are sent to the chunks in blocks of `BLOCK`, so what is
broadcast is bounded however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.metrics import cosine
from ..functions.text import fingerprint, lexical_terms, text, tokens
from .similar import written

FEW_HITS = 100_000  # hits, of some dozens of bytes, that are sent to tasks
BLOCK = 1024
REMEMBERED = 500_000  # tokens whose slots a task remembers
K1, B = 1.2, 0.75


def in_blocks(queries: DataFrame, columns: list[str], block: int = BLOCK):
    """Tables of at most `block` queries, one after another."""
    part, rows = [], 0
    for row in queries.select(*columns).toLocalIterator():
        part.append(row)
        rows += 1
        if len(part) == block:
            yield part
            part = []
    if part or not rows:
        yield part


def hash_slots(tokens: list[str], dim: int, memo: dict[str, int]) -> np.ndarray:
    if len(memo) > REMEMBERED:  # between texts, as all slots of one are looked up together
        memo.clear()
    for t in tokens:
        if t not in memo:
            memo[t] = int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % dim
    return np.bincount([memo[t] for t in tokens], minlength=dim).astype(float) if tokens else np.zeros(dim)


def embedded(rows: DataFrame, column: str, dim: int = 64, provider: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """rows with embedding. The provider gives vectors for a batch of texts; by default counts of hashed tokens."""
    toks = fresh(rows, "toks")
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            names = [n for n in batch.schema.names if n != toks]
            if provider:
                out = provider([x or "" for x in batch.column(column).to_pylist()])
            else:
                out = [hash_slots(t or [], dim, memo) for t in batch.column(toks).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "embedding"])

    return rows.withColumn(toks, tokens(text(column))).mapInArrow(run, schema)


def fresh(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name += "_"
    return name


def filtered(chunks: DataFrame, kb: str | None = None, doc_ids: list | None = None, source: str | None = None, doc_type: str | None = None, section: str | None = None) -> DataFrame:
    """Equality filters, pushed to the scan; a section may also be part of the path."""
    for name, value in (("kb", kb), ("source", source), ("doc_type", doc_type)):
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    if doc_ids is not None:
        chunks = chunks.where(F.col("doc_id").isin(doc_ids))
    if section is not None:
        chunks = chunks.where(F.contains(F.col("section_path"), F.lit(section)))
    return chunks


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", digits: int = 6) -> DataFrame:
    """query_id, key, score: the k best by cosine; ties to the smaller key. Each task keeps its own k best of each query."""
    usable = chunks.where(F.size("embedding") > 0).select(key, F.col("embedding").cast("array<double>"))

    def scorer(rows: list) -> Callable[[pa.Array], np.ndarray]:
        q = np.array([r["embedding"] for r in rows], dtype=float)
        length = np.sqrt((q * q).sum(axis=1))

        def score(column: pa.Array) -> np.ndarray:
            flat = column.flatten().to_numpy()
            if len(flat) != len(column) * q.shape[1]:
                raise ValueError("vectors and queries must have one length")
            v = flat.reshape(-1, q.shape[1])
            size = np.outer(length, np.sqrt((v * v).sum(axis=1)))
            return np.round(np.divide(q @ v.T, size, out=np.zeros_like(size), where=size > 0), digits)

        return score

    return _top_k(usable, queries.where(F.size("embedding") > 0).select("query_id", "embedding"), k, key, scorer)


def lexical_search(chunks: DataFrame, queries: DataFrame, k: int, terms: int = 12, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score: the share of the query's terms that the content holds, k best; none without any.

    One automaton of a block's terms reads each content once.
    """
    wanted = queries.select("query_id", lexical_terms(F.col("query"), terms).alias("terms")).where(F.size("terms") > 0)
    lowered = chunks.select("chunk_id", F.lower(text("content")).alias("content"))

    def scorer(rows: list) -> Callable[[pa.Array], np.ndarray]:
        number = {t: i for i, t in enumerate(dict.fromkeys(t for r in rows for t in r["terms"]))}
        automaton = ahocorasick.Automaton()
        for t, i in number.items():
            automaton.add_word(t, i)
        automaton.make_automaton()
        has = np.zeros((len(rows), len(number)), np.float32)
        for i, r in enumerate(rows):
            has[i, [number[t] for t in r["terms"]]] = 1
        size = has.sum(axis=1, dtype=float)

        def score(column: pa.Array) -> np.ndarray:
            found = np.zeros((len(column), len(number)), np.float32)
            for i, content in enumerate(column.to_pylist()):
                found[i, list({n for _, n in automaton.iter(content)})] = 1
            share = np.round((has @ found.T).astype(float) / size[:, None], digits)
            return np.where(share > 0, share, -np.inf)

        return score

    return _top_k(lowered, wanted, k, "chunk_id", scorer)


def _top_k(rows: DataFrame, queries: DataFrame, k: int, key: str, scorer: Callable[[list], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The k best rows (key, column) of each query; scorer(block of queries) gives a function of the column to scores
    (queries, rows), -inf for none. What a task hands on is k rows a query at most."""
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(rows.dtypes)[key]}, score double"
    parts = []
    for block in in_blocks(queries, queries.columns):
        if block:
            sent = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in block])  # BLOCK queries at most
            parts.append(rows.mapInArrow(_task_top_k(sent, to_arrow_type(queries.schema["query_id"].dataType), k, key, scorer), schema))
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return reduce(DataFrame.union, parts).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def _task_top_k(sent, id_kind: pa.DataType, k: int, key: str, scorer):
    def run(batches):
        block = sent.value
        names, score = [r["query_id"] for r in block], scorer(block)
        keys: list = [np.zeros(0, object)] * len(names)
        best = [np.zeros(0)] * len(names)
        kind = None
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                kind = batch.column(0).type
                own = np.array(batch.column(0).to_pylist(), object)
                for i, row in enumerate(score(batch.column(1))):
                    if len(best[i]) >= k:
                        (take,) = np.nonzero(row >= best[i].min())
                    else:
                        (take,) = np.nonzero(row > -np.inf)
                    if not len(take):
                        continue
                    s, n = np.concatenate([best[i], row[take]]), np.concatenate([keys[i], own[take]])
                    if len(s) > k:
                        (keep,) = np.nonzero(s >= np.partition(s, -k)[-k])
                        if len(keep) > k:  # ties with the last: the smallest keys
                            keep = np.array(sorted(keep.tolist(), key=lambda j: (-s[j], n[j]))[:k])
                        s, n = s[keep], n[keep]
                    best[i], keys[i] = s, n
        if kind is not None:
            out = [(q, x) for q, ks in zip(names, keys, strict=True) for x in ks]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], id_kind), pa.array([x for _, x in out], kind), pa.array(np.concatenate(best))], names=["query_id", key, "score"])

    return run


def bm25(candidates: DataFrame, queries: DataFrame, most_terms: int = 24, most_tokens: int = 160, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, bm25. Statistics are those of each query's candidates (query_id, chunk_id, content)."""
    toks = F.slice(tokens(text("content")), 1, most_tokens)
    docs = candidates.select("query_id", "chunk_id", toks.alias("toks"))
    per = docs.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.greatest(F.size("toks"), F.lit(1))).alias("avgdl"))
    terms = queries.select("query_id", F.explode(F.slice(F.array_distinct(tokens(text("query"))), 1, most_terms)).alias("term"))
    tf = docs.select("query_id", "chunk_id", F.greatest(F.size("toks"), F.lit(1)).alias("dl"), F.explode("toks").alias("term")).join(terms, ["query_id", "term"]).groupBy("query_id", "chunk_id", "dl", "term").agg(F.count("*").alias("f"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, ["query_id", "term"]).join(per, "query_id").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("s"))
    return docs.select("query_id", "chunk_id").join(scored, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.round(F.coalesce("s", F.lit(0.0)), digits).alias("bm25"))


def with_contents(hits: DataFrame, plain: DataFrame) -> DataFrame:
    """hits (a bounded number for each query) with the columns of their chunks, written. Hits are counted; few are sent to the
    chunks, which are then read where they lie and not moved."""
    hits = written(hits)
    return written(plain.join(F.broadcast(hits) if hits.count() <= FEW_HITS else hits, "chunk_id"))


def merged(vec: DataFrame, lex: DataFrame) -> DataFrame:
    """Candidates of both searches; a missing score is 0. merge_pos: the vector's ones first."""
    v = vec.select("query_id", "chunk_id", F.col("score").alias("vec"))
    x = lex.select("query_id", "chunk_id", F.col("score").alias("lex"))
    both = v.join(x, ["query_id", "chunk_id"], "full_outer")
    first = Window.partitionBy("query_id").orderBy(F.col("vec").isNull(), F.desc("vec"), F.desc("lex"), "chunk_id")
    return both.withColumn("merge_pos", F.row_number().over(first)).na.fill(0.0, ["vec", "lex"])


def rrf(scored: DataFrame, signals: dict[str, float], k: Column | float = 60.0, digits: int = 9) -> DataFrame:
    """scored with rrf: the sum of weight / (k + rank) over the signals; ranks tie-break on merge_pos."""
    total = F.lit(0.0)
    for name, weight in signals.items():
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(name), "merge_pos"))
        total = total + weight / ((F.lit(k) if isinstance(k, int | float) else k) + rank)
    return scored.withColumn("rrf", F.round(total, digits))


def limit_per_doc(hits: DataFrame, k: int, score: str = "rrf", per_doc: int = 2, top: int = 3, least: int = 3) -> DataFrame:
    """Documents by the sum of their `top` best chunks, `per_doc` chunks of each, k in all; rank is doc-major. Under `least` hits only their score counts."""
    own = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(score), "merge_pos")
    few = F.count("*").over(Window.partitionBy("query_id")) < least
    rows = hits.withColumn("rn", F.row_number().over(own)).withColumn("few", few)
    total = F.round(F.sum(F.when(F.col("rn") <= top, F.col(score))).over(Window.partitionBy("query_id", "doc_id")), 9)
    rows = rows.withColumn("doc_score", total).where(F.col("few") | (F.col("rn") <= per_doc))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("few"), F.col(score)).otherwise(F.col("doc_score"))), F.when(F.col("few"), F.col("merge_pos")), "doc_id", "rn")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rn", "few")


def search(chunks: DataFrame, queries: DataFrame, k: int = 8, rrf_k: Column | float = 60.0, weights: dict[str, float] | None = None, candidates: int | None = None, vec_queries: DataFrame | None = None, plain: DataFrame | None = None) -> DataFrame:
    """Hybrid search: vector and lexical candidates, BM25 over them, fused ranks, two chunks a document.

    `plain` are the chunks without embeddings, from which the other legs read, so that vectors are made once.
    """
    n = candidates or min(max(30, 10 * k), 160)
    plain = chunks if plain is None else plain
    vec = vector_search(chunks, vec_queries if vec_queries is not None else queries, n)
    both = merged(vec, lexical_search(plain, queries, n))
    full = with_contents(both, plain.select("chunk_id", "doc_id", "chunk_index", "section_path", "content"))
    scored = full.join(bm25(full, queries), ["query_id", "chunk_id"]).join(queries.select("query_id", "query"), "query_id")
    fused = rrf(scored, weights or {"vec": 1.0, "bm25": 1.0, "lex": 1.0}, rrf_k).drop("query")
    return limit_per_doc(fused, k)


def hierarchical(chunks: DataFrame, summaries: DataFrame, queries: DataFrame, k: int = 8, docs: int = 3, digits: int = 6, embed: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """query_id, chunk_id, score, doc_id, rank: vector search within the `docs` documents whose summaries score best, by an
    equi-join on the document, so that all of their chunks take part; in all chunks for queries without any there.

    `embed` gives vectors to chunks and summaries that come without: to those of routed documents only, unless a query has none there.
    """
    queries = written(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")))
    coarse = with_contents(vector_search(embed(summaries), queries, docs), summaries.select("chunk_id", "doc_id")).select("query_id", "doc_id").distinct()
    asked = written(coarse.join(queries.withColumnRenamed("embedding", "asked"), "query_id"))
    routes = asked.select("doc_id").distinct()
    within = embed(chunks.join(F.broadcast(routes) if asked.count() <= FEW_HITS else routes, "doc_id", "left_semi")).where(F.size("embedding") > 0).join(asked, "doc_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = lambda hits: hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    routed = written(best(within.select("query_id", "chunk_id", F.round(cosine(F.col("asked"), F.col("embedding")), digits).alias("score"), "doc_id")))
    left = written(queries.join(routed.select("query_id").distinct(), "query_id", "left_anti"))
    if not left.limit(1).count():
        return routed
    flat = with_contents(vector_search(embed(chunks), left, k, digits=digits), chunks.select("chunk_id", "doc_id"))
    return routed.unionByName(best(flat.select("query_id", "chunk_id", "score", "doc_id")))


def round_robin(lists: DataFrame, k: int) -> DataFrame:
    """Lists (query_id, subquery, pos, chunk_id) interleaved by position; the first occurrence of a chunk counts."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("pos", "subquery")
    rows = lists.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("query_id").orderBy("pos", "subquery")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id")


def merge_variants(lists: DataFrame, k: int, c: float = 60.0) -> DataFrame:
    """Each list adds 1 / (c + number of its variant) to its chunks."""
    total = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (c + F.col("variant"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_stepback(own: DataFrame, back: DataFrame, k: int, c: float = 60.0) -> DataFrame:
    """Hits (query_id, pos from 0, chunk_id) of the question weigh 1.2, those of the broader one 1."""
    both = own.withColumn("w", F.lit(1.2)).unionByName(back.withColumn("w", F.lit(1.0)))
    total = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") / (c + F.col("pos") + 1)), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: the best over all strategies."""
    return hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def min_max(hits: DataFrame, score: str = "score", digits: int = 6) -> DataFrame:
    """Scores scaled to 0..1 within a query; unchanged if there is one hit or all are equal."""
    w = Window.partitionBy("query_id")
    lo, hi, n = F.min(score).over(w), F.max(score).over(w), F.count("*").over(w)
    return hits.withColumn("norm", F.round(F.when((n < 2) | (hi == lo), F.col(score)).otherwise((F.col(score) - lo) / (hi - lo)), digits))


def title_boost(hits: DataFrame, factor: float = 0.1) -> DataFrame:
    """Scores grow with the query's terms in the title, or with its character pairs if none is there."""
    q, t = F.lower(text("query")), F.lower(text("title"))
    terms = F.size(F.filter(F.slice(F.array_distinct(tokens(q)), 1, 20), lambda x: F.contains(t, x)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(q) - 1, F.lit(1))), lambda i: F.substr(q, i, F.lit(2)))
    matched = F.when(terms > 0, terms.cast("double")).when(F.length(q) >= 4, 0.5 * F.size(F.filter(pairs, lambda x: F.contains(t, x)))).otherwise(0.0)
    return hits.withColumn("score", F.when((t != "") & (matched > 0), F.col("score") * (1 + factor * F.least(matched, F.lit(4.0)))).otherwise(F.col("score")))


def mmr(hits: DataFrame, k: int = 8, weight: float = 0.4) -> DataFrame:
    """Maximal marginal relevance within a query: .5 for a selected hit of the same document, .3 of the same top section.

    A query's hits are what a search gave, a bounded group.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = hits.withColumn("rn", F.row_number().over(w))

    def pick(pdf):
        pdf = pdf.sort_values("rn").reset_index(drop=True)
        section = pdf.section_path.fillna("").str.split("/").str[0].str.strip().to_numpy()
        doc, score = pdf.doc_id.to_numpy(), pdf.score.to_numpy(dtype=float)
        near, left, order = np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        at = 0
        while True:
            order.append(at)
            left[at] = False
            if len(order) >= k or not left.any():
                break
            near = np.maximum(near, np.where(doc == doc[at], 0.5, np.where((section == section[at]) & (section != ""), 0.3, 0.0)))
            at = int(np.argmax(np.where(left, weight * score - (1 - weight) * near, -np.inf)))
        return pdf.iloc[order].assign(rank=range(1, len(order) + 1))[["query_id", "rank", "chunk_id", "doc_id", "score"]]

    kinds = dict(hits.dtypes)
    return top.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, rank int, chunk_id {kinds['chunk_id']}, doc_id {kinds['doc_id']}, score double")


def drop_similar(hits: DataFrame, least: float = 0.55) -> DataFrame:
    """Greedy within a query, by falling score: a hit whose fingerprint overlaps a kept one's by `least` or more goes; rank is the new order."""
    rows = hits.select("query_id", "rank", "chunk_id", "score", fingerprint(F.col("content")).alias("grams"))

    def pick(pdf):
        pdf, kept, keep = pdf.sort_values(["score", "rank"], ascending=[False, True], kind="stable"), [], []
        for grams in map(set, pdf.grams):
            ok = not (grams and any(len(grams & g) >= least * len(grams | g) for g in kept if g))
            keep.append(ok)
            if ok:
                kept.append(grams)
        pdf = pdf[keep]
        return pdf.assign(rank=range(1, len(pdf) + 1))[["query_id", "rank", "chunk_id"]]

    kinds = dict(hits.dtypes)
    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, rank int, chunk_id {kinds['chunk_id']}")


def prefix_dedup(hits: DataFrame, n: int = 80) -> DataFrame:
    """The first hit with each prefix; hits without content all stay."""
    prefix = F.trim(F.substring(text("content"), 1, n))
    w = Window.partitionBy("query_id", prefix).orderBy("rank")
    return hits.withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) | (prefix == "")).drop("n")


def quality_ok(hits: DataFrame, min_score: float = 0.0, min_docs: int = 1, min_hits: int = 5) -> DataFrame:
    """query_id, ok: the third best score is .5 or more, or there are enough hits, documents and score."""
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.count_distinct("doc_id").alias("docs"), F.reverse(F.array_sort(F.collect_list("score"))).alias("s"))
    third = F.coalesce(F.try_element_at("s", F.lit(3)), F.lit(0.0)) >= 0.5
    return per.select("query_id", (third | ((F.col("n") >= min_hits) & (F.col("mean") >= min_score) & (F.col("docs") >= min_docs))).alias("ok"))
