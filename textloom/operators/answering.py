"""Retrieval strategies built on search: adaptive, expanded, hypothetical, step-back, several bases, reranking, answers.

What a language model would write (sub-queries, hypothetical texts, rankings, verdicts) comes in as columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions.metrics import adaptive_k
from ..functions.text import cut_block, keywords, plain_sentences, sentences, strip, text, tokens
from . import context, search

WEIGHTS = [  # rule, weights of vec, bm25, lex; the first rule that holds counts
    (lambda q: Q.has_specialized_terms(tokens(q)), (1.15, 0.9, 0.9)),
    (lambda q: Q.has_numbers(q) | Q.has_tech(q), (0.95, 1.1, 1.1)),
    (lambda q: Q.concreteness(q) < 0.4, (1.1, 0.95, 0.95)),
    (lambda q: F.length(q) > 40, (1.05, 1.0, 0.95)),
]


def weights(query: Column) -> dict[str, Column]:
    """Weight of each signal by kind of query, 1 by default."""
    out = {}
    for k, name in enumerate(("vec", "bm25", "lex")):
        w = F.lit(1.0)
        for rule, values in reversed(WEIGHTS):
            w = F.when(rule(query), F.lit(values[k])).otherwise(w)
        out[name] = w
    return out


def budgets(query: Column, k: int) -> tuple[Column, Column]:
    """Vector and lexical candidates: (10k, 18k) for figures, (18k, 8k) for abstract questions, (15k, 12k) else; 240 at most."""
    exact, abstract = Q.has_numbers(query) | Q.has_tech(query), Q.concreteness(query) < 0.4
    cap = lambda n, least: F.least(F.greatest(F.lit(n), F.lit(least)), F.lit(240))
    vec = F.when(exact, cap(10 * k, 40)).when(abstract, cap(18 * k, 60)).otherwise(cap(15 * k, 50))
    lex = F.when(exact, cap(18 * k, 50)).when(abstract, cap(8 * k, 30)).otherwise(cap(12 * k, 40))
    return vec, lex


def search_adaptive(chunks: DataFrame, queries: DataFrame, k: int = 8, reranker: Callable | None = None, diversity: float = 0.4, plain: DataFrame | None = None) -> DataFrame:
    """Hybrid search with candidates, weights and fusion constant by query; titles boost; maximal marginal relevance ends it."""
    vec_n, lex_n = budgets(F.col("query"), k)
    sized = queries.withColumns({"vec_n": vec_n, "lex_n": lex_n})
    most = min(240, 18 * k if k > 3 else 60)
    cut = lambda hits, n: _cut(hits, sized.select("query_id", F.col(n).alias("n")))
    plain = chunks if plain is None else plain
    vec, lex = cut(search.vector_search(chunks, queries, most), "vec_n"), cut(search.lexical_search(plain, queries, most), "lex_n")
    names = ["chunk_id", "doc_id", "chunk_index", "section_path", "content", *(["title"] if "title" in chunks.columns else [])]
    full = search.with_contents(search.merged(vec, lex), plain.select(*names))
    scored = full.join(search.bm25(full, queries), ["query_id", "chunk_id"]).join(queries.select("query_id", "query"), "query_id")
    fused = search.rrf(scored, weights(F.col("query")), adaptive_k(F.col("query")))
    top = search.limit_per_doc(fused, 3 * k, per_doc=3).withColumn("score", F.col("rrf"))
    if reranker:
        top = rerank(top, reranker, 3 * k)
    if "title" in chunks.columns:
        top = search.title_boost(top, 0.08 if reranker else 0.15)
    return search.mmr(top, k, diversity)


def _cut(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rn", F.row_number().over(w)).join(F.broadcast(sizes), "query_id").where("rn <= n").drop("rn", "n")


def search_expanded(chunks: DataFrame, subqueries: DataFrame, k: int = 8, plain: DataFrame | None = None) -> DataFrame:
    """Sub-queries (query_id, subquery, query, embedding) searched one by one and interleaved."""
    one = subqueries.withColumn("own", F.struct("query_id", "subquery")).select(F.concat_ws("/", F.col("query_id").cast("string"), F.col("subquery").cast("string")).alias("query_id"), "query", "embedding", "own")
    hits = search.search(chunks, one, k, plain=plain).join(one.select("query_id", "own"), "query_id")
    return search.round_robin(hits.select("own.query_id", "own.subquery", F.col("rank").alias("pos"), "chunk_id"), k)


def search_hyde(chunks: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """Hybrid search whose vector leg takes the embedding of a hypothetical answer (column hyde_embedding) where there is one."""
    vec = queries.withColumn("embedding", F.coalesce("hyde_embedding", "embedding"))
    return search.search(chunks, queries, k, vec_queries=vec)


def search_small_to_big(chunks: DataFrame, queries: DataFrame, k: int = 8, plain: DataFrame | None = None) -> DataFrame:
    """The sentence that shares most of the query's terms stands for each hit, with its neighbours; equal snippets count once."""
    hits = search.search(chunks, queries, min(4 * k, 40), plain=plain).join(queries.select("query_id", "query"), "query_id")
    score = F.size(F.array_intersect(F.array_distinct(tokens(F.col("s"))), F.array_distinct(tokens(text("query"))))) / F.greatest(F.size(F.array_distinct(tokens(text("query")))), F.lit(1))
    rows = hits.withColumn("sents", sentences(text("content"))).select("query_id", "query", "chunk_id", "rrf", "sents", F.posexplode("sents").alias("pos", "s")).withColumn("sc", score)
    best = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("sc"), "pos")
    rows = rows.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    start = F.greatest(F.col("pos") - 1, F.lit(0))
    rows = rows.select("query_id", "chunk_id", F.array_join(F.slice("sents", start + 1, F.col("pos") + 2 - start), " ").alias("snippet"), F.round(F.col("sc") * F.col("rrf"), 12).alias("score"))
    once = Window.partitionBy("query_id", F.md5("snippet")).orderBy(F.desc("score"), "chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rn", F.row_number().over(once)).where("rn = 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rn")


def search_auto(chunks: DataFrame, queries: DataFrame, subqueries: DataFrame, k: int = 8) -> DataFrame:
    """Questions of over 30 characters by a hypothetical answer, others by sub-queries."""
    long = F.length(text("query")) > 30
    deep = search_hyde(chunks, queries.where(long), k).select("query_id", "rank", "chunk_id")
    wide = search_expanded(chunks, subqueries.join(queries.where(~long).select("query_id"), "query_id", "left_semi"), k)
    return deep.unionByName(wide)


def rerank(hits: DataFrame, model: Callable[[str, list[str]], list[float]], k: int) -> DataFrame:
    """Hits scored by a model (query, contents) -> scores, scaled to 0..1 in a query; with k hits or fewer only scaled.

    Hits that begin alike are judged once.
    """
    rows = search.prefix_dedup(hits)
    own = rows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        if len(pdf) > k:
            pdf["score"] = model(pdf["query"].iloc[0], pdf["content"].tolist())
        return pdf

    scored = rows.groupBy("query_id").applyInPandas(run, own)
    w = Window.partitionBy("query_id").orderBy(F.desc("norm"), "rank")
    return search.min_max(scored).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("rank", "score").withColumnsRenamed({"place": "rank", "norm": "score"})


def rerank_windows(hits: DataFrame, ranker: Callable[[str, list[str]], list[int]], size: int = 12, step: int = 7) -> DataFrame:
    """Sliding windows from back to front: in each the ranker's order (positions, best first) replaces the old one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        order = list(range(len(pdf)))
        end = len(order)
        while True:
            start = max(0, end - size)
            part = order[start:end]
            ranked = list(dict.fromkeys(i for i in ranker(pdf["query"].iloc[0], [pdf["content"].iloc[i] for i in part]) if 0 <= i < len(part)))
            order[start:end] = [part[i] for i in ranked + [i for i in range(len(part)) if i not in ranked]]
            if start == 0:
                break
            end -= step
        return pdf.iloc[order].assign(rank=range(1, len(order) + 1))

    return hits.groupBy("query_id").applyInPandas(run, hits.schema)


def apply_order(hits: DataFrame, order: DataFrame) -> DataFrame:
    """Listed chunks (query_id, chunk_id, pos) first, others behind in their old order; the score counts down from n."""
    rows = hits.join(order.select("query_id", "chunk_id", "pos"), ["query_id", "chunk_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("pos").isNull(), "pos", "rank")
    rows = rows.withColumn("place", F.row_number().over(w))
    return rows.withColumn("score", (F.count("*").over(Window.partitionBy("query_id")) - F.col("place") + 1).cast("double")).drop("rank", "pos").withColumnRenamed("place", "rank")


def cascade(hits: DataFrame, coarse: str, fine: str, first: int = 20, k: int = 8) -> DataFrame:
    """The best `first` by one score, of them the best k by another."""
    a = Window.partitionBy("query_id").orderBy(F.desc(coarse), "chunk_id")
    b = Window.partitionBy("query_id").orderBy(F.desc(fine), "chunk_id")
    return hits.withColumn("rn", F.row_number().over(a)).where(F.col("rn") <= first).withColumn("rank", F.row_number().over(b)).where(F.col("rank") <= k).drop("rn")


def merge_bases(hits: DataFrame) -> DataFrame:
    """Hits (query_id, kb_order, rank, doc_id, ...) of several bases: with more than one base the first hit of each document."""
    bases = F.size(F.collect_set("kb_order").over(Window.partitionBy("query_id")))
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("kb_order", "rank"))
    rows = hits.withColumn("bases", bases).withColumn("first", first).where("bases = 1 OR first = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("kb_order", "rank"))).drop("bases", "first")


def in_time(hits: DataFrame, start: str, end: str, ts: str = "updated_at") -> DataFrame:
    """Hits within a time range, or without a time; all of a query's hits if none would be left."""
    ok = F.col(ts).isNull() | F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    left = F.sum(ok.cast("int")).over(Window.partitionBy("query_id"))
    return hits.withColumn("ok", ok).withColumn("left", left).where("ok OR left = 0").drop("ok", "left")


def escalate(steps: list[DataFrame], **limits) -> DataFrame:
    """The hits of the first step that are good enough for a query, of the last one else."""
    out, open_ = None, None
    for number, hits in enumerate(steps):
        mine = hits if open_ is None else hits.join(open_, "query_id", "left_semi")
        if number == len(steps) - 1:
            return mine if out is None else out.unionByName(mine)
        good = search.quality_ok(mine, **limits)
        done = mine.join(good.where("ok").select("query_id"), "query_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        known = steps[-1].select("query_id").distinct() if open_ is None else open_
        open_ = known.join(good.where("ok").select("query_id"), "query_id", "left_anti")
    raise ValueError("no steps")


def compress(hits: DataFrame, most: int = 1500) -> DataFrame:
    """query_id, n, sentence: sentences that share a term with the query, best first, until one would pass the budget."""
    rows = hits.select("query_id", "rank", "query", F.posexplode(plain_sentences(text("content"))).alias("pos", "sentence"))
    score = F.size(F.array_intersect(F.array_distinct(tokens(F.col("sentence"))), F.array_distinct(tokens(text("query")))))
    rows = rows.withColumn("score", score).where("score > 0")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos")))
    return context.prefix_budget(rows, ["query_id"], ["n"], F.length("sentence"), most).select("query_id", "n", "sentence")


def section_knowledge(hits: DataFrame, terms: DataFrame, most: int = 25, bonus: int = 2) -> DataFrame:
    """query_id, rank, sentence, score: sentences by the section's key terms they hold, `bonus` more for those with a figure."""
    rows = hits.select("query_id", "rank", F.posexplode(plain_sentences(text("content"))).alias("pos", "s"))
    keys = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    score = F.size(F.filter("terms", lambda t: F.contains(F.col("s"), t)))
    rows = rows.join(keys, "query_id").withColumn("score", score + F.when((score > 0) & F.col("s").rlike(r"\d"), bonus).otherwise(0)).where("score > 0")
    once = rows.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "s").orderBy("rank", "pos"))).where("k = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", F.col("place").alias("rank"), F.col("s").alias("sentence"), "score")


def answer_citations(hits: DataFrame, most: int = 6, chars: int = 160) -> DataFrame:
    """query_id, citations: array of the best hits with a snippet of each."""
    one = F.struct("rank", "doc_id", "chunk_id", "section_path", "score", F.substring(text("content"), 1, chars).alias("snippet"))
    return hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("citations"))


def document_text(chunks: DataFrame) -> DataFrame:
    """kb, doc_id, text: a document's chunks in order."""
    return context.joined_content(chunks, ["kb", "doc_id"], "\n").withColumnRenamed("content", "text")


def ingest(docs: DataFrame, split: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks of documents (kb, doc_id, text) with ids {kb}::{doc_id}:{n} and embeddings."""
    rows = split(docs).drop("chunk_id").join(docs.select("doc_id", "kb"), "doc_id")
    return embed(rows.withColumn("chunk_id", F.concat(F.col("kb"), F.lit("::"), F.col("doc_id").cast("string"), F.lit(":"), F.col("chunk_index").cast("string"))))


def fast_enough(sentences_: DataFrame, share: float = 0.5, least: int = 3, good: int = 2) -> DataFrame:
    """query_id, fast: whether a section's sentences (query_id, score) need no model: half of them, three at least, score `good` or more."""
    enough = F.sum((F.col("score") >= good).cast("int")) >= F.greatest(F.lit(least), F.ceil(F.count("*") * share))
    return sentences_.groupBy("query_id").agg(enough.alias("fast"))


def search_with_context(chunks: DataFrame, queries: DataFrame, k: int = 8, window: int = 1, plain: DataFrame | None = None) -> DataFrame:
    """query_id, place, chunk_id, doc_id, chunk_index, is_primary, score: hits of hybrid search with neighbours and siblings, by document and place; what surrounds a hit scores 0."""
    plain = chunks if plain is None else plain
    hits = search.search(chunks, queries, k, plain=plain)
    around = context.with_context(hits, plain, window).join(hits.select("query_id", "chunk_id", F.col("rrf").alias("score")), ["query_id", "chunk_id"], "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "chunk_index"))
    return around.select("query_id", place.alias("place"), "chunk_id", "doc_id", "chunk_index", "is_primary", F.coalesce("score", F.lit(0.0)).alias("score"))


def sentence_rerank(hits: DataFrame, k: int = 8, scored: bool = True) -> DataFrame:
    """query_id, rank, sentence: by shared terms, one more if it has a digit; not `scored`, the first ones."""
    rows = hits.select("query_id", "query", F.col("rank").alias("hit"), F.posexplode(plain_sentences(text("content"))).alias("pos", "s"))
    score = F.size(F.array_intersect(F.array_distinct(tokens(F.col("s"))), F.array_distinct(tokens(text("query"))))) + F.col("s").rlike(r"\d").cast("int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit", "pos")
    return rows.withColumn("score", score if scored else F.lit(0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("s").alias("sentence"), "score")


def _each(rows: DataFrame, *keys: str) -> DataFrame:
    """Questions whose id is made of several columns, which `own` keeps."""
    return rows.withColumn("own", F.struct(*keys)).withColumn("query_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys])).select("query_id", "query", "embedding", "own")


def search_multi_query(chunks: DataFrame, variants: DataFrame, k: int = 6, plain: DataFrame | None = None) -> DataFrame:
    """Whole multi-query search: variants (query_id, variant from 1, question, query, embedding) are searched one by one, and a
    chunk adds 1 / (fusion constant of the question + variant) for each that finds it. A question with one variant is searched plainly."""
    one = _each(variants, "query_id", "variant")
    hits = search.search(chunks, one, max(10, 2 * k), plain=plain).join(one.select("query_id", "own"), "query_id").select("own.query_id", "own.variant", "chunk_id", "doc_id", "rrf", F.col("rank").alias("pos"))
    asked = variants.groupBy("query_id").agg(F.first("question").alias("question"), F.count("*").alias("variants"))
    rows = hits.join(asked.select("query_id", "variants", adaptive_k(F.col("question")).alias("c")), "query_id")
    score = F.when(F.col("variants") > 1, 1.0 / (F.col("c") + F.col("variant"))).otherwise(F.lit(1.0) / F.col("pos"))
    total = rows.groupBy("query_id", "chunk_id", "doc_id").agg(F.round(F.sum(score), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_stepback(chunks: DataFrame, queries: DataFrame, broader: DataFrame, k: int = 6, plain: DataFrame | None = None) -> DataFrame:
    """Whole step-back search: hits of the question weigh 1.2, those of the broader one (query_id, query, embedding) 1."""
    n = max(10, 2 * k)
    own, back = (search.search(chunks, q, n, plain=plain).select("query_id", (F.col("rank") - 1).alias("pos"), "chunk_id", "doc_id") for q in (queries, broader))
    c = queries.select("query_id", adaptive_k(F.col("query")).alias("c"))
    both = own.withColumn("w", F.lit(1.2)).unionByName(back.withColumn("w", F.lit(1.0))).join(c, "query_id")
    total = both.groupBy("query_id", "chunk_id", "doc_id").agg(F.round(F.sum(F.col("w") / (F.col("c") + F.col("pos") + 1)), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ordered_union(lists: DataFrame, most: int = 20) -> DataFrame:
    """query_id, rank, chunk_id: lists (query_id, list, pos, chunk_id) one behind the other, each chunk where it comes first, `most` in all."""
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("list", "pos"))
    rows = lists.withColumn("first", first).where("first = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "pos"))).where(F.col("rank") <= most).select("query_id", "rank", "chunk_id")


def search_in_bases(bases: list[tuple[str, DataFrame]], queries: DataFrame, k: int = 5, method: Callable | None = None, time_range: tuple[str, str] | None = None) -> DataFrame:
    """Several bases (name, chunks) searched by one method; with more than one a document's first hit by base counts, and the best
    max(10, 2k) by score stay. A time range (on updated_at of the chunks) filters in the end, unless nothing would be left."""
    found = None
    for order, (name, chunks) in enumerate(bases):
        hits = (method or search_adaptive)(chunks, queries, k).select("query_id", "rank", "chunk_id", "doc_id", "score")
        if time_range:
            hits = hits.join(chunks.select("chunk_id", "updated_at"), "chunk_id")
        hits = hits.withColumns({"kb": F.lit(name), "kb_order": F.lit(order)})
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        raise ValueError("no bases")
    if len(bases) > 1:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "kb_order", "chunk_id"))
        found = merge_bases(found).drop("place", "rank").withColumn("rank", rank).where(F.col("rank") <= max(10, 2 * k))
    return in_time(found, *time_range) if time_range else found


def route(question: Column) -> Column:
    """Searches that answer a question of its kind, in order: of several the best score of a chunk counts."""
    kind = Q.classify(question)
    plan = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(kind == "conceptual", plan("multi_query", "stepback", "hyde"))
        .when(kind == "comparison", plan("multi_query"))
        .when(kind == "summary", plan("stepback"))
        .when(kind == "multi_document", plan("multi_query", "stepback"))
        .otherwise(plan("rewritten"))
    )


def route_size(question: Column, k: int) -> Column:
    """How many hits a routed search keeps."""
    kind = Q.classify(question)
    return F.when(kind == "conceptual", 4 * k).when(kind.isin("comparison", "summary"), k).when(kind == "multi_document", 3 * k).otherwise(max(10, 3 * k))


def routed(queries: DataFrame, searches: dict[str, DataFrame], k: int = 6) -> DataFrame:
    """query_id, rank, chunk_id, score: of the hits (query_id, chunk_id, score) of all searches those that a question's route asks for."""
    k = max(3, k)
    plan = queries.select("query_id", F.explode(route(F.col("query"))).alias("search"), route_size(F.col("query"), k).alias("size"))
    hits = None
    for name, rows in searches.items():
        rows = rows.select("query_id", "chunk_id", "score", F.lit(name).alias("search"))
        hits = rows if hits is None else hits.unionByName(rows)
    best = hits.join(plan, ["query_id", "search"]).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.first("size").alias("size"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return best.withColumn("rank", rank).where("rank <= size").select("query_id", "rank", "chunk_id", "score")


def low_scores(hits: DataFrame, least: float = 0.05) -> DataFrame:
    """query_id, degraded: whether no hit of a question scores over `least`, so that an answer should say it rests on general knowledge."""
    return hits.groupBy("query_id").agg((F.max("score") <= least).alias("degraded"))


def pick_snippets(rows: DataFrame, most: int = 3, chars: int = 900) -> DataFrame:
    """id, text: of a Markdown report (id, query, text) the `##` sections that hold most of the question's keywords, each cut to `chars`.

    A keyword in the title counts three times; of equal sections the shorter one comes first.
    """
    asked = rows.select("id", keywords(F.col("query")).alias("words"))
    lines = rows.select("id", F.posexplode(F.split(text("text"), "\r?\n")).alias("pos", "line")).withColumn("head", F.col("line").rlike(r"^\s*##\s+\S"))
    order = Window.partitionBy("id").orderBy("pos")
    lines = lines.withColumn("section", F.sum(F.col("head").cast("int")).over(order)).where("section > 0")
    title = F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", r"^\s*##\s+", ""))))
    parts = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    sections = lines.groupBy("id", "section").agg(title.alias("title"), parts.alias("x")).withColumn("body", strip(F.array_join("x.line", "\n"))).join(asked, "id")
    holds = lambda c: F.filter("words", lambda w: F.contains(F.lower(c), F.lower(w)))
    score = F.size(holds(F.concat("title", F.lit("\n"), "body"))) + 2 * F.size(holds(F.col("title")))
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.length("body"), "section")
    rows = sections.withColumn("score", score).where("score > 0").withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    block = cut_block(strip(F.concat(F.lit("## ["), F.col("n").cast("string"), F.lit("] "), "title", F.lit("\n"), "body")), chars)
    return rows.select("id", "n", block.alias("block")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("text"))


def reembed(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunks with vectors for those that have none."""
    done = chunks.where(F.coalesce(F.size("embedding"), F.lit(0)) > 0)
    new = embed(chunks.where(F.coalesce(F.size("embedding"), F.lit(0)) <= 0).drop("embedding"))
    return done.select(*chunks.columns).unionByName(new.select(*chunks.columns))


def summary_chunks(records: DataFrame, kb: str) -> DataFrame:
    """One coarse chunk a document (doc_type summary) of a record's title, summary and key points, for routing."""
    body = F.concat_ws("\n", F.nullif(strip(text("title")), F.lit("")), F.nullif(strip(text("summary")), F.lit("")), F.array_join(F.coalesce("key_points", F.array().cast("array<string>")), "\n"))
    rows = records.select(F.lit(kb).alias("kb"), "doc_id", F.lit(0).alias("chunk_index"), F.lit("").alias("section_path"), strip(body).alias("content"), F.lit("summary").alias("doc_type")).where("content <> ''")
    return rows.withColumn("chunk_id", F.concat(F.col("kb"), F.lit("::summary:"), F.col("doc_id").cast("string")))


class Retriever:
    """A search over fixed chunks as an object: batches of questions to hits, as adaptors of other libraries expect it."""

    def __init__(self, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 8, method: Callable = search_adaptive):
        self.chunks, self.embed, self.k, self.method = chunks, embed, k, method

    def invoke(self, questions: list[str]) -> DataFrame:
        """query_id (the place in the list), rank, chunk_id, doc_id, score, content."""
        rows = self.chunks.sparkSession.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        hits = self.method(self.chunks, self.embed(rows), self.k)
        return hits.join(self.chunks.select("chunk_id", "content"), "chunk_id").select("query_id", "rank", "chunk_id", "doc_id", "score", "content")
