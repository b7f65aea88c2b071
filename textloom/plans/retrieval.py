"""Retrieval queries over embeddings, and over documents cut into chunks with benchmark texts as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import adaptive_k, dcg
from ..functions.text import tokens
from ..operators import cells, chunking, context, postings, relevance, search
from ..operators.similar import written
from .catalog import Tables, query

SIZE = 700


def chunks(t: Tables) -> DataFrame:
    rows = chunking.fixed(t.documents.select("doc_id", "text", F.col("source").alias("kb")), SIZE, ("kb",))
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return rows.select("kb", "doc_id", "chunk_index", name.alias("chunk_id"), F.lit("").alias("section_path"), "content")


def questions(t: Tables) -> DataFrame:
    """Each benchmark text is a question."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "embedding", "label")


def vector_questions(t: Tables, every: int = 50) -> DataFrame:
    return vectors(t).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


# SQL pieces shared by the oracles
COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))), 0)"
VEC = f"""
  v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  q AS (SELECT vec_id AS query_id, label AS query_label, e AS qe FROM v WHERE vec_id % 50 = 0),
  s AS (SELECT query_id, query_label, vec_id, label, round({COS.format(a="qe", b="e")}, 6) AS score FROM q CROSS JOIN v)"""
CHUNKS = f"""
  c AS (
    SELECT kb, doc_id, i AS chunk_index, doc_id || ':' || i AS chunk_id, substr(text, i * {SIZE} + 1, {SIZE}) AS content
    FROM (SELECT source AS kb, doc_id, text, unnest(range(0, (length(text) - 1) // {SIZE} + 1))::INT AS i FROM documents WHERE length(text) > 0)),
  q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""
#: Sentences of {c}: marks are put where the engine's pattern looks around, which this SQL can't.
SENTS = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '([。！？；\\n])\\s*', '\\1' || chr(1), 'g'), '([.!?;])\\s+([A-Z一-鿿])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), "
    "lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: length(x) >= 3)"
)


def first_distinct(list_: str, n: int) -> str:
    """SQL: the first n distinct elements of a list, in order."""
    return f"list_slice(list_filter({list_}, lambda x, i: list_position({list_}, x) = i), 1, {n})"


LEX = f"""
  qt AS (SELECT query_id, {first_distinct("r", 12)} AS terms FROM (SELECT query_id, regexp_extract_all(lower(query), '[一-鿿a-z0-9]{{2,}}') AS r FROM q)),
  lex AS (
    SELECT query_id, chunk_id, score FROM (
      SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM (
        SELECT query_id, chunk_id, round(len(list_filter(terms, lambda t: contains(lower(content), t))) / len(terms), 6) AS score
        FROM qt CROSS JOIN c WHERE len(terms) > 0) WHERE score > 0)
    WHERE rn <= 80)"""
TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
BM = f"""
  toks AS (SELECT query_id, chunk_id, list_slice(list_transform({TOK.format(c="content")}, lambda t: substr(t, 1, 32)), 1, 160) AS t FROM cand JOIN c USING (chunk_id)),
  per AS (SELECT query_id, count(*) AS n, avg(greatest(len(t), 1)) AS avgdl FROM toks GROUP BY query_id),
  qterm AS (SELECT query_id, unnest({first_distinct("r", 24)}) AS term FROM (SELECT query_id, list_transform({TOK.format(c="query")}, lambda t: substr(t, 1, 32)) AS r FROM q)),
  tf AS (SELECT query_id, chunk_id, dl, term, count(*) AS f FROM (SELECT query_id, chunk_id, greatest(len(t), 1) AS dl, unnest(t) AS term FROM toks) JOIN qterm USING (query_id, term) GROUP BY ALL),
  df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
  bm AS (
    SELECT query_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
    FROM tf JOIN df USING (query_id, term) JOIN per USING (query_id) GROUP BY ALL),
  bm25 AS (SELECT query_id, chunk_id, round(coalesce(s, 0), 6) AS bm25 FROM toks LEFT JOIN bm USING (query_id, chunk_id))"""
EMB = f"""
  ce AS (SELECT chunk_id, list_transform(range(0, 64), lambda k: CAST(len(list_filter(h, lambda x: x = k)) AS DOUBLE)) AS e FROM (
    SELECT chunk_id, list_transform(list_transform({TOK.format(c="content")}, lambda t: substr(t, 1, 32)), lambda t: CAST('0x' || substr(md5(t), 1, 4) AS INT) % 64) AS h FROM c)),
  qe AS (SELECT query_id, list_transform(range(0, 64), lambda k: CAST(len(list_filter(h, lambda x: x = k)) AS DOUBLE)) AS e FROM (
    SELECT query_id, list_transform(list_transform({TOK.format(c="query")}, lambda t: substr(t, 1, 32)), lambda t: CAST('0x' || substr(md5(t), 1, 4) AS INT) % 64) AS h FROM q)),
  vec AS (SELECT * FROM (
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM (
      SELECT query_id, chunk_id, round(coalesce({COS.format(a="qe.e", b="ce.e")}, 0), 6) AS score FROM qe CROSS JOIN ce WHERE list_sum(qe.e) > 0))
    WHERE rn <= 80)"""
K_SQL = """CASE WHEN regexp_matches(query, '\\d') OR regexp_matches(query, '[A-Z]{2,}|[A-Z]+/[A-Z]+') THEN 30 WHEN length(query) > 60 THEN 96 ELSE 60 END"""
FUSED = f"""
  cand AS (SELECT query_id, chunk_id, coalesce(v.score, 0) AS vec, coalesce(l.score, 0) AS lex,
      row_number() OVER (PARTITION BY query_id ORDER BY v.score IS NULL, v.score DESC NULLS LAST, l.score DESC NULLS LAST, chunk_id) AS merge_pos
    FROM vec v FULL JOIN lex l USING (query_id, chunk_id)),
  {BM},
  ranked AS (SELECT cand.*, bm25, query, row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, merge_pos) AS rv,
      row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, merge_pos) AS rb, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, merge_pos) AS rl
    FROM cand JOIN bm25 USING (query_id, chunk_id) JOIN q USING (query_id)),
  fused AS (SELECT *, round(1.0::DOUBLE / ({K_SQL} + rv) + 1.0::DOUBLE / ({K_SQL} + rb) + 1.0::DOUBLE / ({K_SQL} + rl), 9) AS rrf FROM ranked JOIN c USING (chunk_id)),
  own AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rrf DESC, merge_pos) AS rn FROM fused),
  doc AS (SELECT *, round(sum(CASE WHEN rn <= 3 THEN rrf END) OVER (PARTITION BY query_id, doc_id), 9) AS doc_score FROM own),
  final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id, rn) AS rank FROM doc WHERE rn <= 2)"""


def fused_sql(questions_: str = "", k: str = K_SQL, candidates: int = 80, lex: str = "", vec: str = "", weights: tuple[str, str, str] = ("1.0::DOUBLE",) * 3, per_doc: int = 2) -> str:
    """The CTEs of a hybrid search up to `final`: with other questions (CTE q), fusion constant, candidates, weights and hits of a document."""
    chunks_ = CHUNKS[: CHUNKS.index("  q AS")] + questions_ if questions_ else CHUNKS
    fused = FUSED.replace(K_SQL, k)
    for signal, weight in zip(("rv", "rb", "rl"), weights, strict=True):
        fused = fused.replace(f"1.0::DOUBLE / ({k} + {signal})", f"{weight} / ({k} + {signal})")
    fused = fused.replace("WHERE rn <= 2)", f"WHERE rn <= {per_doc})")
    lexical = LEX.replace("WHERE rn <= 80", f"WHERE rn <= {candidates}" if not lex else f"z WHERE rn <= (SELECT {lex} FROM q qq WHERE qq.query_id = z.query_id)")
    vector = EMB.replace("WHERE rn <= 80", f"WHERE rn <= {candidates}" if not vec else f"WHERE rn <= (SELECT {vec} FROM q qq WHERE qq.query_id = z.query_id)")
    if vec:
        vector = vector.replace(")\n    WHERE rn <=", ") z\n    WHERE rn <=")
    return f"{chunks_}, {lexical}, {vector}, {fused}"


@query(f"WITH {VEC} SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10")
def vec_topk_batch(t: Tables) -> DataFrame:
    return search.vector_search(vectors(t), vector_questions(t), 10, key="vec_id")


@query(f"WITH {VEC} SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10")
def vec_topk_cells(t: Tables) -> DataFrame:
    """The same over a written table of cells, of which bounds rule most out."""
    return cells.CellTable(vectors(t), "vec_id").search(vector_questions(t), 10)


@query(f"WITH {VEC} SELECT query_id, vec_id, score FROM s WHERE query_id = 0 ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk(t: Tables) -> DataFrame:
    return search.vector_search(vectors(t), vector_questions(t).where("query_id = 0"), 10, key="vec_id")


@query(f"WITH {VEC} SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE label = 3) WHERE rn <= 5")
def vec_topk_filtered(t: Tables) -> DataFrame:
    return search.vector_search(search.filtered(vectors(t).withColumnRenamed("label", "kb"), kb=3), vector_questions(t), 5, key="vec_id")


@query("""SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS sq, len(embedding)::INT AS dims FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0""")
def vec_valid(t: Tables) -> DataFrame:
    from ..functions.metrics import dot

    return vectors(t).where(F.size("embedding") > 0).select("vec_id", "label", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("sq"), F.size("embedding").alias("dims"))


@query("SELECT label AS kb, count(*) AS missing FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0 GROUP BY label")
def empty_embeddings(t: Tables) -> DataFrame:
    return t.embeddings.where("embedding IS NULL OR size(embedding) = 0").groupBy(F.col("label").alias("kb")).agg(F.count("*").alias("missing"))


@query(f"""WITH {VEC}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE vec_id <> query_id)
  SELECT query_id, round(avg((label = query_label)::INT), 6) AS precision10, round(coalesce(max(CASE WHEN label = query_label THEN 1.0::DOUBLE / rn END), 0), 6) AS mrr,
    round(sum(CASE WHEN label = query_label THEN 1.0::DOUBLE / log2(rn + 1) ELSE 0 END) / sum(1.0::DOUBLE / log2(rn + 1)), 6) AS ndcg10
  FROM top WHERE rn <= 10 GROUP BY query_id""")
def ir_mrr_ndcg(t: Tables) -> DataFrame:
    hits = search.vector_search(vectors(t), vector_questions(t), 11, key="vec_id").where("vec_id <> query_id")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    rows = hits.withColumn("rn", rn).where("rn <= 10").join(vectors(t).select("vec_id", "label"), "vec_id").join(vector_questions(t).select("query_id", "query_label"), "query_id")
    gain = (F.col("label") == F.col("query_label")).cast("double")
    return rows.groupBy("query_id").agg(F.round(F.avg(gain), 6).alias("precision10"), F.round(F.max(gain / F.col("rn")), 6).alias("mrr"), F.round(F.sum(dcg(gain, F.col("rn"))) / F.sum(dcg(F.lit(1.0), F.col("rn"))), 6).alias("ndcg10"))


@query(f"""WITH {VEC}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE vec_id <> query_id),
  rel AS (SELECT label, count(*) AS n FROM v GROUP BY label)
  SELECT query_id, round(count(*) FILTER (t.label = query_label) / least(max(n) - 1, 10), 6) AS recall10 FROM top t JOIN rel ON rel.label = query_label WHERE rn <= 10 GROUP BY query_id""")
def knn_by_label_recall(t: Tables) -> DataFrame:
    hits = search.vector_search(vectors(t), vector_questions(t), 11, key="vec_id").where("vec_id <> query_id")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    rows = hits.withColumn("rn", rn).where("rn <= 10").join(vectors(t).select("vec_id", "label"), "vec_id").join(vector_questions(t).select("query_id", "query_label"), "query_id")
    relevant = vectors(t).groupBy(F.col("label").alias("query_label")).agg(F.count("*").alias("n"))
    return rows.join(relevant, "query_label").groupBy("query_id").agg(F.round(F.sum((F.col("label") == F.col("query_label")).cast("int")) / F.least(F.max("n") - 1, F.lit(10)), 6).alias("recall10"))


@query(f"WITH {CHUNKS}, {LEX} SELECT * FROM lex")
def lexical_topk(t: Tables) -> DataFrame:
    return search.lexical_search(chunks(t), questions(t), 80)


@query(f"WITH {CHUNKS}, {LEX} SELECT * FROM lex")
def lexical_topk_postings(t: Tables) -> DataFrame:
    """The same by written trigram postings."""
    index = postings.TrigramIndex(chunks(t))
    found = written(index.search(questions(t), 80))
    index.drop()
    return found


TERMS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query(f"""WITH {CHUNKS}, tf AS (SELECT chunk_id, term, count(*) AS f FROM (SELECT chunk_id, unnest({TERMS.format(c="content")}) AS term FROM c) GROUP BY ALL),
  per AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(f) DESC, term LIMIT 2000),
  w AS (SELECT chunk_id, term, f * idf / sqrt(sum(f * idf * f * idf) OVER (PARTITION BY chunk_id)) AS w FROM tf JOIN per USING (term)),
  qf AS (SELECT query_id, term, count(*) AS f FROM (SELECT query_id, unnest({TERMS.format(c="query")}) AS term FROM q) GROUP BY ALL),
  qw AS (SELECT query_id, term, f * idf / sqrt(sum(f * idf * f * idf) OVER (PARTITION BY query_id)) AS w FROM qf JOIN per USING (term)),
  s AS (SELECT query_id, chunk_id, round(sum(qw.w * w.w), 6) AS score FROM qw JOIN w USING (term) GROUP BY ALL)
  SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM s WHERE score > 0) WHERE rn <= 10""")
def tfidf_topk(t: Tables) -> DataFrame:
    """The best chunks of all documents for each benchmark text by TF-IDF."""
    return relevance.tfidf_top_k(chunks(t), questions(t))[0]


@query(f"WITH {CHUNKS}, {LEX}, cand AS (SELECT query_id, chunk_id FROM lex), {BM} SELECT * FROM bm25")
def bm25_scores(t: Tables) -> DataFrame:
    rows = chunks(t)
    hits = search.lexical_search(rows, questions(t), 80)
    return search.bm25(search.with_contents(hits, rows.select("chunk_id", "content")), questions(t))


def _scored(t: Tables) -> DataFrame:
    rows = chunks(t)
    return search.search(search.embedded(rows, "content"), search.embedded(questions(t), "query"), 8, adaptive_k(F.col("query")), plain=rows)


@query(f"WITH {CHUNKS}, {LEX}, {EMB}, {FUSED} SELECT query_id, rank, chunk_id, doc_id, vec, bm25, lex, rrf, doc_score FROM final WHERE rank <= 8", rank="INT")
def hybrid_search(t: Tables) -> DataFrame:
    return _scored(t).select("query_id", "rank", "chunk_id", "doc_id", "vec", "bm25", "lex", "rrf", "doc_score")


SIGNALS = f"""WITH {VEC}, a AS (SELECT query_id, vec_id, score AS vec, round(1.0::DOUBLE / (1 + abs(vec_id - query_id)), 9) AS lex,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS merge_pos FROM s),
  p AS (SELECT * FROM a WHERE merge_pos <= 50),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, merge_pos) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, merge_pos) AS r2 FROM p)"""


def _signals(t: Tables) -> DataFrame:
    """The 50 best candidates of each query with a second signal, nearness of ids."""
    hits = search.vector_search(vectors(t), vector_questions(t), 50, key="vec_id")
    rows = hits.select("query_id", "vec_id", F.col("score").alias("vec"), F.round(1.0 / (1 + F.abs(F.col("vec_id") - F.col("query_id"))), 9).alias("lex"))
    return rows.withColumn("merge_pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vec"), "vec_id")))


@query(f"{SIGNALS} SELECT query_id, vec_id, round(1.15::DOUBLE / (60 + r1) + 0.9::DOUBLE / (60 + r2), 9) AS rrf FROM r")
def rrf_fusion(t: Tables) -> DataFrame:
    return search.rrf(_signals(t), {"vec": 1.15, "lex": 0.9}).select("query_id", "vec_id", "rrf")


@query(f"""{SIGNALS}, f AS (SELECT r.*, label AS doc_id, round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 9) AS rrf FROM r JOIN embeddings USING (vec_id)),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rrf DESC, merge_pos) AS rn FROM f),
  d AS (SELECT *, round(sum(CASE WHEN rn <= 3 THEN rrf END) OVER (PARTITION BY query_id, doc_id), 9) AS doc_score FROM o),
  z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id, rn) AS rank FROM d WHERE rn <= 2)
  SELECT query_id, rank, vec_id, doc_id, doc_score FROM z WHERE rank <= 8""", rank="INT")
def doc_agg_top2(t: Tables) -> DataFrame:
    rows = search.rrf(_signals(t), {"vec": 1.0, "lex": 1.0}).join(t.embeddings.select("vec_id", F.col("label").alias("doc_id")), "vec_id")
    return search.limit_per_doc(rows, 8).select("query_id", "rank", "vec_id", "doc_id", "doc_score")


LISTS = f"""WITH {VEC}, l AS (SELECT query_id // 200 AS query_id, query_id % 200 // 50 AS subquery, vec_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS pos FROM s)"""


def _lists(t: Tables) -> DataFrame:
    hits = search.vector_search(vectors(t), vector_questions(t), 12, key="vec_id")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")) - 1
    return hits.withColumn("pos", pos).select(F.floor(F.col("query_id") / 200).alias("query_id"), F.floor(F.col("query_id") % 200 / 50).alias("subquery"), F.col("vec_id").alias("chunk_id"), "score", "pos")


@query(f"""{LISTS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos, subquery) AS n FROM l WHERE pos < 12),
  o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, subquery) AS rank FROM f WHERE n = 1) SELECT * FROM o WHERE rank <= 10""", rank="INT")
def round_robin(t: Tables) -> DataFrame:
    return search.round_robin(_lists(t), 10)


@query(f"""{LISTS}, m AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + subquery)), 9) AS score FROM l WHERE pos < 12 GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) WHERE rank <= 10""", rank="INT")
def multi_query_rrf(t: Tables) -> DataFrame:
    return search.merge_variants(_lists(t).withColumn("variant", F.col("subquery")), 10)


@query(f"""{LISTS}, m AS (SELECT query_id, chunk_id, round(sum(CASE WHEN subquery = 0 THEN 1.2 ELSE 1.0 END::DOUBLE / (60 + pos + 1)), 9) AS score FROM l WHERE pos < 12 AND subquery < 2 GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) WHERE rank <= 10""", rank="INT")
def stepback_rrf(t: Tables) -> DataFrame:
    rows = _lists(t).select("query_id", "pos", "chunk_id", "subquery")
    return search.merge_stepback(rows.where("subquery = 0").drop("subquery"), rows.where("subquery = 1").drop("subquery"), 10)


@query(f"{LISTS} SELECT query_id, chunk_id, max(score) AS score FROM l WHERE pos < 12 GROUP BY ALL")
def best_per_chunk(t: Tables) -> DataFrame:
    return search.best_per_chunk(_lists(t))


@query(f"""{LISTS}, b AS (SELECT query_id, chunk_id, max(score) AS score FROM l WHERE pos < 12 GROUP BY ALL)
  SELECT *, round(CASE WHEN n < 2 OR hi = lo THEN score ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM (
    SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY query_id))""".replace("SELECT *, round(CASE", "SELECT query_id, chunk_id, score, round(CASE"))
def min_max_norm(t: Tables) -> DataFrame:
    return search.min_max(search.best_per_chunk(_lists(t)))


HITS = f"""WITH {CHUNKS}, {LEX}, h AS (SELECT query_id, doc_id, chunk_index, chunk_id, content, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex JOIN c USING (chunk_id))"""


def _hits(t: Tables, most: int = 40) -> DataFrame:
    """The best hits of every question by lexical search over all chunks."""
    rows = chunks(t)
    found = search.with_contents(search.lexical_search(rows, questions(t), most), rows)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


@query(f"{HITS} SELECT h.query_id, h.chunk_id AS center_id, c.doc_id, c.chunk_index, c.chunk_id FROM h JOIN c ON c.doc_id = h.doc_id AND abs(c.chunk_index - h.chunk_index) <= 2 AND c.chunk_index <> h.chunk_index WHERE rank <= 40")
def neighbor_expand(t: Tables) -> DataFrame:
    return context.neighbours(_hits(t), chunks(t), 2)


@query(f"{HITS} SELECT h.query_id, h.chunk_id AS center_id, c.doc_id, c.chunk_index, c.chunk_id FROM h JOIN c ON c.doc_id = h.doc_id AND c.chunk_index // 4 = h.chunk_index // 4 AND c.chunk_id <> h.chunk_id WHERE rank <= 40")
def parent_group(t: Tables) -> DataFrame:
    return context.siblings(_hits(t), chunks(t))


@query(f"""{HITS}, x AS (SELECT query_id, doc_id, chunk_index, chunk_id, true AS p FROM h WHERE rank <= 40 UNION ALL
    SELECT h.query_id, c.doc_id, c.chunk_index, c.chunk_id, false FROM h JOIN c ON c.doc_id = h.doc_id AND c.chunk_id <> h.chunk_id AND (abs(c.chunk_index - h.chunk_index) <= 1 OR c.chunk_index // 4 = h.chunk_index // 4) WHERE rank <= 40)
  SELECT query_id, doc_id, chunk_index, chunk_id, max(p) AS is_primary FROM x GROUP BY ALL""")
def search_with_context(t: Tables) -> DataFrame:
    return context.with_context(_hits(t), chunks(t))


ISLANDS = f"""{HITS}, k AS (SELECT *, CASE WHEN chunk_index - lag(chunk_index) OVER w <= 1 THEN 0 ELSE 1 END AS start FROM h WHERE rank <= 40 WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY chunk_index)),
  i AS (SELECT *, sum(start) OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS island FROM k),
  seg AS (SELECT query_id, doc_id, island, min(chunk_index) AS first_index, max(chunk_index) AS last_index, max(score) AS score, string_agg(content, chr(10) ORDER BY chunk_index) AS content FROM i GROUP BY ALL)"""


@query(f"{ISLANDS} SELECT query_id, doc_id, first_index, last_index, score, md5(content) AS content_md5 FROM seg")
def context_islands(t: Tables) -> DataFrame:
    return context.islands(_hits(t)).select("query_id", "doc_id", "first_index", "last_index", "score", F.md5("content").alias("content_md5"))


@query(f"""{ISLANDS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, first_index) AS segment FROM seg),
  t AS (SELECT query_id, doc_id, island, string_agg(regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', ''), chr(10) || chr(10) ORDER BY chunk_index) AS body FROM i GROUP BY ALL),
  b AS (SELECT query_id, segment, regexp_replace(printf('[%d] doc=%s section=%s score=%.3f', segment, doc_id::VARCHAR, '-', score) || chr(10) || body, '\\s+$', '') AS block FROM n JOIN t USING (query_id, doc_id, island)),
  u AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY segment) AS used FROM b)
  SELECT query_id, segment, md5(block) AS block_md5 FROM u WHERE used <= 5200""", segment="INT")
def context_budget(t: Tables) -> DataFrame:
    return context.assemble(_hits(t)).select("query_id", "segment", F.md5("block").alias("block_md5"))


@query(f"""{HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) <= 2 AS first FROM h WHERE rank <= 40),
  g AS (SELECT *, sum(first::INT) OVER (PARTITION BY query_id ORDER BY rank) AS taken FROM f),
  o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, rank) AS place FROM g WHERE (first AND taken <= 6) OR (NOT first AND taken < 6))
  SELECT * FROM o WHERE place <= 10""", place="INT")
def per_doc_backfill(t: Tables) -> DataFrame:
    return context.backfill(_hits(t), 6, 10).select("query_id", "chunk_id", "place")


@query(f"""{HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) = 1 AS own FROM h WHERE rank <= 40),
  g AS (SELECT *, own AND sum(own::INT) OVER (PARTITION BY query_id ORDER BY rank) <= 15 AS lead_ FROM f),
  u AS (SELECT *, count(*) OVER (PARTITION BY query_id) >= 6 AND sum(lead_::INT) OVER (PARTITION BY query_id) >= 3 AS ok FROM g)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY ok AND lead_ DESC, rank) AS place FROM u""", place="INT")
def diverse_reorder(t: Tables) -> DataFrame:
    return context.diverse_first(_hits(t)).select("query_id", "chunk_id", "place")


@query(f"""WITH {CHUNKS}, p AS (SELECT kb AS query_id, doc_id, chunk_index, trim(substr(content, 1, 80), ' ') AS prefix FROM c)
  SELECT query_id, doc_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY query_id, prefix ORDER BY doc_id, chunk_index) AS n FROM p) WHERE n = 1 OR prefix = ''""")
def prefix_dedup(t: Tables) -> DataFrame:
    """All chunks of a base, in document order."""
    rows = chunks(t).withColumn("query_id", F.col("kb")).withColumn("rank", F.struct("doc_id", "chunk_index"))
    return search.prefix_dedup(rows).select("query_id", "doc_id", "chunk_index")


@query(f"""{HITS} SELECT query_id, coalesce(list_sort(list(score), 'DESC')[3], 0) >= 0.5 OR (count(*) >= 5 AND avg(score) >= 0.2 AND count(DISTINCT doc_id) >= 2) AS ok FROM h WHERE rank <= 40 GROUP BY query_id""")
def retrieval_quality(t: Tables) -> DataFrame:
    return search.quality_ok(_hits(t), 0.2, 2, 5)


@query(f"""{HITS}, l AS (SELECT query_id, rank AS n, printf('【%d】%s (来源: %s)', rank, substr(content, 1, 300), '2024, d' || doc_id) AS line FROM h WHERE rank <= 8),
  u AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY n) AS used FROM l) SELECT query_id, n, md5(line) AS line_md5 FROM u WHERE used <= 2000""", n="INT")
def annotated_context(t: Tables) -> DataFrame:
    rows = _hits(t).withColumn("year", F.lit("2024")).withColumn("file", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return context.annotate(rows, 8, 300, 2000).select("query_id", "n", F.md5("line").alias("line_md5"))


MMR = f"""{HITS}, s1 AS (SELECT query_id, chunk_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM h WHERE rank <= 40)"""


def _mmr_sql(k: int) -> str:
    """Maximal marginal relevance step by step: each adds the hit that is best against those chosen so far."""
    out = f"{MMR}, t1 AS (SELECT *, 1 AS place FROM s1 WHERE rn = 1)"
    for n in range(2, k + 1):
        out += f""", t{n} AS (SELECT * FROM t{n - 1} UNION ALL SELECT query_id, chunk_id, doc_id, score, rn, {n} FROM (
          SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY 0.4::DOUBLE * s.score - 0.6::DOUBLE * CASE WHEN EXISTS (SELECT 1 FROM t{n - 1} x WHERE x.query_id = s.query_id AND x.doc_id = s.doc_id) THEN 0.5::DOUBLE ELSE 0::DOUBLE END DESC, s.rn) AS z
          FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM t{n - 1} x WHERE x.query_id = s.query_id AND x.chunk_id = s.chunk_id)) WHERE z = 1)"""
    return out + f" SELECT query_id, place AS rank, chunk_id, doc_id, score FROM t{k}"


@query(_mmr_sql(4), rank="INT")
def mmr(t: Tables) -> DataFrame:
    return search.mmr(_hits(t), 4)


@query()
def greedy_near_dup(t: Tables) -> DataFrame:
    return search.drop_similar(_hits(t))


@query(f"""{HITS}, x AS (SELECT query_id, chunk_id, {SENTS.format(c="content")} AS sents FROM h WHERE rank <= 40), p AS (SELECT query_id, chunk_id, sents, unnest(sents) AS s, generate_subscripts(sents, 1) AS pos FROM x),
  k AS (SELECT *, len(list_distinct(list_transform({TOK.format(c="s")}, lambda t: substr(t, 1, 32)))) AS sc FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sc DESC, pos) AS rn FROM k)
  SELECT query_id, chunk_id, md5(array_to_string(sents[greatest(pos - 1, 1):pos + 1], ' ')) AS snippet, sc AS sentence_score FROM b WHERE rn = 1""", sentence_score="INT")
def best_sentences(t: Tables) -> DataFrame:
    return context.best_sentences(_hits(t), F.size(F.array_distinct(tokens(F.col("s"))))).withColumn("snippet", F.md5("snippet"))


HIER = f"""WITH {CHUNKS}, {EMB.split("  vec AS")[0].rstrip().rstrip(",")}, x AS (SELECT query_id, chunk_id, doc_id, chunk_index, round(coalesce({COS.format(a="qe.e", b="ce.e")}, 0), 6) AS score FROM qe CROSS JOIN ce JOIN c USING (chunk_id) WHERE list_sum(qe.e) > 0),
  co AS (SELECT DISTINCT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM x WHERE chunk_index = 0) WHERE rn <= 3)
  SELECT query_id, chunk_id, score, doc_id, rank FROM (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x SEMI JOIN co USING (query_id, doc_id)) WHERE rank <= 8"""


@query(HIER, rank="INT")
def search_hierarchical(t: Tables) -> DataFrame:
    rows = chunks(t)
    return search.hierarchical(rows, rows.where("chunk_index = 0"), search.embedded(questions(t), "query"), 8, embed=lambda x: search.embedded(x, "content"))
