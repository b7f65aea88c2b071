"""Queries of the application layer: reranking, several bases, outlines, verdicts, versions, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answering, facts, fuzzy, matching, records, review, search
from .catalog import Tables, query
from .retrieval import HITS, LISTS, SENTS, TOK, VEC, _hits, _lists, chunks, fused_sql, questions, vector_questions, vectors


@query(f"""{LISTS}, b AS (SELECT query_id, chunk_id, max(score) AS score, min(pos) AS pos FROM l WHERE pos < 12 GROUP BY ALL),
  c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM b),
  d AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos DESC, chunk_id) AS rank FROM c WHERE rn <= 20) SELECT * FROM d WHERE rank <= 8""", rank="INT")
def cascade_topk(t: Tables) -> DataFrame:
    rows = _lists(t).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    return answering.cascade(rows, "score", "pos").select("query_id", "chunk_id", "rank")


@query(f"""{HITS}, o AS (SELECT query_id, chunk_id, rank, CASE WHEN rank % 5 = 0 THEN -rank END AS pos FROM h WHERE rank <= 40),
  p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos IS NULL, pos, rank) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM o)
  SELECT query_id, chunk_id, rank, (n - rank + 1)::DOUBLE AS score FROM p""", rank="INT")
def listwise_order(t: Tables) -> DataFrame:
    hits = _hits(t).select("query_id", "chunk_id", "rank", "score")
    order = hits.where("rank % 5 = 0").select("query_id", "chunk_id", (-F.col("rank")).alias("pos"))
    return answering.apply_order(hits, order).select("query_id", "chunk_id", "rank", "score")


@query(f"""{HITS}, k AS (SELECT query_id, doc_id % 3 AS kb_order, rank, doc_id, chunk_id FROM h WHERE rank <= 40),
  f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY kb_order, rank) AS n FROM k)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_order, rank) AS place FROM f WHERE n = 1""", place="INT")
def multi_kb_merge(t: Tables) -> DataFrame:
    rows = _hits(t).withColumn("kb_order", F.col("doc_id") % 3)
    return answering.merge_bases(rows).select("query_id", "chunk_id", "place")


@query("""WITH e AS (SELECT user_id AS query_id, event_id, ts, ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08' AS ok FROM events)
  SELECT query_id, event_id FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY query_id) AS n FROM e) WHERE ok OR n = 0""")
def time_range_hits(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("query_id"), "event_id", F.col("ts").alias("updated_at"))
    return answering.in_time(rows, "2024-01-05", "2024-01-08").select("query_id", "event_id")


HEADS = "hd AS (SELECT n_regionkey AS doc_id, n_nationkey AS order_index, 1 + n_nationkey * 7 % 3 AS level, n_name AS title FROM nation)"


def _headings(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("order_index"), (1 + F.col("n_nationkey") * 7 % 3).alias("level"), F.col("n_name").alias("title"))


@query(f"""WITH {HEADS}, w AS (SELECT *, CASE level WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS wt FROM hd)
  SELECT doc_id, order_index, greatest(floor(3000 / greatest(sum(wt) OVER (PARTITION BY doc_id), 1)::DOUBLE * wt)::INT, CASE level WHEN 2 THEN 150 WHEN 3 THEN 80 ELSE 0 END) AS words FROM w""")
def word_budget(t: Tables) -> DataFrame:
    return review.word_budget(_headings(t), 3000).select("doc_id", "order_index", "words")


@query(f"WITH {HEADS} SELECT a.doc_id, a.order_index, (SELECT min(b.order_index) FROM hd b WHERE b.doc_id = a.doc_id AND b.order_index > a.order_index AND b.level <= a.level) AS end_index FROM hd a")
def section_range(t: Tables) -> DataFrame:
    return review.subtree_end(_headings(t)).select("doc_id", "order_index", "end_index")


@query(f"""WITH {HEADS}, j AS (SELECT *, level - coalesce(lag(level) OVER (PARTITION BY doc_id ORDER BY order_index), 0) > 1 AS jump FROM hd)
  SELECT doc_id, count(*) FILTER (level = 2) AS h2, count(*) FILTER (level = 3) AS h3, array_to_string(list_filter([CASE WHEN count(*) FILTER (level = 2) < 2 THEN 'few' END, CASE WHEN max(jump) THEN 'jump' END], lambda x: x IS NOT NULL), ',') AS issues FROM j GROUP BY doc_id""")
def outline_issues(t: Tables) -> DataFrame:
    return review.outline_issues(_headings(t)).select("doc_id", "h2", "h3", F.array_join("issues", ",").alias("issues"))


@query(f"""WITH {HEADS}, c AS (SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY doc_id) > 1 AS many, sum((level < 1)::INT) OVER w AS g1, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3 FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY order_index)),
  n AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc_id ORDER BY order_index) AS n1, sum((level = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY order_index) AS n2, sum((level = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY order_index) AS n3 FROM c)
  SELECT doc_id, order_index, concat_ws('.', CASE WHEN many THEN n1 END, CASE WHEN level >= 2 THEN n2 END, CASE WHEN level >= 3 THEN n3 END) AS number FROM n""")
def outline_numbering(t: Tables) -> DataFrame:
    return facts.numbered(_headings(t)).select("doc_id", "order_index", "number")


@query("""WITH o AS (SELECT source AS doc_id, doc_id AS title, text AS body FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT source AS doc_id, doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS body FROM documents WHERE doc_id % 2 = 0)
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.title, n.title) AS title, CASE WHEN o.title IS NULL THEN 'added' WHEN n.title IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.title = n.title WHERE o.body IS DISTINCT FROM n.body""")
def changed_sections(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("title"), F.col("text").alias("body"))
    new = d.where("title % 2 = 0").withColumn("body", F.when(F.col("title") % 4 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return review.changed_sections(d.where("title % 3 <> 0"), new)


@query("SELECT doc_id % 20 AS id, round(avg(quality), 6) AS score FROM labels GROUP BY 1")
def factscore(t: Tables) -> DataFrame:
    return review.factscore(t.labels.select((F.col("doc_id") % 20).alias("id"), (F.col("quality") == 1).alias("ok")))


@query("""WITH p AS (SELECT user_id AS doc_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT doc_id, round(1 - avg((abs(value - nxt) > 5)::INT), 6) AS score FROM p WHERE nxt IS NOT NULL GROUP BY doc_id""")
def consistency_score(t: Tables) -> DataFrame:
    nxt = F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select(F.col("user_id").alias("doc_id"), "value", nxt.alias("nxt")).where("nxt IS NOT NULL")
    return review.consistency(rows.select("doc_id", (F.abs(F.col("value") - F.col("nxt")) > 5).alias("flag")))


@query("""SELECT user_id AS doc_id, CASE event_type WHEN 'error' THEN '高' WHEN 'purchase' THEN '中' ELSE '低' END AS severity, count(*) AS issues, event_type_ <> '高' AS fixable FROM (SELECT *, CASE event_type WHEN 'error' THEN '高' ELSE '低' END AS event_type_ FROM events) GROUP BY ALL""")
def critic_severities(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "高").when(F.col("event_type") == "purchase", "中").otherwise("低")
    return review.severities(t.events.select(F.col("user_id").alias("doc_id"), kind.alias("severity")))


@query("SELECT doc_id, length(text) < 200 OR ((length(text) < 2000 OR len(regexp_extract_all(text, '(?m)^##\\s')) < 3) AND len(regexp_extract_all(text, '\\d')) = 0) AS skip FROM documents")
def critic_skip(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", review.skip_critic(F.col("text"), F.regexp_count("text", F.lit(r"\d"))).alias("skip"))


@query("""WITH x AS (SELECT b.item_id AS id, regexp_extract_all(lower(b.text), '[a-z]{4,}') AS terms, lower(d.text) AS body FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
  s AS (SELECT id, list_slice(terms, 1, 3) AS f, body FROM x)
  SELECT id, round(avg((len(list_filter(f, lambda t: contains(body, t))) >= greatest(1, len(f) // 2))::INT), 6) AS coverage FROM s GROUP BY id""")
def aspect_coverage(t: Tables) -> DataFrame:
    """Documents are dealt to all items."""
    b = t.benchmark.select(F.col("item_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0).alias("terms"))
    return review.aspect_coverage(t.documents.select((F.col("doc_id") % t.benchmark.count()).alias("id"), F.lower("text").alias("body")).join(b, "id"))


@query(f"""WITH {VEC}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE vec_id <> query_id),
  n AS (SELECT query_id, count(*) AS n FROM q JOIN v ON v.label = q.query_label AND v.vec_id <> q.query_id GROUP BY 1),
  g AS (SELECT query_id, count(*) FILTER (label = query_label) AS g, count(*) AS d, max(CASE WHEN label = query_label THEN 1.0::DOUBLE / rank END) AS mrr, sum(CASE WHEN label = query_label THEN 1.0::DOUBLE / log2(rank + 1) END) AS dcg FROM top WHERE rank <= 5 GROUP BY 1)
  SELECT query_id, round(coalesce(g / n, 0), 6) AS recall, round(coalesce(g / d, 0), 6) AS precision, round(coalesce(mrr, 0), 6) AS mrr,
    round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN g USING (query_id)""")
def retrieval_metrics(t: Tables) -> DataFrame:
    """Vectors of a question's own label are relevant: they are counted by label, not listed."""
    asked = vector_questions(t).select("query_id", "query_label")
    hits = search.vector_search(vectors(t), vector_questions(t), 6, key="vec_id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    judged = hits.withColumn("rank", rank).where("rank <= 5").join(vectors(t).select("vec_id", "label"), "vec_id").join(asked, "query_id")
    n = vectors(t).groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("n"))
    totals = asked.join(n, "query_label").where("n > 0").select("query_id", "n", F.col("n").alias("listed"))
    return review.judged_metrics(judged.select("query_id", "rank", F.col("vec_id").alias("doc_id"), (F.col("label") == F.col("query_label")).alias("hit")), totals, 5)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'fixed' END, o_orderstatus) AS o_orderstatus FROM orders")
def point_update(t: Tables) -> DataFrame:
    new = t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("fixed").alias("o_orderstatus"))
    return records.fill_missing(t.orders.select("o_orderkey", "o_orderstatus"), new, "o_orderkey", "o_orderstatus")


@query("""WITH p AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]{2,}')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS b FROM documents)
  SELECT doc_id, CASE WHEN j >= 0.3 THEN '充足' WHEN j >= 0.1 THEN '有限' ELSE '无' END AS coverage FROM (
    SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS j FROM p)""")
def knowledge_coverage(t: Tables) -> DataFrame:
    """The first line of each document against the whole of it."""
    points = t.documents.select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("point"))
    return review.point_coverage(points, t.documents.select("doc_id", F.col("text").alias("body"))).select("doc_id", "coverage")


@query("SELECT p_partkey, substr(p_name, 1, 4) AS prefix, position(substr(p_name, 1, 4) IN p_name || ' ' || p_type || ' ' || p_brand || ' and a text that is long enough to count as substance') > 0 AS found FROM part")
def title_substance(t: Tables) -> DataFrame:
    body = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(" and a text that is long enough to count as substance"))
    return t.part.select("p_partkey", F.substring("p_name", 1, 4).alias("prefix"), review.title_found(body, F.col("p_name")).alias("found"))


@query("SELECT c_mktsegment AS kind, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS place FROM customer QUALIFY place <= 5")
def top_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.select(F.col("c_mktsegment").alias("kind"), "c_custkey", F.row_number().over(w).alias("place")).where("place <= 5")


def _kb(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = chunks(t)
    return search.embedded(rows, "content"), search.embedded(questions(t), "query"), rows


EXACT = "(regexp_matches(query, '\\d') OR regexp_matches(query, '[A-Z]{2,}|[A-Z]+/[A-Z]+'))"


def _adaptive_sql(k: int) -> str:
    """Candidates by kind of question, weights of terms, three chunks a document; then the hits that are best against those chosen, step by step."""
    special = f"len(list_filter(list_transform({TOK.format(c='query')}, lambda t: substr(t, 1, 32)), lambda t: length(t) BETWEEN 2 AND 6)) >= 3"
    weight = lambda a, b, c: f"CASE WHEN {special} THEN {a} WHEN {EXACT} THEN {b} WHEN length(query) > 40 THEN {c} ELSE 1.0 END::DOUBLE"
    out = "WITH " + fused_sql(
        lex=f"CASE WHEN {EXACT.replace('query', 'qq.query')} THEN {18 * k} ELSE {12 * k} END", vec=f"CASE WHEN {EXACT.replace('query', 'qq.query')} THEN {10 * k} ELSE {15 * k} END",
        weights=(weight(1.15, 0.95, 1.05), weight(0.9, 1.1, 1.0), weight(0.9, 1.1, 0.95)), per_doc=3,
    )
    out += f", s1 AS (SELECT query_id, chunk_id, doc_id, rrf AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rn FROM final WHERE rank <= {3 * k}), t1 AS (SELECT *, 1 AS place FROM s1 WHERE rn = 1)"
    for n in range(2, k + 1):
        out += f""", t{n} AS MATERIALIZED (SELECT * FROM t{n - 1} UNION ALL SELECT query_id, chunk_id, doc_id, score, rn, {n} FROM (
          SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY 0.4::DOUBLE * s.score - 0.6::DOUBLE * CASE WHEN EXISTS (SELECT 1 FROM t{n - 1} x WHERE x.query_id = s.query_id AND x.doc_id = s.doc_id) THEN 0.5::DOUBLE ELSE 0::DOUBLE END DESC, s.rn) AS z
          FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM t{n - 1} x WHERE x.query_id = s.query_id AND x.chunk_id = s.chunk_id)) WHERE z = 1)"""
    return out + f" SELECT query_id, place AS rank, chunk_id, doc_id, score FROM t{k}"


@query(_adaptive_sql(8), rank="INT")
def search_adaptive(t: Tables) -> DataFrame:
    rows, asked, plain = _kb(t)
    return answering.search_adaptive(rows, asked, plain=plain)


PARTS = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
ASKED = f"""  q AS (SELECT item_id || '/' || (generate_subscripts(p, 1) - 1) AS query_id, unnest(p) AS query FROM (SELECT item_id, list_filter({PARTS}, lambda x: x <> '') AS p FROM benchmark))"""


@query(f"""WITH {fused_sql(ASKED, "60")}, l AS (SELECT split_part(query_id, '/', 1)::BIGINT AS query_id, split_part(query_id, '/', 2)::INT AS subquery, chunk_id, rank AS pos FROM final WHERE rank <= 8),
  f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos, subquery) AS n FROM l)
  SELECT query_id, rank, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, subquery) AS rank FROM f WHERE n = 1) WHERE rank <= 8""", rank="INT")
def search_expanded(t: Tables) -> DataFrame:
    """The sentences of each question as sub-queries."""
    rows, asked, plain = _kb(t)
    subs = search.embedded(asked.drop("embedding").select("query_id", F.posexplode(F.filter(F.split("query", "(?<=[.!?])\\s+"), lambda x: x != "")).alias("subquery", "query")), "query")
    return answering.search_expanded(rows, subs, plain=plain)


DISTINCT = "list_distinct(list_transform(" + TOK + ", lambda t: substr(t, 1, 32)))"


@query(f"""WITH {fused_sql("", "60", 160)}, x AS (SELECT query_id, chunk_id, rrf, query, {SENTS.format(c="content")} AS sents FROM final WHERE rank <= 32),
  p AS (SELECT *, unnest(sents) AS s, generate_subscripts(sents, 1) AS pos FROM x), k AS (SELECT *, len(list_intersect({DISTINCT.format(c="s")}, {DISTINCT.format(c="query")})) / greatest(len({DISTINCT.format(c="query")}), 1) AS sc FROM p),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sc DESC, pos) AS rn FROM k), n AS (SELECT query_id, chunk_id, array_to_string(sents[greatest(pos - 1, 1):pos + 1], ' ') AS snippet, round(sc * rrf, 12) AS score FROM b WHERE rn = 1),
  u AS (SELECT *, row_number() OVER (PARTITION BY query_id, md5(snippet) ORDER BY score DESC, chunk_id) AS c FROM n)
  SELECT query_id, chunk_id, md5(snippet) AS snippet, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM u WHERE c = 1) WHERE rank <= 8""", rank="INT")
def search_small_to_big(t: Tables) -> DataFrame:
    rows, asked, plain = _kb(t)
    return answering.search_small_to_big(rows, asked, plain=plain).withColumn("snippet", F.md5("snippet"))


SPLIT = "list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: x <> '')"


@query(f"""{HITS}, p AS (SELECT *, trim(substr(content, 1, 80), ' ') AS prefix FROM h WHERE rank <= 40), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, prefix ORDER BY rank) AS n FROM p),
  v AS (SELECT query_id, rank, chunk_id, content FROM u WHERE n = 1 OR prefix = ''), w AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS hits FROM v),
  s AS (SELECT w.query_id, rank, chunk_id, hits, CASE WHEN hits > 8 THEN len(list_intersect(list_distinct({SPLIT.format(c="query")}), list_distinct({SPLIT.format(c="content")}))) / greatest(1, len(list_distinct({SPLIT.format(c="query")}))) END AS m FROM w JOIN q USING (query_id)),
  x AS (SELECT s.*, coalesce(m, l.score) AS score FROM s JOIN lex l USING (query_id, chunk_id)),
  y AS (SELECT *, min(score) OVER z AS lo, max(score) OVER z AS hi, count(*) OVER z AS n FROM x WINDOW z AS (PARTITION BY query_id)),
  o AS (SELECT query_id, chunk_id, rank AS old, round(CASE WHEN n < 2 OR hi = lo THEN score ELSE (score - lo) / (hi - lo) END, 6) AS score FROM y)
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank, chunk_id, score FROM o) WHERE rank <= 8""", rank="INT")
def rerank_lexical(t: Tables) -> DataFrame:
    """Reranking with an injected model: here the share of the question's words that a content has."""

    def model(asked: str, contents: list[str]) -> list[float]:
        terms = set(asked.lower().split())
        return [len(terms & set(c.lower().split())) / max(1, len(terms)) for c in contents]

    rows = _hits(t).join(questions(t), "query_id").select("query_id", "rank", "chunk_id", "content", "query", "score")
    return answering.rerank(rows, model, 8).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


PLAIN = "list_filter(list_transform(regexp_split_to_array({c}, '[。！？.!?\\n]+'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: length(x) >= 8)"
CUT = "list_distinct(list_transform(" + TOK + ", lambda t: substr(t, 1, 32)))"


@query(f"""{HITS}, e AS (SELECT query_id, rank, {PLAIN.format(c="content")} AS p FROM h WHERE rank <= 40), x AS (SELECT query_id, rank, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM e),
  s AS (SELECT x.*, len(list_intersect({CUT.format(c="sentence")}, {CUT.format(c="query")})) AS score FROM x JOIN q USING (query_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS n FROM s WHERE score > 0), u AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY query_id ORDER BY n) AS used FROM n)
  SELECT query_id, n, md5(sentence) AS sentence FROM u WHERE used <= 1500""", n="INT")
def compressed_context(t: Tables) -> DataFrame:
    return answering.compress(_hits(t).join(questions(t), "query_id")).withColumn("sentence", F.md5("sentence"))


@query(f"{HITS} SELECT query_id, least(count(*), 6)::INT AS n, min(rank) FILTER (rank <= 6)::INT AS first FROM h WHERE rank <= 40 GROUP BY query_id")
def answer_citations(t: Tables) -> DataFrame:
    return answering.answer_citations(_hits(t)).select("query_id", F.size("citations").alias("n"), F.col("citations")[0]["rank"].alias("first"))


@query()
def fuzzy_headings(t: Tables) -> DataFrame:
    """Parts of one brand and size are the headings of a template."""
    heads = t.part.select("p_brand", "p_size", F.col("p_partkey").alias("pos"), F.col("p_name").alias("heading"))
    keys = t.part.select("p_brand", "p_size", F.col("p_type").alias("key")).distinct()
    return matching.best_headings(keys, heads, ["p_brand", "p_size"])


@query()
def fuzzy_names(t: Tables) -> DataFrame:
    """Each type of part against the names of all parts, and how many pairs had to be matched block by block."""
    names = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    return fuzzy.best_matches(t.part.select(F.col("p_type").alias("key")), names, "key", "name", [], 0.35, fuzzy.Score(bonus=0.3))


@query("SELECT doc_id, len(regexp_extract_all(text, '【(\\d+)】'))::INT AS cites, regexp_matches(text, '\\[\\d{1,3}\\]') AS half FROM documents")
def citation_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.regexp_extract_all(X.text("text"), F.lit("【(\\d+)】"), 1)).alias("cites"), F.col("text").rlike(r"\[\d{1,3}\]").alias("half"))
