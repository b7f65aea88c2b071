"""Queries on questions, conversations and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import query as Q
from ..functions import text as X
from .catalog import Tables, query, sql_value

# the SQL engine measures edits in bytes: the letters of more than one that the table holds become control characters
ONE_BYTE = "translate({c}, 'éèêçñóíäöüßÉÈÊÇÑÓÍÄÖÜ', " + " || ".join(f"chr({k})" for k in (*range(1, 9), *range(14, 27))) + ")"
PAIRS = "p AS (SELECT conv_id, u.text AS a, s.text AS b FROM conversations u JOIN conversations s USING (conv_id) WHERE u.role = 'user' AND s.role = 'assistant' AND s.turn = u.turn + 1)"


def _pairs(t: Tables) -> DataFrame:
    u = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a"))
    return u.join(t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("b")), ["conv_id", "turn"])


WORDS = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]{{2,}}'))"


@query(f"""WITH {PAIRS}, w AS (SELECT conv_id, {WORDS.format(c="a")} AS x, {WORDS.format(c="b")} AS y FROM p)
  SELECT conv_id, count(*) AS pairs, round(avg(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END), 6) AS f1 FROM w GROUP BY conv_id""")
def token_f1(t: Tables) -> DataFrame:
    f1 = X.token_f1(X.words(F.col("a")), X.words(F.col("b")))
    return _pairs(t).groupBy("conv_id").agg(F.count("*").alias("pairs"), F.round(F.avg(f1), 6).alias("f1"))


@query(f"""WITH {PAIRS}, w AS (SELECT conv_id, {WORDS.format(c="a")} AS x, {WORDS.format(c="b")} AS y FROM p)
  SELECT conv_id, round(sum(len(list_intersect(x, y))) / greatest(sum(len(x)), 1), 6) AS precision_, round(sum(len(list_intersect(x, y))) / greatest(sum(len(y)), 1), 6) AS recall FROM w GROUP BY conv_id""")
def set_prf(t: Tables) -> DataFrame:
    x, y = X.words(F.col("a")), X.words(F.col("b"))
    both = F.sum(F.size(F.array_intersect(x, y)))
    return _pairs(t).groupBy("conv_id").agg(F.round(both / F.greatest(F.sum(F.size(x)), F.lit(1)), 6).alias("precision_"), F.round(both / F.greatest(F.sum(F.size(y)), F.lit(1)), 6).alias("recall"))


@query(f"""WITH {PAIRS}, e AS (SELECT conv_id, {ONE_BYTE.format(c="lower(trim(a, ' '))")} AS a, {ONE_BYTE.format(c="lower(trim(b, ' '))")} AS b FROM p)
  SELECT conv_id, round(avg(1 - levenshtein(a, b) / greatest(length(a), length(b), 1)), 6) AS anls FROM e GROUP BY conv_id""")
def anls(t: Tables) -> DataFrame:
    """Answers against what was asked, whole turns with all their characters."""
    return _pairs(t).groupBy("conv_id").agg(F.round(F.avg(M.anls(F.col("a"), F.array("b"))), 6).alias("anls"))


@query(f"""WITH {PAIRS}, e AS (SELECT conv_id, {ONE_BYTE.format(c="a")} AS a, {ONE_BYTE.format(c="b")} AS b FROM p)
  SELECT conv_id, round(avg(levenshtein(a, b) / greatest(length(b), 1)), 6) AS cer FROM e GROUP BY conv_id""")
def cer(t: Tables) -> DataFrame:
    return _pairs(t).groupBy("conv_id").agg(F.round(F.avg(M.character_error_rate(F.col("a"), F.col("b"))), 6).alias("cer"))


@query("""SELECT doc_id, CASE WHEN toxic > 0 THEN round(0.4 * quality + 0.6 * toxic, 3) ELSE round(quality, 3) END::DOUBLE AS blended, quality >= 0.6 AND 1 - toxic >= 0.5 AS passed FROM labels""")
def score_blend(t: Tables) -> DataFrame:
    q, j = F.col("quality").cast("double"), F.col("toxic").cast("double")
    return t.labels.select("doc_id", M.blend(q, j).alias("blended"), ((q >= 0.6) & (1 - j >= 0.5)).alias("passed"))


@query("""SELECT source, round(avg(quality), 6) AS faithful, round(avg(1 - toxic), 6) AS complete, avg(quality) >= 0.6 AND avg(1 - toxic) >= 0.5 AS passed, round(stddev_pop(quality), 6) AS sd FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def gate(t: Tables) -> DataFrame:
    q, c = F.avg("quality"), F.avg(1 - F.col("toxic"))
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.round(q, 6).alias("faithful"), F.round(c, 6).alias("complete"), ((q >= 0.6) & (c >= 0.5)).alias("passed"), F.round(F.stddev_pop("quality"), 6).alias("sd"))


@query("""SELECT kind, words, greatest(400, least(floor(b * (1 + 0.5 * words / 8000))::INT, 3000)) AS budget FROM (
  SELECT kind, words, CASE kind WHEN 'data' THEN 2000 WHEN 'experiment_setup' THEN 1800 WHEN 'analysis' THEN 1500 WHEN 'review' THEN 800 ELSE 1200 END AS b
  FROM (SELECT unnest(['data', 'experiment_setup', 'analysis', 'review', 'other']) AS kind) CROSS JOIN (SELECT unnest([0, 2000, 8000]) AS words))""")
def section_budget(t: Tables) -> DataFrame:
    rows = t.region.select(F.element_at(F.array(*map(F.lit, ["data", "experiment_setup", "analysis", "review", "other"])), F.col("r_regionkey") + 1).alias("kind"), F.explode(F.array(F.lit(0), F.lit(2000), F.lit(8000))).alias("words"))
    return rows.select("kind", "words", M.context_budget(F.col("kind"), F.col("words"), F.lit(10000)).alias("budget"))


@query("""WITH h AS (SELECT label AS kb, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings)
  SELECT kb, round(count(*) FILTER (rank <= 20) / count(*), 6) AS diversity, count(*) FILTER (rank <= 20) / count(*) < 0.3 AS warn FROM h GROUP BY kb""")
def kb_diversity(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    rows = t.embeddings.select(F.col("label").alias("kb"), rank.alias("rank"))
    share = F.sum((F.col("rank") <= 20).cast("int")) / F.count("*")
    return rows.groupBy("kb").agg(F.round(share, 6).alias("diversity"), (share < 0.3).alias("warn"))


@query(f"""SELECT item_id, regexp_matches(text, '\\d') AS has_numbers, regexp_matches(text, '[A-Z]{{2,}}|[A-Z]+/[A-Z]+') AS has_tech, c AS concreteness, length(text)::INT AS length,
  CASE WHEN regexp_matches(text, '\\d') OR regexp_matches(text, '[A-Z]{{2,}}|[A-Z]+/[A-Z]+') THEN 30 WHEN length(text) > 60 THEN 96 WHEN c < 0.3 THEN 84 WHEN c > 0.7 THEN 39 ELSE 60 END AS k
  FROM (SELECT *, CASE WHEN a + b = 0 THEN 0.5 ELSE b / (a + b) END::DOUBLE AS c FROM (SELECT item_id, text, len(list_filter({sql_value(Q.ABSTRACT)}, lambda w: contains(text, w))) AS a, len(list_filter({sql_value(Q.CONCRETE)}, lambda w: contains(text, w))) AS b FROM benchmark))""")
def query_profile(t: Tables) -> DataFrame:
    p = Q.profile(F.col("text"))
    return t.benchmark.select("item_id", p["has_numbers"].alias("has_numbers"), p["has_tech_terms"].alias("has_tech"), p["concreteness"].alias("concreteness"), p["length"].alias("length"), M.adaptive_k(F.col("text")).alias("k"))


@query(f"""WITH {PAIRS} SELECT conv_id, round(avg(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END), 6) AS similarity
  FROM (SELECT conv_id, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]{{2,}}|[一-鿿]')) AS x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]{{2,}}|[一-鿿]')) AS y FROM p) GROUP BY conv_id""")
def turn_similarity(t: Tables) -> DataFrame:
    return _pairs(t).groupBy("conv_id").agg(F.round(F.avg(X.jaccard(X.similarity_tokens(F.col("a")), X.similarity_tokens(F.col("b")))), 6).alias("similarity"))
