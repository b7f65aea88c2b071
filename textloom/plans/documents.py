"""Queries over documents: splitting, text functions, facts, terms, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as X
from ..operators import chunking, facts, records, relevance, similar
from ..sources import files
from .catalog import Tables, query
from .retrieval import CHUNKS, SENTS, chunks, first_distinct

STRIP = "regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


@query("SELECT doc_id, i AS chunk_index, md5(substr(text, i * 700 + 1, 700)) AS h FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 700 + 1))::INT AS i FROM documents WHERE length(text) > 0)")
def chunk_fixed(t: Tables) -> DataFrame:
    return chunking.fixed(t.documents).select("doc_id", "chunk_index", F.md5("content").alias("h"))


@query("""SELECT doc_id, i AS chunk_index, md5(substr(text, i * 600 + 1, 700)) AS h FROM (
  SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 700 THEN 0 ELSE ceil((length(text) - 700) / 600)::INT END + 1))::INT AS i FROM documents WHERE length(text) > 0)""")
def chunk_sliding(t: Tables) -> DataFrame:
    return chunking.sliding(t.documents).select("doc_id", "chunk_index", F.md5("content").alias("h"))


SENTENCES = """s AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?\\n]+[。！？.!?\\n]?'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS p FROM documents))"""
SENTENCE_CHUNKS = f"""{SENTENCES},
  i AS (SELECT *, sum((length(s) >= 20 OR pos = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s),
  sc AS (SELECT doc_id, (island - 1)::INT AS chunk_index, string_agg(s, ' ' ORDER BY pos) AS content FROM i GROUP BY doc_id, island)"""


@query(f"WITH {SENTENCE_CHUNKS} SELECT doc_id, chunk_index, md5(content) AS h FROM sc")
def chunk_sentence(t: Tables) -> DataFrame:
    return chunking.sentence_chunks(t.documents).select("doc_id", "chunk_index", F.md5("content").alias("h"))


LINES = f"""ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query(f"""WITH {LINES}, k AS (SELECT doc_id, pos, {STRIP.format(c="line")} AS content FROM ln)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk_index, md5(content) AS h FROM k WHERE content <> ''""")
def chunk_lines(t: Tables) -> DataFrame:
    return chunking.lines(t.documents).select("doc_id", "chunk_index", F.md5("content").alias("h"))


@query(f"""WITH k AS (SELECT doc_id, {STRIP.format(c="x")} AS content, i FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS l FROM documents)))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, md5(content) AS h FROM k WHERE content <> ''""")
def chunk_paragraph(t: Tables) -> DataFrame:
    doubled = t.documents.select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.paragraphs(doubled).select("doc_id", "chunk_index", F.md5("content").alias("h"))


STATS = "SELECT '{m}' AS method, count(*) AS chunks, round(avg(length(content)), 4) AS avg_len, min(length(content))::INT AS min_len, max(length(content))::INT AS max_len, round(avg((NOT regexp_matches(content, '[。！？.!?;；:：)\\]一-鿿]\\s*$'))::INT), 6) AS cut_rate FROM {t}"


@query(f"WITH {CHUNKS}, {SENTENCE_CHUNKS} {STATS.format(m='fixed', t='c')} UNION ALL {STATS.format(m='sentence', t='sc')}")
def chunk_stats(t: Tables) -> DataFrame:
    return chunking.statistics(chunking.fixed(t.documents), "fixed").union(chunking.statistics(chunking.sentence_chunks(t.documents), "sentence"))


@query(f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 4 THEN doc_id || ':parent:' || chunk_index // 4 ELSE '' END AS parent_chunk_id FROM c")
def parent_assign(t: Tables) -> DataFrame:
    return chunking.parents(chunks(t)).select("chunk_id", "parent_chunk_id")


@query("""SELECT doc_id, md5(substr(text, 1, 100)) AS value, (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)) AS made FROM documents""")
def cached_results(t: Tables) -> DataFrame:
    """A costly result of each text in two runs: the second makes only what the first, over a third of the documents, hasn't."""
    cache = files.ResultCache(t.spark, similar.folder(t.spark, "results"))
    make = lambda new: new.select("md5", F.md5(F.substring("input", 1, 100)).alias("value"))
    docs = t.documents.select("doc_id", "text")
    cache.get(docs.where("doc_id % 3 = 0"), "text", make, 20_000)
    found, made = cache.get(docs, "text", make, 20_001)
    return found.select("doc_id", "value", F.lit(made).cast("long").alias("made"))


@query()
def chunk_documents(t: Tables) -> DataFrame:
    return chunking.chunk_documents(t.documents).select("doc_id", "chunk_id", "chunk_index", "section_path", F.md5("content").alias("h"))


@query()
def markdown_sections(t: Tables) -> DataFrame:
    return chunking.markdown_sections(t.documents).select("doc_id", "section", "level", "section_path", F.md5("body").alias("h"))


@query(f"""WITH {LINES}, f AS (SELECT *, length({STRIP.format(c="line")}) BETWEEN 3 AND 30 AND NOT regexp_matches({STRIP.format(c="line")}, '[。！？；;.!?，,：:]$')
    AND length(regexp_replace({STRIP.format(c="line")}, '[^一-鿿A-Za-z0-9]', '', 'g')) >= length({STRIP.format(c="line")}) * 0.5 AS t FROM ln),
  g AS (SELECT *, sum(t::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM f)
  SELECT doc_id, section, coalesce(max(CASE WHEN t THEN {STRIP.format(c="line")} END), '') AS title, md5({STRIP.format(c="coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT t), '')")}) AS h FROM g GROUP BY doc_id, section""", section="BIGINT")
def title_sections(t: Tables) -> DataFrame:
    return chunking.title_sections(t.documents).select("doc_id", "section", "title", F.md5("body").alias("h"))


NORM = "regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, md5({STRIP.format(c=NORM)}) AS normal, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS squashed FROM documents")
def normalize_ws(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("normal"), F.md5(X.squash(F.col("text"))).alias("squashed"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) <= 2400 THEN text ELSE regexp_replace(substr(text, 1, 1200), '\\s+$', '') || chr(10) || '...' || chr(10) || regexp_replace(substr(text, -1200), '^\\s+', '') END) AS h,
  CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS clipped FROM documents""")
def head_tail(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.head_tail(F.col("text"))).alias("h"), X.clip(F.col("text"), 100).alias("clipped"))


@query("SELECT CASE WHEN regexp_matches(substr(text, 1, 800), '[A-Za-z]') THEN 'en' ELSE 'zh' END AS flag, lang, count(*) AS n FROM documents GROUP BY ALL")
def lang_flag(t: Tables) -> DataFrame:
    return t.documents.groupBy(X.language_flag(F.col("text")).alias("flag"), "lang").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len(p) AS n, md5(coalesce(p[1], '')) AS first FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?\\n]+'), lambda x: {STRIP.format(c='x')}), lambda x: length(x) >= 8) AS p FROM documents)", n="INT")
def sent_split(t: Tables) -> DataFrame:
    p = X.plain_sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(p).alias("n"), F.md5(F.coalesce(F.try_element_at(p, F.lit(1)), F.lit(""))).alias("first"))


@query(f"SELECT doc_id, len({SENTS.format(c='text')})::INT AS n, md5(coalesce({SENTS.format(c='text')}[-1], '')) AS last FROM documents")
def sentences(t: Tables) -> DataFrame:
    s = X.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).alias("n"), F.md5(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))).alias("last"))


@query(f"SELECT doc_id, array_to_string({first_distinct('r', 12)}, ' ') AS terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[一-鿿a-z0-9]{{2,}}') AS r FROM documents)")
def lexical_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.lexical_terms(F.col("text")), " ").alias("terms"))


@query("""SELECT doc_id, round(0.8 * least(len(l), 40) + 0.25 * least(w, 120) + 1.2 * least(kv, 30) - 0.15 * odd - 1.6 * joined, 6) AS quality FROM (
  SELECT doc_id, l, len(regexp_extract_all(text, '[A-Za-z0-9]{2,}|[一-鿿]')) AS w, len(list_filter(l, lambda x: regexp_matches(x, '^[^:：]{1,30}[:：]\\s*\\S'))) AS kv,
    len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s.,:;!?()%/&''"-]')) AS odd, len(list_filter(l, lambda x: length(x) >= 18 AND NOT regexp_matches(x, '[ :：]'))) AS joined
  FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents))""", quality="DOUBLE")
def ocr_quality_score(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(X.ocr_quality(F.col("text")), 6).alias("quality"))


@query("""SELECT page_id, CASE WHEN r = '' THEN 'default' ELSE r END AS kb, regexp_matches(split_part(url, '/', 3), '^[0-9A-Za-z_-]{1,64}$') AS valid_id FROM (
  SELECT page_id, url, regexp_replace(regexp_replace(url, '[^0-9A-Za-z一-鿿._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS r FROM pages)""")
def kb_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.normalize_kb(F.col("url")).alias("kb"), X.valid_task_id(F.split_part("url", F.lit("/"), F.lit(3))).alias("valid_id"))


TOKS = "list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: substr(t, 1, 32))"
TF = f"""k AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {TOKS} AS t FROM documents)),
  tf AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first FROM k WHERE length(term) >= 2 AND term NOT IN ('the', 'and', 'of') GROUP BY ALL),
  r AS (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, first) AS rank FROM tf)"""


@query(f"WITH {TF} SELECT * FROM r WHERE rank <= 5", rank="INT")
def key_terms(t: Tables) -> DataFrame:
    return facts.term_frequency(t.documents.select("doc_id", "text"), X.tokens(F.col("text")), 5, ["the", "and", "of"])


@query("""WITH k AS (SELECT lang, regexp_extract_all(lower(text), '[a-z]{3,}') AS t FROM documents), f AS (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest(t) AS term FROM k) GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tf DESC, term) AS rank FROM f) WHERE rank <= 20""", rank="INT")
def term_freq(t: Tables) -> DataFrame:
    """The commonest words of each language's documents."""
    tf = t.documents.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("tf"))
    return tf.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("tf"), "term"))).where("rank <= 20")


@query("""WITH terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark), u AS (SELECT DISTINCT term FROM terms),
  n AS (SELECT term, count(*) AS docs, CAST(sum((length(x) - length(replace(x, term, ''))) // length(term)) AS BIGINT) AS times FROM u JOIN (SELECT lower(text) AS x FROM documents) ON contains(x, term) GROUP BY term)
  SELECT item_id, term, coalesce(docs, 0) AS docs FROM terms LEFT JOIN n USING (term)""")
def coverage_gaps(t: Tables) -> DataFrame:
    """In how many documents the terms of each item stand, also within words."""
    wanted = t.benchmark.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("term")).distinct()
    return wanted.join(facts.term_occurrences(t.documents, wanted), "term", "left").select("item_id", "term", F.coalesce("docs", F.lit(0)).alias("docs"))


@query("""WITH d AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text), e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}|[0-9]{2,}'))) AS term FROM d),
  s AS (SELECT doc_id, term FROM e JOIN (SELECT term FROM e GROUP BY term HAVING count(*) BETWEEN 2 AND 20) USING (term))
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS common FROM s a JOIN s b USING (term) WHERE a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 3""")
def doc_overlap(t: Tables) -> DataFrame:
    """Different texts, each by its smallest doc_id, that share three terms that few others have; exact_dedup has who holds a text."""
    one = t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return facts.rare_overlaps(one.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}|[0-9]{2,}"), 0))).alias("term")))


@query("SELECT md5(text) AS h, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")


@query("""WITH t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}|[一-鿿]'))) AS w FROM documents), s AS (SELECT w, min(doc_id) AS rep FROM t WHERE len(w) > 0 GROUP BY w),
  e AS (SELECT rep, len(w) AS n, unnest(w) AS x FROM s), p AS (SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.rep < b.rep AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL)
  SELECT a, b FROM p WHERE 4 * c >= 3 * (n + m - c)""")
def shingle_jaccard_pairs(t: Tables) -> DataFrame:
    """Documents of similar token sets, each set by its smallest doc_id; record_dedup has who holds a set."""
    return similar.pairs(t.documents, "text", "doc_id", 0.75)[0]


FACT = "list_filter(regexp_extract_all(text, '\\d+(?:\\.\\d+)?%?'), lambda x: length(x) >= 2)"


@query(f"SELECT doc_id, len(list_distinct({FACT})) AS numbers, len(list_distinct(regexp_extract_all(text, '\\b((?:19|20)\\d{{2}})\\b'))) AS years FROM documents", numbers="INT", years="INT")
def numeric_facts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(facts.numbers(F.col("text"))).alias("numbers"), F.size(facts.years(F.col("text"))).alias("years"))


@query(f"""WITH f AS (SELECT DISTINCT lang AS id, coalesce(quality, 1) AS quality, fact FROM (SELECT doc_id, lang, unnest({FACT}) AS fact FROM documents) LEFT JOIN labels USING (doc_id))
  SELECT id, fact FROM f a WHERE quality = 0 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.quality = 1 AND b.id = a.id AND b.fact = a.fact)""")
def unsupported_numbers(t: Tables) -> DataFrame:
    """Figures of documents labelled as poor that no other document of their language has."""
    rows = t.documents.select("doc_id", F.col("lang").alias("id"), F.explode(facts.numbers(F.col("text"))).alias("fact")).join(t.labels, "doc_id", "left").select("id", F.coalesce("quality", F.lit(1)).alias("quality"), "fact").distinct()
    return facts.unsupported(rows.where("quality = 0").select("id", "fact"), rows.where("quality = 1").select("id", "fact"))


@query(f"""WITH l AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS section FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
  f AS (SELECT DISTINCT doc_id, section, unnest({FACT}) AS fact FROM l)
  SELECT doc_id, fact, count(DISTINCT section) AS sections FROM f WHERE NOT regexp_full_match(fact, '(?:19|20)\\d{{2}}') GROUP BY ALL HAVING count(DISTINCT section) > 1""")
def repeated_values(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "text"))
    return facts.repeated_values(rows, 1)


@query("""WITH m AS (SELECT l_returnflag || l_linestatus || l_linenumber AS metric, l_suppkey AS doc_id, round(avg(l_discount), 4) AS value FROM lineitem GROUP BY ALL)
  SELECT metric, count(DISTINCT doc_id) AS docs, min(value) AS low, max(value) AS high FROM m GROUP BY metric HAVING count(DISTINCT doc_id) >= 2 AND max(value) - min(value) > 0.01 * max(abs(value))""")
def metric_conflicts(t: Tables) -> DataFrame:
    claims = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("metric"), F.col("l_suppkey").alias("doc_id")).agg(F.round(F.avg("l_discount"), 4).alias("value"))
    return facts.conflicts(claims)


KV = "'^\\s*([^:：|]{1,40}?)\\s*(?:[:：]\\s*|\\s{2,})(\\S.*)$'"


@query(f"""WITH {LINES}, p AS (SELECT doc_id, pos, {STRIP.format(c=f"regexp_extract(line, {KV}, 1)")} AS field, {STRIP.format(c=f"regexp_extract(line, {KV}, 2)")} AS value FROM ln),
  u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(field), lower(value) ORDER BY pos) AS k FROM p WHERE field <> '' AND value <> ''),
  n AS (SELECT doc_id, pos, field, value, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM u WHERE k = 1) SELECT doc_id, pos::INT AS pos, field, md5(value) AS v FROM n WHERE k <= 10""")
def kv_pairs(t: Tables) -> DataFrame:
    return facts.key_values(t.documents).select("doc_id", "pos", "field", F.md5("value").alias("v"))


def _records(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "source", F.element_at(lines, 1).alias("title"), F.when(F.col("quality") == 1, F.col("text")).alias("summary"),
        F.when(F.size(lines) > 2, F.slice(lines, 2, 3)).alias("key_points"), F.slice(X.words(F.col("text")), 1, 5).alias("keywords"),
        F.when(F.col("toxic") == 0, F.element_at(lines, -1)).alias("conclusion"), F.lit("").alias("prediction"), F.lit(None).cast("array<map<string,string>>").alias("data"),
    )


@query("""WITH r AS (SELECT doc_id, (quality = 1 AND trim(text, ' ') <> '')::INT AS s, (len(string_split(text, chr(10))) > 2)::INT AS k, (len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) > 0)::INT AS w, (toxic = 0 AND trim(string_split(text, chr(10))[-1], ' ') <> '')::INT AS c,
    (trim(string_split(text, chr(10))[1], ' ') <> '')::INT AS t FROM documents LEFT JOIN labels USING (doc_id))
  SELECT doc_id, (t + coalesce(s, 0) + k + w + coalesce(c, 0))::INT AS filled, round((t + coalesce(s, 0) + k + w + coalesce(c, 0)) / 7, 4) AS ratio, t = 1 AND coalesce(s, 0) = 1 AND k = 1 AS required_ok FROM r""")
def completeness_score(t: Tables) -> DataFrame:
    return records.completeness(_records(t)).select("doc_id", "filled", "ratio", "required_ok")


@query()
def record_dedup(t: Tables) -> DataFrame:
    return records.near_duplicates(t.documents, "text", "doc_id")


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(c='x')}), lambda x: length(x) > 20) AS l FROM documents),
  w AS (SELECT doc_id, pos, list_distinct(regexp_extract_all(lower(para), '[a-z0-9]{{2,}}')) AS a FROM (SELECT doc_id, unnest(l) AS para, generate_subscripts(l, 1) AS pos FROM l)),
  n AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w), j AS (SELECT doc_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM n WHERE len(a) > 0 AND len(b) > 0),
  p AS (SELECT doc_id, count(*) AS pairs, avg(j) AS m, min(j) AS lo, max(j) AS hi FROM j GROUP BY doc_id)
  SELECT d.doc_id, coalesce(pairs, 0) AS pairs, round(coalesce(m, 0), 6) AS score, round(coalesce(lo, 0), 3) AS least, round(coalesce(hi, 0), 3) AS most, coalesce(m, 0) BETWEEN 0.15 AND 0.7 AS in_range FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN p USING (doc_id)""")
def coherence_jaccard(t: Tables) -> DataFrame:
    return relevance.paragraph_coherence(t.documents, X.words)


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'), ' ') AS title,
  length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' '))::INT AS text_len FROM pages""")
def page_text(t: Tables) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return t.pages.select("page_id", X.squash(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.length(X.squash(plain)).alias("text_len"))


@query("""WITH r AS (SELECT source, doc_id, substr(text, 1, greatest(300, 3500 // count(*) OVER (PARTITION BY source))::INT) AS line FROM documents),
  u AS (SELECT *, sum(length(line)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM r) SELECT source, doc_id, used FROM u WHERE used <= 3500""", used="BIGINT")
def source_digest(t: Tables) -> DataFrame:
    return records.digest(t.documents.withColumnRenamed("text", "line"), ["source"], ["doc_id"]).select("source", "doc_id", "used")
