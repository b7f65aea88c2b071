"""Rules of the application over conversations, documents, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as X
from ..operators import answering, chunking, drafts, facts, records, relevance
from ..streaming import events
from .catalog import Tables, query, sql_value
from .documents import STRIP
from .retrieval import HITS, LISTS, _hits, _lists

MESSAGE = STRIP.format(c="coalesce(text, '')")


def any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {sql_value(w)})" for w in words) + ")"


def isin_sql(c: str, words: list[str]) -> str:
    return f"{c} IN ({', '.join(map(sql_value, words))})"


ASKED = f"(starts_with_any OR regexp_matches(m, '[?？]') OR (suffix(m, '吗') AND length(m) <= 30) OR (length(m) <= 60 AND NOT {any_sql('m', Q.COMMANDS)}))".replace("starts_with_any", "(" + " OR ".join(f"prefix(m, {sql_value(w)})" for w in Q.QUESTION_WORDS) + ")")
CHANGES = f"(length(m) <= 120 AND NOT prefix(m, '/') AND {any_sql('m', Q.MODIFY)} AND NOT (regexp_matches(m, '[?？]') OR (suffix(m, '吗') AND length(m) <= 20 AND NOT {any_sql('m', Q.STRONG_VERBS)})))"


@query(f"""SELECT conv_id, turn, CASE WHEN m = '' THEN 'general_chat'
    WHEN prefix(m, '/') THEN CASE WHEN {isin_sql("lower(regexp_extract(m, '^/(\\S*)', 1))", Q.SLASH)} THEN 'control_task' ELSE 'general_chat' END
    WHEN turn % 4 = 2 THEN CASE WHEN lower(m) IN ('hi', 'hello', '你好', '在吗') THEN 'general_chat' ELSE 'clarify_answer' END
    WHEN {isin_sql("lower(m)", Q.GREETINGS)} THEN 'general_chat' WHEN regexp_matches(m, {sql_value("(?i)" + "|".join(Q.CONTROL))}) THEN 'control_task'
    WHEN conv_id % 2 = 0 AND {CHANGES} THEN 'modify_report' WHEN {any_sql("m", Q.KB)} OR ({any_sql("m", ["文档", "资料"])} AND length(m) <= 60) OR {any_sql("m", Q.KB_CONCEPT)} THEN 'kb_query'
    WHEN conv_id % 2 = 0 AND {ASKED} THEN 'question_report' ELSE 'general_chat' END AS intent
  FROM (SELECT conv_id, turn, {MESSAGE} AS m FROM conversations WHERE role = 'user')""")
def message_intents(t: Tables) -> DataFrame:
    """What users' messages ask for; every other conversation has a report, every fourth turn answers a question."""
    rows = t.conversations.where("role = 'user'")
    return rows.select("conv_id", "turn", Q.intent(F.col("text"), F.col("conv_id") % 2 == 0, F.col("turn") % 4 == 2).alias("intent"))


@query(f"""SELECT conv_id, turn, CASE WHEN length(m) < 5 THEN 'fact_lookup' WHEN {any_sql("m", Q.CONCEPTUAL)} THEN 'conceptual' WHEN {any_sql("m", Q.COMPARISON)} THEN 'comparison'
    WHEN {any_sql("m", Q.SUMMARY)} THEN 'summary' WHEN {any_sql("m", Q.HOW_TO)} THEN 'how_to' ELSE 'fact_lookup' END AS kind,
    CASE WHEN m = '' THEN 'empty' WHEN length(m) <= 2 AND NOT {isin_sql("lower(m)", Q.TRIVIAL_SHORT)} THEN 'short' WHEN {isin_sql("lower(m)", Q.NOISE)} THEN 'noise' WHEN {isin_sql("lower(m)", Q.HELLO)} THEN 'greeting' WHEN {isin_sql("lower(m)", Q.THANKS)} THEN 'thanks' END AS trivial,
    length(m) > 60 OR {any_sql("m", Q.COMPLEX)} AS complex, length(m) >= 15 AND {any_sql("m", Q.REASONING)} AS hypothesis
  FROM (SELECT conv_id, turn, {MESSAGE} AS m FROM conversations)""")
def message_kinds(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", Q.classify(c).alias("kind"), Q.trivial(c).alias("trivial"), Q.is_complex(c).alias("complex"), Q.wants_hypothesis(c).alias("hypothesis"))


FOUND = " || ".join([f"regexp_extract_all(coalesce(text, ''), {sql_value(p)})" for p in Q.ENTITIES] + ["regexp_extract_all(coalesce(text, ''), '[“”\"「」『』''](.+?)[“”\"「」『』'']', 1)"])


@query(f"""SELECT doc_id, len(e)::INT AS n, md5(array_to_string(list_sort(e), chr(10))) AS entities FROM (
  SELECT doc_id, list_distinct(list_filter(list_transform({FOUND}, lambda x: {STRIP.format(c='x')}), lambda x: length(x) >= 2)) AS e FROM documents)""")
def document_entities(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", Q.entities(F.col("text")).alias("e"))
    return found.select("doc_id", F.size("e").alias("n"), F.md5(F.array_join(F.array_sort("e"), "\n")).alias("entities"))


@query("""WITH k AS (SELECT item_id, list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}]+') || regexp_extract_all(text, '[A-Za-z0-9_-]{2,}'), lambda x: length(x) >= 2) AS k FROM benchmark)
  SELECT item_id, array_to_string(list_slice(list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i), 1, 18), ' ') AS keywords FROM k""")
def item_keywords(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query("""SELECT doc_id, coalesce(nullif(regexp_extract(source, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(coalesce(text, ''), '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), ''), '') AS year FROM documents""")
def document_years(t: Tables) -> DataFrame:
    """The year of each document, from its source or its text."""
    return t.documents.select("doc_id", X.text_year(F.lit(None), F.col("source"), F.col("text")).alias("year"))


UNIT = "\\s*[万亿千百]?\\s*(?:" + "|".join(X.UNITS) + ")?$"


@query(f"""WITH f AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(coalesce(text, ''), '\\d+(?:\\.\\d+)?%?'), lambda x: length(x) >= 2)) AS fact FROM documents),
  n AS (SELECT doc_id, {STRIP.format(c=f"regexp_replace(regexp_replace({STRIP.format(c='fact')}, '^(?:{'|'.join(X.APPROXIMATE)})\\s*', ''), {sql_value(UNIT)}, '')")} AS figure FROM f)
  SELECT figure, count(DISTINCT doc_id) AS docs FROM n GROUP BY figure""")
def figures(t: Tables) -> DataFrame:
    """In how many documents each figure stands, whatever unit is behind it."""
    found = t.documents.select("doc_id", F.explode(facts.numbers(X.text("text"))).alias("fact"))
    return found.groupBy(X.normalize_number(F.col("fact")).alias("figure")).agg(F.count_distinct("doc_id").alias("docs"))


EDGE = "regexp_replace({c}, '^[ \\-:;,]+|[ \\-:;,]+$', '', 'g')"
APART = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')"
FORM = f"trim(regexp_replace({APART.format(c='regexp_replace(' + EDGE.format(c=chr(123) + 'c' + chr(125)) + ', ' + chr(39) + '[_/' + chr(92) * 2 + '|-]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '\\s+', ' ', 'g'), ' ')"


@query(f"""SELECT conv_id, turn, md5(f) AS form, md5({EDGE.format(c='upper(f)')}) AS field FROM (SELECT conv_id, turn, {FORM.format(c="regexp_replace(coalesce(text, ''), '" + chr(92) + "s+', ' ', 'g')")} AS f FROM conversations WHERE regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*'))""")
def message_forms(t: Tables) -> DataFrame:
    """Messages as the text of a form and as the name of a field."""
    rows = t.conversations.where(X.text("text").rlike("^[\\x00-\\x7F]*\\z"))
    return rows.select("conv_id", "turn", F.md5(X.form_text(F.col("text"))).alias("form"), F.md5(X.form_text(F.col("text"), True)).alias("field"))


@query(f"""WITH f AS (
    SELECT o_orderkey AS id, 'TOTAL' AS field, CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'Ordered', strftime(o_orderdate, '%d/%m/%Y') FROM orders
    UNION ALL SELECT o_orderkey, 'State', o_orderstatus FROM orders UNION ALL SELECT c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT c_custkey, 'Segment', c_mktsegment FROM customer)
  SELECT field, CASE WHEN regexp_matches(value, '@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') THEN 'EMAIL' WHEN regexp_matches(lower(value), '\\b(?:{"|".join(Q.MONTHS)})\\b') OR regexp_matches(value, '\\d{{1,2}}[/\\-.]\\d{{1,2}}[/\\-.]\\d{{2,4}}') THEN 'DATE'
    WHEN {any_sql("upper(field)", Q.PHONE_FIELDS)} OR length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 THEN 'PHONE'
    WHEN regexp_matches(value, '[$€¥£]|(?:^|\\s)\\d[\\d,]*(?:\\.\\d+)?(?:\\s|$)') AND {any_sql("upper(field)", Q.AMOUNT_FIELDS)} THEN 'AMOUNT'
    WHEN regexp_matches(lower(value), '\\d{{2,}}.*\\b(?:{"|".join(Q.STREET_WORDS)})\\b') THEN 'ADDRESS' WHEN regexp_matches(value, '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,3}}$') AND NOT regexp_matches(value, '\\d') THEN 'NAME' ELSE 'TEXT' END AS kind, count(*) AS n
  FROM f GROUP BY ALL""")
def field_types(t: Tables) -> DataFrame:
    """Kinds of the fields that forms about orders and customers would have."""
    pair = lambda rows, field, value: rows.select(F.lit(field).alias("field"), value.alias("value"))
    o, c = t.orders, t.customer
    pairs = pair(o, "TOTAL", F.col("o_totalprice").cast("decimal(20,0)").cast("string")).union(pair(o, "Ordered", F.date_format("o_orderdate", "dd/MM/yyyy"))).union(pair(o, "State", F.col("o_orderstatus")))
    pairs = pairs.union(pair(c, "Customer", F.col("c_name"))).union(pair(c, "Segment", F.col("c_mktsegment")))
    return pairs.select("field", Q.field_type(F.col("field"), F.col("value")).alias("kind")).groupBy("field", "kind").agg(F.count("*").alias("n"))


LAST = "(CASE WHEN position(reverse({m}) IN reverse(h)) = 0 THEN -1 ELSE length(h) - position(reverse({m}) IN reverse(h)) + 1 - length({m}) END)"
MARKS = ["'。'", "'.' || chr(10)", "'.' || chr(13)", "chr(10)"]


@query(f"""WITH h AS (SELECT doc_id, text, substr(text, 1, 900) AS h FROM documents WHERE text IS NOT NULL), a AS (SELECT *, greatest({', '.join(LAST.format(m=m) for m in MARKS)}) AS at_ FROM h)
  SELECT doc_id, md5(CASE WHEN length(text) <= 900 THEN text WHEN at_ > 540 THEN substr(h, 1, at_ + 1) || chr(10) || '…' ELSE h || '…' END) AS block FROM a""")
def document_blocks(t: Tables) -> DataFrame:
    """Texts cut to a block of context."""
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(X.cut_block(F.col("text"))).alias("block"))


PAIR_WORDS = "list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2)))"


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), k AS (SELECT item_id, text AS p, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark),
  j AS (SELECT doc_id, coalesce(d.text, '') AS c, p, {PAIR_WORDS} AS w FROM documents d CROSS JOIN n JOIN k ON k.k = d.doc_id % n.n),
  s AS (SELECT *, substr(c, 1, greatest(200, length(c) // 5)) AS h FROM j)
  SELECT doc_id, CASE WHEN c = '' OR p = '' OR len(w) = 0 THEN 0.5 ELSE round(least(1.0, (0.6::DOUBLE * (len(list_filter(w, lambda x: contains(c, x))) / len(w)) + 0.4::DOUBLE * (len(list_filter(w, lambda x: contains(h, x))) / len(w))) * 1.5::DOUBLE), 3) END::DOUBLE AS relevance FROM s""")
def document_relevance(t: Tables) -> DataFrame:
    """How much of the character pairs of its benchmark item each document has; items are dealt to the documents by number."""
    items = t.benchmark.select("item_id", F.col("text").alias("p"))
    n = items.count()
    numbered = t.spark.createDataFrame([(k, r["p"]) for k, r in enumerate(items.orderBy("item_id").collect())], "k long, p string")  # the stated set of items
    rows = t.documents.join(numbered, F.col("k") == F.pmod(F.col("doc_id"), F.lit(n)))
    return rows.select("doc_id", relevance.pair_relevance(X.text("text"), F.col("p")).alias("relevance"))


@query("""WITH k AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'pause' WHEN 'view' THEN 'resume' WHEN 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN 'cancel' END END AS kind FROM events)
  SELECT CAST(user_id AS VARCHAR) AS task_id, CASE WHEN bool_or(kind = 'cancel') THEN 'cancelled' WHEN max_by(kind, (ts, event_id)) = 'pause' THEN 'paused' ELSE 'running' END AS state FROM k WHERE kind IS NOT NULL GROUP BY user_id""")
def control_states(t: Tables) -> DataFrame:
    """Users' events read as commands to a task."""
    e = F.col("event_type")
    kind = F.when(e == "click", "pause").when(e == "view", "resume").when((e == "purchase") & (F.col("event_id") % 50 == 0), "cancel")
    rows = t.events.select(F.col("user_id").cast("string").alias("task_id"), kind.alias("kind"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    return events.control_state(rows)


@query("""SELECT doc_id AS task_id, section::INT AS section, md5(line) AS text FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS section FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))""")
def assembled_lines(t: Tables) -> DataFrame:
    """Lines put together from their words as from a model's stream, in which each piece comes twice."""
    lines = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("task_id"), F.posexplode(F.split("text", "\n")).alias("section", "line"))
    pieces = lines.select("task_id", "section", F.posexplode(F.split("line", "(?<= )")).alias("seq", "piece"))
    return events.assembled(pieces.union(pieces)).withColumn("text", F.md5("text"))


VERSIONS = "v AS (SELECT user_id AS doc_id, event_type AS kind, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version FROM events)"


def _versions(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), number.alias("version"))


@query(f"WITH {VERSIONS} SELECT doc_id, kind, max(version) + 1 AS next FROM v GROUP BY ALL", next="INT")
def next_versions(t: Tables) -> DataFrame:
    return records.next_version(_versions(t))


@query(f"WITH {VERSIONS} SELECT doc_id, kind, version, CASE WHEN kind = 'click' AND max(version) OVER (PARTITION BY doc_id, kind) >= 2 THEN version = 2 ELSE version = 1 END AS selected FROM v", version="INT")
def selected_versions(t: Tables) -> DataFrame:
    """The second version of clicks is chosen where there is one; else the first one stays."""
    v = _versions(t).withColumn("selected", F.col("version") == 1)
    chosen = v.where("kind = 'click'").select("doc_id", "kind").distinct().withColumn("version", F.lit(2))
    return records.select_version(v, chosen).select("doc_id", "kind", "version", "selected")


@query("""SELECT CAST(user_id AS VARCHAR) AS task_id, CASE WHEN user_id % 2 = 0 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS updated_at, CASE WHEN user_id % 3 = 0 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS created_at FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0 OR user_id % 3 <> 0""")
def created_tasks(t: Tables) -> DataFrame:
    """Users as tasks: those not divisible by three are there, the even ones are created, anew or again."""
    users = t.events.select(F.col("user_id").alias("u")).distinct()
    name = F.col("u").cast("string").alias("task_id")
    there = users.where("u % 3 <> 0").select(name, F.lit(1.0).alias("updated_at"), F.lit(1.0).alias("created_at"))
    return records.create_tasks(there, users.where("u % 2 = 0").select(name), 5.0).select("task_id", "updated_at", "created_at")


@query("SELECT DISTINCT source AS kb FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def unregistered_bases(t: Tables) -> DataFrame:
    bases = t.documents.select(F.col("source").alias("kb"), "doc_id")
    return records.register_bases(bases.where("doc_id % 97 = 0").select("kb").distinct(), bases)


@query(f"""{LISTS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY subquery, pos) AS n FROM l WHERE pos < 12)
  SELECT query_id, rank, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY subquery, pos) AS rank FROM f WHERE n = 1) WHERE rank <= 20""", rank="INT")
def listed_in_turn(t: Tables) -> DataFrame:
    """Lists of several searches one behind the other."""
    return answering.ordered_union(_lists(t).withColumn("list", F.col("subquery")))


PLAIN_ANSWER = "trim(regexp_replace(lower({c}), '[\\s[:punct:]]+', ' ', 'g'), ' ')"


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), k AS (SELECT regexp_extract_all(text, '\\S+') AS w, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark),
  j AS (SELECT doc_id, {PLAIN_ANSWER.format(c="coalesce(d.text, '')")} AS base, list_slice(w, 1, 8) AS w FROM documents d CROSS JOIN n JOIN k ON k.k = d.doc_id % n.n),
  c AS (SELECT doc_id, len(w) AS points, len(list_filter(list_transform(w, lambda x: {PLAIN_ANSWER.format(c='x')}), lambda x: length(x) >= 2 AND contains(base, x))) AS covered FROM j)
  SELECT doc_id AS id, points::INT AS points, covered::INT AS covered, round(covered / greatest(points, 1), 6) AS coverage FROM c""")
def answers_covered(t: Tables) -> DataFrame:
    """How many of the first words of its benchmark item each document holds, as answers that a text has to give."""
    found = t.benchmark.select("item_id", F.slice(F.regexp_extract_all("text", F.lit("\\S+"), 0), 1, 8).alias("w"))
    items = t.spark.createDataFrame([(k, [[x] for x in r["w"]]) for k, r in enumerate(found.orderBy("item_id").collect())], "k long, gold array<array<string>>")  # the stated set of items
    n = items.count()
    return drafts.answer_coverage(t.documents.join(items, F.col("k") == F.pmod(F.col("doc_id"), F.lit(n))).select(F.col("doc_id").alias("id"), X.text("text").alias("content"), "gold"))


@query("""SELECT system, count(*) FILTER (clean) AS clean_cases, count(*) FILTER (NOT clean) AS corrupt_cases, round(count(*) FILTER (clean AND passed) / greatest(count(*) FILTER (clean), 1), 4) AS clean_pass_rate,
  round(count(*) FILTER (NOT clean AND NOT passed) / greatest(count(*) FILTER (NOT clean), 1), 4) AS corrupt_detect_rate,
  round((count(*) FILTER (clean AND passed) / greatest(count(*) FILTER (clean), 1) + count(*) FILTER (NOT clean AND NOT passed) / greatest(count(*) FILTER (NOT clean), 1)) / 2, 4) AS balanced_score,
  round(coalesce(sum(issues) FILTER (clean), 0) / greatest(count(*) FILTER (clean), 1), 3) AS issues_clean, round(coalesce(sum(issues) FILTER (NOT clean), 0) / greatest(count(*) FILTER (NOT clean), 1), 3) AS issues_corrupt, round(count(*) FILTER (invalid) / count(*), 4) AS invalid_rate
  FROM (SELECT source AS system, quality = 1 AS clean, toxic = 0 AS passed, doc_id % 5 AS issues, doc_id % 7 = 0 AS invalid FROM labels JOIN documents USING (doc_id)) GROUP BY system""")
def critics_by_source(t: Tables) -> DataFrame:
    """Sources as critics: documents of good quality are the clean cases, those that aren't toxic pass."""
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return drafts.critic_summary(rows.select(
        F.col("source").alias("system"), F.when(F.col("quality") == 1, "clean").otherwise("corrupt").alias("variant"), (F.col("toxic") == 0).alias("passed"), (F.col("doc_id") % 5).alias("issue_count"), (F.col("doc_id") % 7 == 0).alias("invalid"),
    ))


@query("""WITH l AS (SELECT doc_id, unnest(p) AS body, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
  s AS (SELECT doc_id, CAST(pos AS VARCHAR) AS title, length(body) AS chars, (doc_id * 31 + pos * 7) % 10 / 10 AS faithfulness FROM l WHERE length(body) >= 50)
  SELECT doc_id, title, chars, faithfulness, row_number() OVER (PARTITION BY doc_id ORDER BY faithfulness, title) AS place FROM s""", chars="INT", place="INT")
def weakest_lines(t: Tables) -> DataFrame:
    """Lines as sections, the ones with the lowest scores first."""
    lines = t.documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body")).withColumn("title", F.col("pos").cast("string"))
    scores = lines.select("doc_id", "title", (F.pmod(F.col("doc_id") * 31 + F.col("pos") * 7, F.lit(10)) / 10).alias("faithfulness"))
    return drafts.weakest_sections(lines.select("doc_id", "title", "body"), scores)


@query(f"{HITS} SELECT query_id, rank, chunk_id, md5(substr(content, 1, 160)) AS snippet FROM h WHERE rank <= 6", rank="INT")
def citation_snippets(t: Tables) -> DataFrame:
    """The sources that an answer to each benchmark text would cite, with what they say."""
    cited = answering.answer_citations(_hits(t).withColumn("section_path", F.lit(""))).select("query_id", F.explode("citations").alias("c"))
    return cited.select("query_id", "c.rank", "c.chunk_id", F.md5("c.snippet").alias("snippet"))


@query()
def recursive_pieces(t: Tables) -> DataFrame:
    """Documents by the plain recursive splitter; a test compares the table function in SQL."""
    return chunking.recursive_chunks(t.documents, 400, 50).select("doc_id", "chunk_index", F.md5("content").alias("h"))
