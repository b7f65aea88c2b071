"""Queries over the business tables: spreadsheet analytics, knowledge-base administration, history, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import records, similar, tabular
from ..sources import files, tables
from ..streaming import state
from .catalog import Tables, query
from .retrieval import chunks

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 2) AS mean, round(quantile_cont({c}, 0.5), 2) AS median, round(stddev_samp({c}), 2) AS sd, min({c}) AS low, max({c}) AS high FROM lineitem" for c in COLUMNS))
def tabular_describe(t: Tables) -> DataFrame:
    return tabular.describe(t.lineitem, COLUMNS)


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100 + l_linenumber, l_extendedprice) - 1 AS at_, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
  h AS (SELECT l_suppkey, avg(v) FILTER (at_ < n // 2) AS a, avg(v) FILTER (at_ >= n // 2) AS b FROM r WHERE n >= 3 GROUP BY l_suppkey)
  SELECT l_suppkey, CASE WHEN b > a * 1.05 THEN 'up' WHEN b < a * 0.95 THEN 'down' ELSE 'flat' END AS trend, round(abs(b - a) / greatest(abs(a), 0.01) * 100, 2) AS pct FROM h""")
def trend_halves(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("o", F.struct(F.col("l_orderkey") * 100 + F.col("l_linenumber"), "l_extendedprice"))
    return tabular.trend(rows, ["l_suppkey"], "o", "l_extendedprice")


CORR = " UNION ALL ".join(f"SELECT '{a}' AS anchor, var_samp({a}) AS v, '{b}' AS name, corr({a}, {b}) AS r FROM lineitem" for a in COLUMNS for b in COLUMNS if a != b)


@query(f"SELECT anchor, name, round(r, 6) AS r FROM ({CORR}) QUALIFY v = max(v) OVER ()")
def corr_top(t: Tables) -> DataFrame:
    """All columns against the one of the largest variance."""
    return tabular.correlations(t.lineitem, COLUMNS, -1.0)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, '{s}' AS side, (row_number() OVER ())::INT AS rank, p_partkey AS key, {c}::DOUBLE AS value FROM (SELECT * FROM part ORDER BY {c} {o}, p_partkey LIMIT 3)" for c in ("p_size", "p_retailprice") for s, o in (("top", "DESC"), ("bottom", "ASC"))))
def top_bottom3(t: Tables) -> DataFrame:
    return tabular.extremes(t.part, "p_partkey", ["p_size", "p_retailprice"])


@query("""WITH s AS (SELECT p_brand AS label, sum(p_retailprice::DECIMAL(38, 2)) AS v FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rn FROM s)
  SELECT CASE WHEN rn <= 7 THEN label ELSE '其他' END AS label, sum(v)::DOUBLE AS value FROM r GROUP BY 1""")
def pie_others(t: Tables) -> DataFrame:
    return tabular.top_and_others(t.part, "p_brand", "p_retailprice")


@query("SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS orders, sum(o_totalprice::DECIMAL(38, 2))::DOUBLE AS total FROM orders GROUP BY ALL")
def chart_lines(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(38,2)")).cast("double").alias("total"))


@query("SELECT source AS kb, count(DISTINCT doc_id) AS docs, CAST(sum((length(text) - 1) // 700 + 1) AS BIGINT) AS chunks FROM documents WHERE length(text) > 0 GROUP BY 1")
def kb_stats(t: Tables) -> DataFrame:
    return records.base_stats(chunks(t))


@query("SELECT DISTINCT source AS kb FROM documents")
def distinct_kb(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("kb")).distinct().orderBy("kb")


@query("SELECT user_id AS doc_id, coalesce(n, 0) AS chunks, last FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) USING (user_id)")
def list_docs(t: Tables) -> DataFrame:
    docs = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    n = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    return docs.join(n, "user_id", "left").select(F.col("user_id").alias("doc_id"), F.coalesce("n", F.lit(0)).alias("chunks"), "last").orderBy(F.desc("last"))


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def latest_per_key(t: Tables) -> DataFrame:
    return records.latest(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max_by(value, (ts, event_id)) AS progress FROM events GROUP BY user_id")
def status_latest(t: Tables) -> DataFrame:
    return records.latest(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("status"), F.col("value").alias("progress"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max_by(value, (ts, event_id)) AS progress FROM events GROUP BY user_id")
def status_stream(t: Tables) -> DataFrame:
    """The same from the events as a stream, the last of each user as keyed state."""
    rows = t.events.select("user_id", "event_type", "value", "ts", "event_id")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]").select(rows.columns)  # a pattern may name a file or a folder
    where = similar.folder(t.spark, "status")
    state.drain(stream, "user_id", ["ts", "event_id"], where)
    return state.current(t.spark, where, "user_id").select("user_id", F.col("event_type").alias("status"), F.col("value").alias("progress"))


@query("""WITH v AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS rn FROM v)
  SELECT doc_id, version FROM r WHERE version = 1 OR rn <= 19""", version="INT")
def retention(t: Tables) -> DataFrame:
    v = t.events.select(F.col("user_id").alias("doc_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("version"))
    return records.keep_versions(v)


@query("""SELECT source AS kb, doc_id, updated, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated DESC, new DESC) AS rn FROM (
  SELECT source, doc_id, 1 AS updated, 'old' AS title, 0 AS new FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT source, doc_id, 1 + doc_id % 2, 'new', 1 FROM documents WHERE doc_id % 2 = 0)) WHERE rn = 1""")
def upsert_docs(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("source").alias("kb"), "doc_id")
    old = docs.where("doc_id % 3 <> 0").withColumn("updated", F.lit(1).cast("long")).withColumn("title", F.lit("old"))
    new = docs.where("doc_id % 2 = 0").withColumn("updated", 1 + F.col("doc_id") % 2).withColumn("title", F.lit("new"))
    return records.upsert(old, new, ["doc_id"], "updated")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' WHEN o_orderkey % 4 = 0 THEN 'N' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE o_totalprice END AS total
  FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def merged_batches(t: Tables) -> DataFrame:
    """Orders as a table that takes batches: two that insert, a compaction, one that replaces, a cascade of deletes, a point update."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    table = tables.KeyedTable(t.spark, similar.folder(t.spark, "orders"), rows.schema, ["o_orderkey", "o_custkey"])
    table.upsert(rows.where("o_orderkey % 3 = 1"))
    table.upsert(rows.where("o_orderkey % 3 = 2"))
    table.compact()
    table.upsert(rows.where("o_orderkey % 4 = 0").withColumns({"status": F.lit("N"), "total": F.lit(0.0)}))
    table.delete(t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")))
    table.update(rows.where("o_orderkey % 5 = 0").select("o_orderkey", "o_custkey", F.lit("X").alias("status")), ["status"])
    return table.read()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_cascade(t: Tables) -> DataFrame:
    gone = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return records.delete(t.orders, gone).select("o_orderkey", "o_custkey")


@query("""SELECT conv_id, turn, role, substr(text, 1, 2000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant')) WHERE rn <= 50""")
def chat_last50(t: Tables) -> DataFrame:
    return records.chat_tail(t.conversations)


@query("""SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE NOT coalesce(r = role AND x = text, false)""")
def chat_dedup_consecutive(t: Tables) -> DataFrame:
    return records.without_repeats(t.conversations).select("conv_id", "turn", "role")


@query("""SELECT conv_id, count(*) AS messages, round(sum(length(text)) / 1.5, 2) AS est_tokens, CASE WHEN count(*) > 6 OR (sum(length(text)) / 1.5 > 2000 AND count(*) >= 6) THEN greatest(count(*) - 3, 0) ELSE 0 END AS to_summarise FROM conversations GROUP BY conv_id""")
def chat_summary_due(t: Tables) -> DataFrame:
    return records.needs_summary(t.conversations, most=6, keep=3)


@query("SELECT n_name, count(*) AS customers, sum(c_acctbal::DECIMAL(38, 2))::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def kb_join_counts(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(38,2)")).cast("double").alias("balance"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_daily(t: Tables) -> DataFrame:
    """Extension: tumbling windows, as the streaming form gives them."""
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) // 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def json_props(t: Tables) -> DataFrame:
    rows = files.read_json_column(t.events, "props", ["k"])
    return rows.groupBy("event_type", F.floor(F.col("k").cast("int") / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
