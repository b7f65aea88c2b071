"""Extraction records, knowledge-base tables, chat history and versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity_tokens, text
from . import similar
from .scan import fresh_names, running

FIELDS = ["title", "summary", "key_points", "keywords", "conclusion", "prediction", "data"]
REQUIRED = ["title", "summary", "key_points"]


def completeness(records: DataFrame, fields: list[str] = FIELDS, required: list[str] = REQUIRED) -> DataFrame:
    """records with filled, ratio, required_ok and missing (required fields without content)."""
    kinds = dict(records.dtypes)
    full = {f: (F.size(f) > 0 if kinds[f].startswith(("array", "map")) else F.trim(text(f)) != "") for f in fields}
    full = {f: F.coalesce(c, F.lit(False)) for f, c in full.items()}
    missing = F.array_compact(F.array(*[F.when(~full[f], F.lit(f)) for f in required]))
    filled = sum((full[f].cast("int") for f in fields), F.lit(0))
    return records.withColumns({"filled": filled, "ratio": F.round(filled / len(fields), 4), "required_ok": F.size(missing) == 0, "missing": missing})


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")


def repair(records: DataFrame, answers: DataFrame, key: str = "file", required: list[str] = REQUIRED) -> DataFrame:
    """records in which fields that are missing come from a second extraction (key and fields); what is there stays."""
    kinds = dict(records.dtypes)
    new = answers.select(key, *[F.col(f).alias(f"{f}__") for f in required])
    full = lambda f: F.coalesce(F.size(f) > 0 if kinds[f].startswith("array") else F.trim(text(f)) != "", F.lit(False))
    rows = records.join(new, key, "left")
    return rows.withColumns({f: F.when(full(f), F.col(f)).otherwise(F.coalesce(f"{f}__", f)) for f in required}).select(*records.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """table with rows inserted or replaced: the last writer of a key wins, the new rows over old ones of the same time."""
    both = table.withColumn("new__", F.lit(0)).unionByName(rows.withColumn("new__", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [order, "new__"]).drop("new__")


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """table without the rows whose keys (all columns of `keys`) are listed; for chunks the same keys cascade."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


def fill_missing(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Point update: values (key, column) go in where they are given."""
    new = values.select(key, F.col(column).alias("new__"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("new__", column)).drop("new__")


def keep_versions(versions: DataFrame, slots: int = 20) -> DataFrame:
    """Version 1 and the newest others, `slots` in all, of each document and kind."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("version"))
    return versions.withColumn("rn__", F.row_number().over(w)).where((F.col("version") == 1) | (F.col("rn__") <= slots - 1)).drop("rn__")


def chat_tail(messages: DataFrame, most: int = 50, chars: int = 2000) -> DataFrame:
    """The last messages of users and assistants in each conversation, clipped."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.where(F.col("role").isin("user", "assistant")).withColumn("rn__", F.row_number().over(w)).where(F.col("rn__") <= most)
    return rows.select("conv_id", "turn", "role", F.substring(text("text"), 1, chars).alias("text"))


def without_repeats(messages: DataFrame) -> DataFrame:
    """Messages other than the one just before by role and text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = (F.lag("role").over(w) == F.col("role")) & (F.lag("text").over(w) == F.col("text"))
    return messages.withColumn("same__", F.coalesce(same, F.lit(False))).where("NOT same__").drop("same__")


def needs_summary(messages: DataFrame, most: int = 16, most_tokens: float = 2000, least: int = 6, keep: int = 8) -> DataFrame:
    """conv_id, messages, est_tokens, to_summarise: how many old messages to fold into a summary."""
    per = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.round(F.sum(F.length(text("text"))) / 1.5, 2).alias("est_tokens"))
    due = (F.col("messages") > most) | ((F.col("est_tokens") > most_tokens) & (F.col("messages") >= least))
    return per.withColumn("to_summarise", F.when(due, F.greatest(F.col("messages") - keep, F.lit(0))).otherwise(0))


def digest(records: DataFrame, by: list[str], order: list[str], total: int = 3500, least: int = 300) -> DataFrame:
    """Records' lines with a fair share of the total each, until the total is reached. `order` is total within `by`; a group may lie in several tasks."""
    names = fresh_names(records, *(f"of_{b}" for b in by), "n")
    sizes = records.groupBy(*(F.col(b).alias(g) for b, g in zip(by, names, strict=False))).agg(F.count("*").alias(names[-1]))
    same = F.lit(True)
    for b, g in zip(by, names, strict=False):
        same = same & F.col(b).eqNullSafe(F.col(g))
    quota = F.greatest(F.lit(least), F.floor(F.lit(total) / F.col(names[-1])).cast("int"))
    rows = records.join(sizes, same).withColumn("line", F.substring(F.col("line"), F.lit(1), quota)).drop(*names)
    return running(rows, by, order, {"used": F.length("line")}).where(F.col("used") <= total)


def better(a: Column, b: Column) -> Column:
    """Of two extractions (struct required_ok, filled, summary_len) the one that scores higher; the second wins ties."""
    score = lambda x: 3 * x["required_ok"].cast("int") + x["filled"] + F.least(x["summary_len"] / 200, F.lit(1.0))
    return F.when(score(b) >= score(a), F.lit("b")).otherwise(F.lit("a"))


def merge_similar(records: DataFrame, by: str = "task_id", least: float = 0.82, points: int = 7) -> DataFrame:
    """Records of a task (a bounded group: its files) merged in order: each joins the first kept one that it resembles.

    records: by, order_index, file, title, summary, key_points (array), data (string or null). Similarity is the larger of
    the Jaccard similarity of words and CJK characters and the ratio of matching blocks, over title, summary and the first
    five key points; records without any of these stay. The better of two (see `better`) gives the fields, the other one
    what is missing; key points of both add up. Gives by, order_index (of the first), title, summary, key_points, data, files.
    """
    import re
    from difflib import SequenceMatcher

    def full(value) -> bool:
        return value is not None and len(value) > 0

    def basis(r: dict) -> str:
        return " ".join([(r["title"] or "").strip(), (r["summary"] or "").strip(), " ".join(map(str, list(r["key_points"] if r["key_points"] is not None else [])[:5]))]).strip()

    def alike(a: str, b: str) -> float:
        x, y = (set(re.findall(r"[a-z0-9]{2,}|[\u4e00-\u9fff]", s.lower())) for s in (a, b))
        words = len(x & y) / len(x | y) if x | y else 0.0
        return words if words >= least else max(words, SequenceMatcher(None, a, b).ratio())

    def worth(r: dict) -> float:
        shown = [(r["title"] or "").strip(), (r["summary"] or "").strip(), r["key_points"]]
        return 3 * all(map(full, shown)) + sum(map(full, [*shown, r["data"]])) + min(len(shown[1]) / 200, 1.0)

    def merge(pdf):
        kept: list[dict] = []
        for r in pdf.sort_values("order_index").to_dict("records"):
            r["files"], own = [r["file"]] if r["file"] else [], basis(r)
            place = next((k for k, o in enumerate(kept) if own and basis(o) and alike(own, basis(o)) >= least), None)
            if place is None:
                kept.append(r)
                continue
            old = kept[place]
            good, weak = (r, old) if worth(r) >= worth(old) else (old, r)
            made = dict(good) | {c: good[c] if full(good[c]) else weak[c] for c in ("title", "summary", "data")}
            both = [str(x).strip() for o in (old, r) for x in (o["key_points"] if o["key_points"] is not None else [])]
            kept[place] = made | {"order_index": old["order_index"], "files": list(dict.fromkeys([*old["files"], *r["files"]])), "key_points": list(dict.fromkeys(x for x in both if x))[:points]}
        return type(pdf)(kept, columns=[by, "order_index", "title", "summary", "key_points", "data", "files"])

    kinds = dict(records.dtypes)
    schema = f"{by} {kinds[by]}, order_index {kinds['order_index']}, title string, summary string, key_points array<string>, data string, files array<string>"
    return records.groupBy(by).applyInPandas(merge, schema)


def create_tasks(tasks: DataFrame, rows: DataFrame, now: float) -> DataFrame:
    """tasks (task_id, ..., created_at, updated_at) with new ones; of those that exist only updated_at changes."""
    fresh = rows.withColumns({"created_at": F.lit(now), "updated_at": F.lit(now)}).join(tasks.select("task_id"), "task_id", "left_anti")
    known = tasks.join(rows.select("task_id", F.lit(True).alias("seen__")).distinct(), "task_id", "left")
    kept = known.withColumn("updated_at", F.when(F.col("seen__"), F.lit(now)).otherwise(F.col("updated_at"))).select(*tasks.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def list_versions(versions: DataFrame) -> DataFrame:
    """Versions of each document and kind in order, with their file names."""
    return versions.withColumn("file", F.concat_ws("_v", "kind", F.col("version").cast("string"))).orderBy("doc_id", "kind", "version")


def register_bases(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Marker rows (kb) for bases that have none yet."""
    return names.select("kb").distinct().join(registry.select("kb"), "kb", "left_anti")


def base_stats(chunks: DataFrame, registry: str = "__registry__") -> DataFrame:
    """kb, docs, chunks of each base; documents that only mark a base (ids that begin with `registry`) count as neither."""
    own = chunks.where(~F.col("doc_id").cast("string").startswith(registry))
    return own.groupBy("kb").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("chunks"))


def next_version(versions: DataFrame) -> DataFrame:
    """doc_id, kind, next: one more than the largest version."""
    return versions.groupBy("doc_id", "kind").agg((F.max("version") + 1).alias("next"))


def select_version(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """versions with selected: of a document and kind that `chosen` (doc_id, kind, version) names one existing version of, that one only."""
    want = chosen.join(versions.select("doc_id", "kind", "version"), ["doc_id", "kind", "version"], "left_semi").select("doc_id", "kind", F.col("version").alias("want__"))
    rows = versions.join(want, ["doc_id", "kind"], "left")
    return rows.withColumn("selected", F.when(F.col("want__").isNotNull(), F.col("version") == F.col("want__")).otherwise(F.coalesce("selected", F.lit(False)))).drop("want__")


def list_tasks(status: DataFrame, chats: DataFrame, hidden: tuple[str, ...] = ("template", "kb")) -> DataFrame:
    """task_id, status, stage, message, updated_at, has_chat: tasks with a status, the newest first; hidden folders are none."""
    rows = latest(status.where(~F.col("task_id").startswith(".") & ~F.col("task_id").isin(*hidden)), ["task_id"], ["updated_at"])
    rows = rows.join(chats.select("task_id").distinct().withColumn("has_chat", F.lit(True)), "task_id", "left")
    return rows.select("task_id", text("status").alias("status"), text("stage").alias("stage"), F.substring(text("message"), 1, 120).alias("message"), "updated_at", F.coalesce("has_chat", F.lit(False)).alias("has_chat")).orderBy(F.desc("updated_at"), "task_id")


def better_quality(a: Column, b: Column) -> Column:
    """Whether b (struct filled, ratio) is at least as good as a: by filled fields, then by their share."""
    n = lambda x, f: F.coalesce(x[f].cast("double"), F.lit(0.0))
    return F.when(n(a, "filled") != n(b, "filled"), n(b, "filled") > n(a, "filled")).otherwise(n(b, "ratio") >= n(a, "ratio"))


def near_duplicates(records: DataFrame, content: str, key: str, least: float = 0.75, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, kept_key: greedy by key, every record joins the first kept one that it resembles.

    Similarity is Jaccard's, of words and CJK characters. All records are compared, without loss (see similar.py), or those within a
    block (of their tokens) only if one is given. merge_similar has the ratio of matching blocks too.
    """
    if block is None:
        return similar.first_kept(records, content, key, least)
    rows = records.select(F.col(key).alias("key"), similarity_tokens(text(content)).alias("grams"))
    rows = rows.withColumn("block", F.coalesce(block(F.col("grams")), F.lit(0)))

    def pick(pdf):
        pdf, kept, out = pdf.sort_values("key"), [], []
        for k, grams in zip(pdf.key, map(set, pdf.grams), strict=True):
            hit = next((o for o, g in kept if len(grams & g) >= least * len(grams | g)), k)
            if hit == k:
                kept.append((k, grams))
            out.append(hit)
        return pdf[["key"]].assign(kept_key=out)

    kind = dict(records.dtypes)[key]
    return rows.groupBy("block").applyInPandas(pick, f"key {kind}, kept_key {kind}")
