"""Reading documents from files, and writing knowledge-base tables.

Binary files are read by Spark's own reader, so any store it knows will do, and parsed in Arrow batches. Parsers for
formats whose libraries may be missing are looked up when a file needs them; without one the error column says so.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_type
from ..operators.scan import fresh_names
from ..operators.similar import written

PLAIN_CHARS = 12_000
SHEETS, SHEET_ROWS = 5, 200


def decode(data: bytes) -> str:
    """UTF-8, then GB18030, then Latin-1; NUL characters go."""
    for name in ("utf-8", "gb18030", "latin-1"):
        try:
            return data.decode(name).replace("\x00", "")
        except UnicodeDecodeError:
            continue
    return ""


def _xml_text(data: bytes, part: str, mark: str) -> list[str]:
    """Texts of paragraphs in a part of an Office file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for name in sorted(n for n in z.namelist() if re.fullmatch(part, n)):
            for p in ElementTree.fromstring(z.read(name)).iter():
                if p.tag.endswith(mark):
                    line = "".join(t.text or "" for t in p.iter() if t.tag.endswith("}t"))
                    if line.strip():
                        out.append(line.strip())
        return out


def _docx(data: bytes) -> str:
    """Paragraphs and tables in the order of the document; a table's cells are joined by bars."""
    said = lambda node: "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t")).strip()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = next((x for x in root.iter() if x.tag.endswith("}body")), root)
    lines = []
    for child in body:
        if child.tag.endswith("}tbl"):
            lines += [" | ".join(said(c) for c in row if c.tag.endswith("}tc")) for row in child if row.tag.endswith("}tr")]
        else:
            lines += [said(p) for p in child.iter() if p.tag.endswith("}p")]
    return "\n".join(x for x in lines if x.strip(" |"))


def _pptx(data: bytes) -> str:
    return "\n".join(_xml_text(data, r"ppt/slides/slide\d+\.xml", "}p"))


def _xlsx(data: bytes, sheet_rows: int = SHEET_ROWS) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
        lines = []
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[:SHEETS]:
            rows = [r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")][:sheet_rows]
            for row in rows:
                cells = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    v = next((x.text or "" for x in c.iter() if x.tag.endswith(("}v", "}t"))), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                if any(cells):
                    lines.append(" | ".join(cells))
        return "\n".join(lines)


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("no PDF reader is installed") from None
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def parse(kind: str, data: bytes, ocr: Callable[[bytes], str] | None = None, sheet_rows: int = SHEET_ROWS) -> str:
    if kind == "docx":
        return _docx(data)
    if kind == "pptx":
        return _pptx(data)
    if kind == "pdf":
        return _pdf(data)
    if kind == "excel" and data[:2] == b"PK":
        return _xlsx(data, sheet_rows)
    if kind == "excel":
        return "\n".join(line.replace(",", " | ") for line in decode(data).splitlines()[:sheet_rows])
    if kind == "image":
        if ocr is None:
            raise ValueError("no OCR provider is given")
        return ocr(data)
    return decode(data)


def read_documents(spark: SparkSession, path: str, ocr: Callable[[bytes], str] | None = None, sheet_rows: int = SHEET_ROWS) -> DataFrame:
    """path, kind, text, error of every file below a folder. Of a workbook's first five sheets `sheet_rows` rows each are read: 200 for a base, 10 for a preview."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", file_type(F.col("path")).alias("kind"), "content")

    def run(batches):
        for pdf in batches:
            texts, errors = [], []
            for kind, data in zip(pdf.kind, pdf.content, strict=True):
                try:
                    texts.append(parse(kind, bytes(data), ocr, sheet_rows).replace("\x00", ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a broken file must not end the job; its row says what was wrong
                    texts.append("")
                    errors.append(str(e))
            yield pd.DataFrame({"path": pdf.path, "kind": pdf.kind, "text": texts, "error": errors})

    return rows.mapInPandas(run, "path string, kind string, text string, error string")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header: UTF-8 by Spark's reader, another encoding by decoding whole files; then all columns are strings unless a schema is given."""
    head = spark.read.text(path).limit(1).collect()
    if not head or "\ufffd" not in head[0][0]:
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)

    def run(batches):
        for pdf in batches:
            lines = [(k, line) for data in pdf.content for k, line in enumerate(decode(bytes(data)).splitlines())]
            yield pd.DataFrame(lines, columns=["n", "line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "n long, line string")
    if not schema:
        names = next(csv.reader([lines.where("n = 0").first().line]))
        schema = ", ".join(f"`{name}` string" for name in names)
    return lines.where("n > 0").select(F.from_csv("line", schema).alias("x")).select("x.*")


def read_json_column(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Columns for the keys of a JSON column, as text; what doesn't parse counts as {}. Each value is parsed once, into a variant."""
    name = column + "_parsed"
    while name in rows.columns:
        name += "_"
    parsed = rows.withColumn(name, F.try_parse_json(column))
    return parsed.withColumns({k: F.try_variant_get(name, f"$.{k}", "string") for k in keys}).drop(name)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database, for migration; partition: column, lower and upper bound, number."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, lo, hi, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=lo, upperBound=hi, numPartitions=n)
    return reader.load()


def write_kb(chunks: DataFrame, path: str) -> None:
    """Chunks by knowledge base; only the partitions present are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb").parquet(path)


def read_kb(spark: SparkSession, path: str, kb: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("kb") == kb)


def page_ranges(pages: DataFrame, size: int = 8, most: int = 30_000, plain: int = 20_000) -> DataFrame:
    """doc_id, text of pages (doc_id, page from 1, text). Up to `size` pages are joined until they have `plain` characters. Of longer
    documents ranges of `size` pages share `most`, 1000 at least each; a range ends with the page that fills its share, and pages are marked."""
    from pyspark.sql import Window

    n = F.max("page").over(Window.partitionBy("doc_id"))
    rows = pages.where(F.length("text") > 0).withColumn("long", n > size).withColumn("ranges", F.ceil(n / size))
    part = F.when(F.col("long"), F.floor((F.col("page") - 1) / size)).otherwise(0)
    share = F.when(F.col("long"), F.greatest(F.lit(1000), F.floor(most / F.col("ranges")))).otherwise(plain)
    before = F.sum(F.length("text")).over(Window.partitionBy("doc_id", "part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"part": part, "share": share}).withColumn("before", F.coalesce(before, F.lit(0))).where("before < share")
    line = F.when(F.col("long"), F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("] "), "text")).otherwise(F.col("text"))
    return rows.select("doc_id", "page", line.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line"))), lambda x: x["line"]), "\n").alias("text"))


def search_source(queries: DataFrame, provider: Callable[[str], list[dict]], most: int = 8) -> DataFrame:
    """query_id, pos, title, url, snippet from an injected remote search; a failing one gives no rows."""
    kind = dict(queries.dtypes)["query_id"]

    def run(batches):
        for pdf in batches:
            out = []
            for q, asked in zip(pdf.query_id, pdf["query"], strict=True):
                try:
                    found = provider(asked) or []
                except Exception:  # noqa: BLE001 - a search that fails must not end the job
                    found = []
                out += [(q, k, str(a.get("title") or ""), str(a.get("url") or ""), str(a.get("snippet") or "")) for k, a in enumerate(found[:most])]
            yield pd.DataFrame(out, columns=["query_id", "pos", "title", "url", "snippet"])

    return queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, pos int, title string, url string, snippet string")


def cache_key(*columns: str):
    """One key of several columns: content and options of what is cached."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]))


def cached(rows: DataFrame, key: str, cache: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results (md5, value) from a cache table where it has them, made for the other rows."""
    keyed = rows.withColumn("md5", F.md5(key))
    known = keyed.join(cache.select("md5", "value"), "md5")
    return known.unionByName(make(keyed.join(cache.select("md5"), "md5", "left_anti")))


class ResultCache:
    """Results of a costly function by the md5 of its input, in a table by day, of which old days are dropped.

    Rows meet the cache in one join on the md5, which Spark may precede by a Bloom filter of the smaller side; the function
    gets each missing input once, whatever number of rows has it. What it makes is written before it is used, so that a
    lost job costs what it had not written.
    """

    SCHEMA = "md5 string, value string, day int"

    def __init__(self, spark: SparkSession, path: str, days: int = 30):
        self.spark, self.path, self.days = spark, path, days

    def table(self, today: int) -> DataFrame:
        """md5, value: what is there of the last days."""
        try:
            found = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], self.SCHEMA)
        return found.where(F.col("day") > today - self.days).groupBy("md5").agg(F.max_by("value", "day").alias("value"))

    def get(self, rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], today: int) -> tuple[DataFrame, int]:
        """rows with `value`, and how many inputs had to be made. make: (md5, input) to (md5, value); a null input has a null value."""
        (name,) = fresh_names(rows, "md5")
        keyed = rows.withColumn(name, F.md5(F.col(key).cast("string")))
        inputs = keyed.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("md5")).agg(F.first(key).alias("input"))
        new = written(inputs.join(self.table(today).select("md5"), "md5", "left_anti"))
        n = new.count()
        if n:
            make(new).select("md5", "value", F.lit(today).alias("day")).write.mode("append").partitionBy("day").parquet(self.path)
        have = self.table(today).select(F.col("md5").alias(f"{name}_have"), "value")
        return keyed.join(have, F.col(name) == F.col(f"{name}_have"), "left").drop(name, f"{name}_have"), n

    def evict(self, today: int) -> list[int]:
        """Drops the days that are too old, and gives them."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        days = [int(s.getPath().getName()[4:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("day=")]
        old = sorted(d for d in days if d <= today - self.days)
        for d in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day={d}"), True)
        return old


def merge_tables(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, page, idx, headers, rows): one without headers that continues the page before, as wide, joins it."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("page", "idx")
    width = F.greatest(F.size("headers"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)))
    rows = tables.withColumn("width", width)
    goes_on = (F.size(F.filter("headers", lambda h: F.trim(h) != "")) == 0) & (F.col("page") - F.lag("page").over(w) == 1) & (F.col("width") == F.lag("width").over(w))
    rows = rows.withColumn("table", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w))
    packed = F.array_sort(F.collect_list(F.struct("page", "idx", "headers", "rows")))
    out = rows.groupBy("doc_id", "table").agg(packed.alias("x"))
    return out.select("doc_id", "table", F.col("x")[0]["page"].alias("page"), F.col("x")[0]["headers"].alias("headers"), F.flatten("x.rows").alias("rows"))


def to_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def loads(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}
