"""Queries on what Spark derives from the given tables: encoded texts, spreadsheets and SQL statements."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charset, sql_names
from ..sources import spreadsheet, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


PAGES = ("cp1252", "cp850", "utf-8")
#: Stands for characters that a page lacks. A question mark would make plain ASCII of a text that has only such ones.
LACKING = "é"


def _bytes(text: str, page: str) -> bytes:
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        known = {c: c if c.encode(page, "ignore") else LACKING for c in set(text)}
        return "".join(known[c] for c in text).encode(page)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [_bytes(t or "", PAGES[i % 3]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])


@_query("""SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]') THEN 'cp1252' ELSE ['cp1252', 'cp850', 'utf-8'][doc_id % 3 + 1] END AS encoding FROM documents WHERE doc_id IS NOT NULL AND doc_id % 5 = 0""")
def charset_labels(spark, d):
    """The code page of texts that were encoded by three of them, told by a model of the other texts."""
    docs = table(spark, d, "documents").select("doc_id", "text").where("doc_id IS NOT NULL")
    model = charset.learn(docs.where("doc_id % 5 <> 0"), "text")
    raw = docs.where("doc_id % 5 = 0").mapInArrow(_encoded, "doc_id long, raw binary")
    return charset.detected(raw, "raw", model)


def workbook(rows: list[tuple]) -> bytes:
    """A workbook with one sheet: texts as shared strings but for every third, numbers as they are."""
    strings: dict[str, int] = {}
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if isinstance(v, str) and (r + c) % 3:
                cells.append(f'<c r="{at}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>')
            elif isinstance(v, str):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><r><t>{escape(s)}</t></r></si>' for s in strings)}</sst>")
    return out.getvalue()


def _workbooks(key: tuple, group: pa.Table) -> pa.Table:
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")), strict=True))
    return pa.table({"path": pa.array([str(key[0].as_py())]), "content": pa.array([workbook([("KEY", "NAME", "SEGMENT", "NATION"), *rows])], pa.binary())})


@_query("""SELECT (c_custkey // 200)::VARCHAR AS book, c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer""")
def sheet_rows(spark, d):
    """The rows of workbooks of two hundred customers each, read back from their sheets."""
    books = table(spark, d, "customer").withColumn("book", F.floor(F.col("c_custkey") / 200)).groupBy("book").applyInArrow(_workbooks, "path string, content binary")
    rows = spreadsheet.parsed(books).where("row > 0")
    return rows.select(F.col("path").alias("book"), *[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(("key", "name", "segment", "nation"))])


#: Statements about a part, and the tables that each names; # stands for the part's key.
STATEMENTS: tuple[tuple[str, str], ...] = (
    ("SELECT a.x FROM T# a, \"My #\" b WHERE a.k = b.k AND b.n NOT IN ('FROM X#')", "T#,MY #"),
    ("WITH c# AS (SELECT k FROM base# WHERE v > 1), d (k) AS (SELECT k FROM c#) SELECT * FROM d JOIN dbo.[Other#] o ON o.k = d.k", "BASE#,OTHER#"),
    ("-- FROM none#\nUPDATE stock# SET n = (SELECT max(n) FROM log# /* FROM gone# */) WHERE k = 1", "STOCK#,LOG#"),
    ("INSERT INTO sums# SELECT extract(year FROM made) y, count(*) FROM (SELECT made FROM inner# UNION ALL SELECT made FROM late#) u GROUP BY 1", "SUMS#,INNER#,LATE#"),
    ("DELETE FROM old# WHERE EXISTS (SELECT 1 FROM live# l LEFT JOIN more# m ON m.k = l.k)", "OLD#,LIVE#,MORE#"),
    ("SELECT * FROM %table:SA#% SA JOIN plain# p ON p.k = SA.k, series(1, 3) s", "PLAIN#,%SA#"),
)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sql_names.tables(s) for s in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["p_partkey", "tables"])


def _choice(texts: list[str]) -> str:
    return "CASE p_partkey % {0} {1} END".format(len(texts), " ".join("WHEN {0} THEN '{1}'".format(k, t.replace("'", "''")) for k, t in enumerate(texts)))


@_query(f"""SELECT p_partkey, unnest(string_split(replace({_choice([t for _, t in STATEMENTS])}, '#', p_partkey::VARCHAR), ',')) AS name FROM part""")
def sql_table_names(spark, d):
    """The tables of a statement for each part: lists, subqueries, common tables, quoted names, comments, macros."""
    sql = F.get(F.array(*[F.lit(s) for s, _ in STATEMENTS]), (F.col("p_partkey") % len(STATEMENTS)).cast("int"))
    # keys are dealt out before statements are made of them: a few MB of parts may lie in one row group, which one task reads
    part = table(spark, d, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism)
    rows = part.select("p_partkey", F.replace(sql, F.lit("#"), F.col("p_partkey").cast("string")).alias("sql"))
    return rows.mapInArrow(_named, "p_partkey long, tables array<string>").select("p_partkey", F.explode("tables").alias("name"))
