"""Sources: documents, their sidecar texts, snapshots, corrections, expert files and edited workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.textnorm import normalize
from ..operators.layout import joined_pages
from ..schema import CORRECTION, EXPERT_DOCUMENTS, EXPERT_PAGES, FIELDS, SNAPSHOT_ROW, SPAN
from . import snapshots

PAGES = f"page_no int, width double, plain string, blocks array<struct<kind:int,text:string>>, spans {SPAN}"


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """The .pdf files of a folder, whatever the case of their suffix, or one file: path, modificationTime, length, content; not its subfolders."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)


def decoded(documents: DataFrame, decoder: Callable[[bytes], list[dict]]) -> DataFrame:
    """(source, text, error) of documents. decoder: bytes to the page dicts of PAGES (the library that reads PDFs is the caller's); what it
    raises becomes the file's error and never fails the job. Each document is decoded once, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                try:
                    pages, error = decoder(content), None
                except Exception as e:  # noqa: BLE001
                    pages, error = [], f"{e}"
                yield pa.RecordBatch.from_pylist([{"source": path, "pages": pages, "error": error}], schema)

    span = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")] + [("text", pa.string())])
    page = pa.struct([("page_no", pa.int32()), ("width", pa.float64()), ("plain", pa.string()), ("blocks", pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))), ("spans", pa.list_(span))])
    schema = pa.schema([("source", pa.string()), ("pages", pa.list_(page)), ("error", pa.string())])
    own = documents.select("path", "content").mapInArrow(run, f"source string, pages array<struct<{re.sub(r'(\w+) (?=int|double|string|array)', r'\1:', PAGES)}>>, error string")
    return own.select("source", F.coalesce(joined_pages(F.col("pages")), F.lit("")).alias("text"), "error")


def read_texts(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """Whole text files, form feeds kept: source (file name), text. Spark's readers leave out files of no bytes."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=names).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source"), F.col("value").alias("text"))


def file_marks(files: DataFrame) -> DataFrame:
    """A reader's rows with the path, size and time of their files, which key the cache: path, length, modified."""
    m = F.col("_metadata")
    return files.withColumns({"path": m["file_path"], "length": m["file_size"], "modified": m["file_modification_time"]})


def with_sidecars(documents: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(source, text): the text beside a document if there is one, else the document's own."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    own = documents.withColumn("_stem", stem(F.col("source")))
    side = sidecars.select(stem(F.col("source")).alias("_stem"), F.col("text").alias("_side"))
    return own.join(side, "_stem", "left").withColumn("text", F.coalesce("_side", "text")).drop("_stem", "_side")


def normalized(files: DataFrame) -> DataFrame:
    return files.withColumn("text", normalize(F.coalesce("text", F.lit(""))))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a snapshot, a table or one JSON text, with row_no; none if the file cannot be read as one."""
    if snapshots.is_table(spark, path):
        return snapshots.read(spark, path)
    schema = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("generated_at", T.StringType()), T.StructField("rows", T.ArrayType(SNAPSHOT_ROW))])
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE").select(F.posexplode("rows").alias("row_no", "r")).select("row_no", "r.*")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections as JSON lines; bad lines and those without a required key are left out, further keys are not looked at."""
    own = spark.read.schema(CORRECTION).json(path, mode="DROPMALFORMED")
    required = ["source", "field", "original", "corrected", "original_confidence", "kind"]
    return own.dropna(subset=required)


def expert_json(texts: DataFrame) -> DataFrame:
    """(source_file, text) of expert files to (source_file, documents, pages); what is no JSON, or of another shape, is NULL and fails nothing."""
    own = texts.select("source_file", F.from_json("text", "documents string, pages string").alias("e"))
    return own.select("source_file", F.from_json("e.documents", EXPERT_DOCUMENTS).alias("documents"), F.from_json("e.pages", EXPERT_PAGES).alias("pages"))


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """The .json files of a folder as expert_json gives them; Spark's readers leave out files of no bytes."""
    own = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return expert_json(own.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source_file"), F.col("value").alias("text")))


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Golden cases of a folder: (source, text) of the .txt files, and (case, text) of the .expected.json files that have such a file beside them."""
    texts = read_texts(spark, path, "*.txt")
    rules = read_texts(spark, path, "*.expected.json").select(F.regexp_replace("source", r"\.expected\.json$", "").alias("case"), "text")
    return texts, rules.join(texts.select(F.regexp_replace("source", r"\.txt$", "").alias("case")), "case", "left_semi")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
COLUMNS = ["waybill", *FIELDS, "source", "note", "pct"]


def workbook_rows(content: bytes) -> list[dict]:
    """Rows 2 and on of a workbook's first sheet, 13 columns by place, stripped; empty cells are ''."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        out = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{_NS}row"):
            cells = dict.fromkeys(COLUMNS, "")
            for c in row.iter(f"{_NS}c"):
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A1"))[0]:
                    at = at * 26 + ord(ch) - 64
                v, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_NS}t")) if inline is not None else (shared[int(v.text)] if c.get("t") == "s" else v.text or "") if v is not None else ""
                if at <= len(COLUMNS):
                    cells[COLUMNS[at - 1]] = text.strip()
            out.append(cells)
        return out[1:]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Edited workbooks, one task's memory for one file: file, row_no from 0 and the columns of the sheet."""
    schema = pa.schema([("file", pa.string()), ("row_no", pa.int64()), *((c, pa.string()) for c in COLUMNS)])

    def run(batches):
        for batch in batches:
            for file, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                yield pa.RecordBatch.from_pylist([{"file": file, "row_no": i, **r} for i, r in enumerate(workbook_rows(content))], schema)

    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return own.mapInArrow(run, "file string, row_no long, " + ", ".join(f"{c} string" for c in COLUMNS))
