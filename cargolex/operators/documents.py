"""Splitting a file's text into its waybills.

A file that mixes waybills with invoices or registries is split by page; any other one at the lines that head a waybill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.rx import has, let, marked, strip
from ..schema import is_blank

# What marks kinds of pages.
HEADER = r"транспортн\w+\s+накладн\w+"
HEADER_LINE = r"^\s*транспортн(?:ая|ой)\s+накладн(?:ая|ой)\b"
FIRST_PAGE = r"грузоотправ|грузополуч|перевозчик|транспортн\w+\s+средств"
INVOICE = r"счет[-\s]?фактура|универсал\w+\s+передаточн"
REGISTRY = r"\bреестр\b|отгрузочн\w+\s+специф|товарн\w+\s+реестр"
#: What every invoice's and every registry's mark holds: letters of one range, then the rest of a word. One scan for all of them.
MARKED_PAGE = r"[о-у](?:чет|ниверсал|еестр|тгрузочн|оварн)"
PAGE_HEAD, LEAST_PAGE, LEAST_DOCUMENT = 800, 100, 80


def page_kind(page: Column) -> Column:
    """upd, registry, ttn_start, ttn_cont or blank."""

    def by_mark(head: Column) -> Column:
        return F.when(has(head, MARKED_PAGE), F.when(has(head, INVOICE), "upd").when(has(head, REGISTRY), "registry"))

    def by_form(page: Column) -> Column:
        return F.when(~has(page, HEADER), "blank").when(has(page, FIRST_PAGE), "ttn_start").otherwise("ttn_cont")

    return F.when(F.length(strip(page)) < LEAST_PAGE, "blank").otherwise(F.coalesce(let(F.substring(page, 1, PAGE_HEAD), by_mark), by_form(page)))


def pages_of(text: Column) -> Column:
    """The pages of a file: text and kind."""
    return F.transform(F.split(text, "\f", -1), lambda p: F.struct(p.alias("text"), page_kind(p).alias("kind")))


def _long_enough(documents: Column) -> Column:
    return F.filter(documents, lambda d: F.length(d) >= LEAST_DOCUMENT)


def split_by_pages(text: Column) -> Column:
    """Waybills of a mixed file, as an array; empty for any other file. A file of one page is not mixed, whatever its page."""
    return F.when(text.contains("\f"), let(pages_of(text), joined_pages)).otherwise(F.array().cast("array<string>"))


def joined_pages(pages: Column) -> Column:
    """The same of the file's pages."""

    def step(done: Column, page: Column) -> Column:
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.get(done, F.size(done) - 1), F.lit("\n"), page["text"])))
        return F.when(page["kind"] == "ttn_start", F.concat(done, F.array(page["text"]))).when((page["kind"] == "ttn_cont") & (F.size(done) > 0), grown).otherwise(done)

    mixed = F.exists(pages, lambda p: p["kind"] == "ttn_start") & F.exists(pages, lambda p: p["kind"].isin("upd", "registry"))
    none = F.array().cast("array<string>")
    return F.when(mixed, _long_enough(F.transform(F.aggregate(pages, none, step), lambda x: strip(x)))).otherwise(none)


def split_at_headers(text: Column) -> Column:
    """Waybills from each heading line to the next; the whole text if fewer than two are long enough to count."""

    def parted(parts: Column) -> Column:
        own = _long_enough(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: strip(x)))
        whole = F.array(strip(text))
        return F.when(F.size(parts) <= 2, whole).otherwise(let(own, lambda d: F.when(F.size(d) > 0, d).otherwise(whole)))

    return let(marked(text, HEADER_LINE, "im"), parted)


def split_documents(text: Column) -> Column:
    return let(split_by_pages(text), lambda d: F.when(F.size(d) > 0, d).otherwise(split_at_headers(text)))


def documents_of(text: Column) -> Column:
    """A file's waybills as an array of texts; a file without text is one waybill without text."""
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", F.array(F.lit(""))).otherwise(split_documents(text))


def explode_documents(files: DataFrame) -> DataFrame:
    """files(source, text) to one row per waybill: source, doc_idx from 0, n_docs, text, file_text. The outer form, as for an inner one the
    optimiser infers a filter that splits every text once more."""
    split = files.select("source", F.col("text").alias("file_text"), documents_of(F.col("text")).alias("_docs"))
    rows = split.select("source", "file_text", F.size("_docs").alias("n_docs"), F.posexplode_outer("_docs").alias("doc_idx", "text"))
    return rows.select("source", "doc_idx", "n_docs", "text", "file_text")


def document_source(source: Column, n_docs: Column, doc_idx: Column) -> Column:
    """The file's name, with the number of the waybill if there are several."""
    return F.when(n_docs == 1, source).otherwise(F.concat(source, F.lit("#"), (doc_idx + 1).cast("string")))


def _is_noise(row: Column) -> Column:
    return F.forall(F.array(*(is_blank(row[f]) for f in ("number", "date", "vehicle", "driver", "shipper"))), lambda x: x)


def without_noise(rows: Column, source: Column) -> Column:
    """A file's waybills (structs of the fields, row_source and doc_idx) but for those without number, date, vehicle, driver and shipper; if all
    go, the first stays, under the file's own name. A single waybill always stays.
    """

    def kept(good: Column) -> Column:
        first = F.transform(F.slice(rows, 1, 1), lambda r: r.withField("row_source", source))
        return F.when(F.size(rows) <= 1, rows).when(F.size(good) > 0, good).otherwise(first)

    return let(F.filter(rows, lambda r: ~_is_noise(r)), kept)


def drop_noise_documents(rows: DataFrame) -> DataFrame:
    """The same for a table of rows with source, doc_idx, n_docs, row_source and the fields, whose files' rows lie anywhere."""
    marked_ = rows.withColumn("_noise", (F.col("n_docs") > 1) & _is_noise(F.struct("number", "date", "vehicle", "driver", "shipper")))
    marked_ = marked_.withColumn("_all", F.min("_noise").over(W.partitionBy("source")))
    kept = marked_.filter(~F.col("_noise") | (F.col("_all") & (F.col("doc_idx") == 0)))
    return kept.withColumn("row_source", F.when(F.col("_all"), F.col("source")).otherwise(F.col("row_source"))).drop("_noise", "_all")
