"""Rows of the result: overall confidence, title, notes, the fallback to the whole file, and optional enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rx import let, strip
from ..schema import FIELDS, ROW, is_blank, shown
from . import fields
from .documents import document_source, documents_of, without_noise
from .sections import bounds_of, pieces_of, sections_of, unknown_titles, with_fuzzy_roles

# Titles, notes and thresholds of the result.
TITLE = "Транспортная накладная"
LOW_TEXT, LOW_CONF, ENRICHED, ERROR = "LOW_TEXT", "LOW_CONF", "LLM_FALLBACK", "ERROR: "
LEAST_TEXT, LEAST_CONFIDENCE, FILE_CONFIDENCE, ENRICHED_CONFIDENCE = 200, 0.4, 0.3, 0.6


def overall(confidence: Column) -> Column:
    """Mean of the nine confidences, to two places."""
    return F.round(sum((confidence[f] for f in FIELDS[1:]), confidence[FIELDS[0]]) / len(FIELDS), 2)


def title(number: Column) -> Column:
    return F.when(is_blank(number), TITLE).otherwise(F.concat(F.lit(f"{TITLE} № "), number))


def notes(text: Column, confidence: Column) -> Column:
    return F.concat_ws(";", F.when(F.length(F.coalesce(text, F.lit(""))) < LEAST_TEXT, LOW_TEXT), F.when(overall(confidence) < LEAST_CONFIDENCE, LOW_CONF))


#: Fields that a waybill can take from its whole file.
FROM_FILE = {"cargo": fields.cargo, "volume": fields.volume}


def _or_from_file(own: Column, n_docs: Column, of_file: Column) -> Column:
    return F.when((n_docs > 1) & own["value"].isNull(), of_file).otherwise(own)


def _of_file(make: Callable, text: Column) -> Column:
    return fields.or_missing(fields.found(make(F.lit(None).cast("string"), text)["value"], FILE_CONFIDENCE))


def from_whole_file(docs: DataFrame) -> DataFrame:
    """Of files with several waybills, cargo and volume that a waybill lacks are taken from the file's whole text, with a low confidence."""
    return docs.withColumns({f: _or_from_file(F.col(f), F.col("n_docs"), _of_file(make, F.col("file_text"))) for f, make in FROM_FILE.items()})


def assembled(source: Column, doc_idx: Column, n_docs: Column, text: Column, got: dict[str, Column]) -> Column:
    """A result row as a struct, of a waybill's fields (value, conf) and its text; values are NULL where missing."""

    def row(own: Column) -> Column:
        confidence = F.struct(*(own[f]["conf"].alias(f) for f in FIELDS))
        return F.struct(
            doc_idx.cast("int").alias("doc_idx"),
            n_docs.alias("n_docs"),
            document_source(source, n_docs, doc_idx).alias("row_source"),
            *(own[f]["value"].alias(f) for f in FIELDS),
            title(own["number"]["value"]).alias("waybill"),
            confidence.alias("confidence"),
            notes(text, confidence).alias("note"),
        )

    return let(F.struct(*(got[f].alias(f) for f in FIELDS)), row)


def parse(files: DataFrame, as_of_year: int) -> DataFrame:
    """Normalised files(source, text) to result rows, without any shuffle.

    A file's waybills are an array of its row until they are rows of the result: noise among them is decided there, and the plan
    above sees plain columns. explode_outer, as a filter that the optimiser infers for an inner one would repeat the whole parsing.
    """
    own = files.select("source", F.col("text").alias("_file"), documents_of(F.col("text")).alias("_texts"))
    own = own.withColumn("_docs", F.transform("_texts", lambda t: F.struct(t.alias("text"), pieces_of(t).alias("pieces")))).drop("_texts")
    own = with_fuzzy_roles(own, F.array_distinct(F.flatten(F.transform("_docs", lambda d: unknown_titles(d["pieces"])))))
    own = own.withColumn("_docs", F.transform("_docs", lambda d: F.struct(d["text"].alias("text"), sections_of(d["pieces"], bounds_of(d["pieces"], F.col("_fuzzy"))).alias("sections"))))
    each = lambda f: F.transform("_docs", lambda d: fields.extracted(d["text"], d["sections"], as_of_year, [f])[f])
    own = own.withColumns({f"_{f}": each(f) for f in FIELDS})
    # the whole file is read once, however many of its waybills need it, and only if one does
    lacks = lambda f: (F.size("_docs") > 1) & F.exists(f"_{f}", lambda x: x["value"].isNull())
    own = own.withColumns({f"_file_{f}": F.when(lacks(f), _of_file(make, F.col("_file"))) for f, make in FROM_FILE.items()})

    def row(d: Column, i: Column) -> Column:
        got = {f: F.get(f"_{f}", i) for f in FIELDS}
        got |= {f: _or_from_file(got[f], F.size("_docs"), F.col(f"_file_{f}")) for f in FROM_FILE}
        return assembled(F.col("source"), i, F.size("_docs"), d["text"], got)

    own = own.withColumn("_rows", F.transform("_docs", row))
    return own.select("source", F.explode_outer(without_noise(F.col("_rows"), F.col("source"))).alias("r")).select("source", "r.*")


def placeholder(source: Column, error: Column) -> list[Column]:
    """Columns of the row that stands for a file that could not be read."""
    none = F.lit(None).cast("string")
    zero = F.struct(*(F.lit(0.0).alias(f) for f in FIELDS))
    return [source.alias("source"), F.lit(0).alias("doc_idx"), F.lit(1).alias("n_docs"), source.alias("row_source"), *(none.alias(f) for f in FIELDS), F.lit(TITLE).alias("waybill"), zero.alias("confidence"), F.concat(F.lit(ERROR), error).alias("note")]


#: Parts a file's name from its error while its row is parsed like any other.
_ERROR_MARK = "\ue004"


def parse_or_error(files: DataFrame, as_of_year: int) -> DataFrame:
    """files(source, text, error): those with an error become placeholder rows, the rest is parsed. All in one pass, so that what gives the texts
    (a decoder, a stream) is read once."""
    good = F.col("error").isNull()
    marked = F.concat(F.coalesce("source", F.lit("")), F.lit(_ERROR_MARK), "error")
    own = files.select(F.when(good, F.col("source")).otherwise(marked).alias("source"), F.when(good, F.col("text")).otherwise("").alias("text"))
    out = parse(own, as_of_year).withColumn("_parts", F.split("source", _ERROR_MARK, 2))
    source, error = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    names = [c for c in out.columns if c != "_parts"]
    return out.select(*(F.when(error.isNotNull(), bad).otherwise(source if c == "source" else F.col(c)).alias(c) for c, bad in zip(names, placeholder(source, error), strict=True)))


def enrich(rows: DataFrame, suggestions: DataFrame | None) -> DataFrame:
    """Fills blank fields of weak rows from suggestions(row_source and the fields); without any, rows stay as they are."""
    if suggestions is None:
        return rows
    own = suggestions.select(F.col("row_source"), *(F.col(f).alias(f"_{f}") for f in FIELDS), F.lit(True).alias("_has"))
    out = rows.join(own, "row_source", "left")
    weak = F.coalesce(F.col("_has") & (overall(F.col("confidence")) < LEAST_CONFIDENCE), F.lit(False))
    fills = {f: weak & is_blank(F.col(f)) & ~is_blank(F.col(f"_{f}")) for f in FIELDS}
    any_ = fills[FIELDS[0]]
    for f in FIELDS[1:]:
        any_ = any_ | fills[f]
    confidence = F.struct(*(F.when(fills[f], ENRICHED_CONFIDENCE).otherwise(F.col("confidence")[f]).alias(f) for f in FIELDS))
    note = F.when(any_ & ~F.col("note").contains(ENRICHED), F.concat_ws(";", F.nullif("note", F.lit("")), F.lit(ENRICHED))).otherwise(F.col("note"))
    values = {f: F.when(fills[f], F.col(f"_{f}")).otherwise(F.col(f)) for f in FIELDS}
    return out.select(*(values[c].alias(c) if c in values else confidence.alias(c) if c == "confidence" else note.alias(c) if c == "note" else F.col(c) for c in rows.columns))


def enrich_with(rows: DataFrame, plugin: Callable | None) -> DataFrame:
    """plugin: an iterator of Arrow batches (row_source and fields) to suggestions, called for each batch of weak rows; None leaves rows as
    they are. A batch for which it raises has no suggestions, so that its errors never fail the job."""
    if plugin is None:
        return rows

    def run(batches):
        for batch in batches:
            try:
                told = list(plugin(iter([batch])))
            except Exception:  # noqa: BLE001
                continue
            yield from told

    weak = rows.filter(overall(F.col("confidence")) < LEAST_CONFIDENCE).select("row_source", *FIELDS)
    return enrich(rows, weak.mapInArrow(run, weak.schema))


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select("row_source", F.to_json(F.struct("waybill", *FIELDS, F.col("row_source").alias("source"), "note", "confidence")).alias("json"))


def from_json(lines: DataFrame, column: str = "json") -> DataFrame:
    return lines.select(F.from_json(column, ROW).alias("r")).select("r.*")


def written(rows: DataFrame) -> DataFrame:
    """Rows as sinks write them, in the order of the file and its waybills: the 12 texts and the confidence as an integer percentage."""
    pct = F.bround(overall(F.col("confidence")) * 100).cast("int")
    out = rows.select("source", "doc_idx", "waybill", *(shown(F.col(f)).alias(f) for f in FIELDS), F.col("row_source"), F.coalesce("note", F.lit("")).alias("note"), pct.alias("pct"))
    return out.orderBy("source", "doc_idx").select("waybill", *FIELDS, F.col("row_source").alias("source"), "note", "pct")


def is_empty_text(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""
