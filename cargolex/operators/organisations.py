"""Directory of organisations by tax id, harvested from expert documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validate import first_tax_id, is_valid_tax_id
from ..sources import versions

COLUMNS = ["inn", "name", "legal_form", "kpp", "ogrn", "address", "phone"]


def harvest(parties: DataFrame) -> DataFrame:
    """parties(inn and the other columns, seq) to one row per valid tax id, the first one seen."""
    own = parties.filter(is_valid_tax_id(F.col("inn")))
    return own.groupBy("inn").agg(*(F.min_by(c, "seq").alias(c) if c != "seq" else F.min("seq").alias("seq") for c in [*(x for x in COLUMNS if x != "inn" and x in parties.columns), "seq"]))


def parties_of(expected: DataFrame) -> DataFrame:
    """Expert documents(source_file, documents) to their parties and owners of loading and unloading places, numbered in their order."""
    doc = expected.select("source_file", F.posexplode("documents").alias("doc_no", "d"))
    fields = [c for c in COLUMNS if c != "ogrn"]
    as_struct = lambda p: F.struct(*(p[c].alias(c) for c in fields))
    own = F.concat(F.coalesce(F.transform("d.parties", as_struct), F.array()), F.array(*(as_struct(F.col(f"d.{at}.infrastructure_owner")) for at in ("loading", "unloading"))))
    rows = doc.select("source_file", "doc_no", F.posexplode(own).alias("party_no", "p")).select("source_file", "doc_no", "party_no", "p.*")
    return rows.withColumn("seq", F.concat_ws("|", "source_file", F.lpad(F.col("doc_no").cast("string"), 6, "0"), F.lpad(F.col("party_no").cast("string"), 6, "0")))


def merged(cached: DataFrame, harvested: DataFrame, refresh: bool = False) -> DataFrame:
    """Both directories in one: what is cached goes before what is harvested, with refresh the other way round. Within one directory the entry
    that was seen first counts (column seq, if it is there), then the smallest by its columns; partial sums, no window."""
    both = cached.withColumn("_rank", F.lit(int(refresh))).unionByName(harvested.withColumn("_rank", F.lit(int(not refresh))), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("_rank", "inn")]
    order = F.struct("_rank", *(F.col(c) for c in columns if c == "seq"), F.to_json(F.struct(*columns)))
    best = both.groupBy("inn").agg(F.min_by(F.struct(*columns), order).alias("_best"))
    return best.select(*(F.col("inn") if c == "inn" else F.col("_best")[c].alias(c) for c in both.columns if c != "_rank"))


def read_directory(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of a stored directory; None if there is none. A version that a run left unfinished is not seen."""
    there = versions.numbers(spark, path)
    return spark.read.parquet(f"{path}/version={there[-1]}") if there else None


def update_directory(harvested: DataFrame, path: str, refresh: bool = False) -> int:
    """Merges what was harvested into the stored directory as its next version, which readers see once it is whole; its number. Tax ids that
    are not valid stay out."""
    spark = harvested.sparkSession
    last = read_directory(spark, path)
    new = harvested.filter(is_valid_tax_id(F.col("inn")))
    number = max(versions.numbers(spark, path), default=0) + 1
    merged(last if last is not None else new.limit(0), new, refresh).write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def lookup(rows: DataFrame, directory: DataFrame, text: str) -> DataFrame:
    """Adds the organisation of the first valid tax id in a text column; rows without one keep NULLs."""
    own = rows.withColumn("inn", first_tax_id(F.col(text)))
    return own.join(directory.select("inn", *(F.col(c).alias(f"org_{c}") for c in directory.columns if c in COLUMNS and c != "inn")), "inn", "left")


def remembered(directory: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to append: valid tax ids that the directory does not hold."""
    return new.filter(is_valid_tax_id(F.col("inn"))).dropDuplicates(["inn"]).join(directory, "inn", "left_anti")


def enriched_party(rows: DataFrame, directory: DataFrame, text: str) -> DataFrame:
    """A party's text with the directory's name where the text holds its tax id and begins like the name (four characters)."""
    own = lookup(rows, directory, text)
    alike = F.lower(F.col(text)).contains(F.lower(F.substring("org_name", 1, 4)))
    return own.withColumn(text, F.when(F.col("org_name").isNotNull() & alike, F.concat_ws(", ", F.concat_ws(" ", "org_legal_form", "org_name"), F.concat(F.lit("ИНН "), F.col("inn")))).otherwise(F.col(text)))
