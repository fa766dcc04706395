"""Accuracy against expert labels: expectations, comparison of each field, and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.fuzzy import partial_similarity
from ..functions.rx import find_all, replace, strip
from ..schema import FIELDS, MISSING
from .rows import overall, parse

# Letters that a plate or a name is compared without regard to, words that name no cargo, least similarity of names.
PLATE_FROM, PLATE_TO = "АЕО", "AEO"
NAME_FROM, NAME_TO = "ёзоеарсхукмтвн", "е30eapcxykmtbh"
GENERIC = ["груз", "груза", "масса", "вес", "брутто", "нетто", "объем", "объём"]
NAME_SIMILARITY = 75

EXPECTED = "number string, date string, shipper struct<inn:string,name:string>, consignee struct<inn:string,name:string>, driver string, vehicle struct<make:string,plate:string>, cargo string, volume struct<places:string,net:string,vol:string>, reception struct<inn:string,name:string>"


def iso_to_ru(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat_ws(".", F.substring(c, 9, 2), F.substring(c, 6, 2), F.substring(c, 1, 4))).otherwise(c)


def ru_to_iso(c: Column) -> Column:
    """Two-digit years are of this century."""
    own = F.regexp_replace(strip(c), r"^(\d{2}\.\d{2}\.)(\d{2})$", "$120$2")
    return F.when(own.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.concat_ws("-", F.substring(own, 7, 4), F.substring(own, 4, 2), F.substring(own, 1, 2))).otherwise(own)


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def _filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def _organisation(o: Column) -> Column:
    return F.when(o.isNotNull(), F.struct(o["inn"].alias("inn"), o["name"].alias("name")))


def _expected(**own: Column) -> Column:
    schema = StructType.fromDDL(EXPECTED)
    return F.struct(*(own[f].alias(f) for f in schema.names)).cast(schema)


def _of_document(tn: Column) -> Column:
    party = lambda role: _first(tn["parties"], lambda p: p["role"] == role)
    cargo, driver = tn["cargo_header"], party("carrier")["driver"]
    return _expected(
        number=tn["number"],
        date=iso_to_ru(tn["date"]),
        shipper=_organisation(party("shipper")),
        consignee=_organisation(party("consignee")),
        driver=_filled(driver["short_name"], driver["full_name"]),
        vehicle=F.struct(tn["transport"]["vehicle_make"], tn["transport"]["vehicle_reg_plate"]),
        cargo=cargo["description"],
        volume=F.struct(cargo["places_count"], cargo["net_weight_t"], cargo["volume_m3"]),
        reception=_organisation(tn["loading"]["infrastructure_owner"]),
    )


def _of_page(f: Column) -> Column:
    cargo, place = f["cargo"], f["loading_point"]
    return _expected(
        number=_filled(f["ttn_internal_number"], f["order_number"]),
        date=iso_to_ru(ru_to_iso(f["ttn_date"])),
        shipper=F.struct(f["consignor"]["inn"], f["consignor"]["name"]),
        consignee=F.struct(f["consignee"]["inn"], f["consignee"]["name"]),
        driver=_filled(f["carrier_driver"]),
        vehicle=F.struct(f["vehicle"]["brand"], f["vehicle"]["plate"]),
        cargo=cargo["name"],
        volume=F.struct(cargo["places_count"], cargo["net_weight_t"], cargo["volume_m3"]),
        reception=F.when(_filled(place["loader"]).isNotNull(), F.struct(place["loader_inn"], place["loader"])),
    )


def expectations(expected: DataFrame) -> DataFrame:
    """Expert files(source_file, documents, pages) to (source_file, one column a field) of each file's first waybill, which is a document or,
    where none is, a page with fields; files without one are left out."""
    tn = _first(F.col("documents"), lambda d: d["type"] == "TN")
    page = _first(F.col("pages"), lambda p: p["document_type"].isin("TTN", "TN") & (F.to_json(p["structured_fields"]) != "{}"))
    own = expected.select("source_file", tn.alias("tn"), page["structured_fields"].alias("page"))
    both = F.coalesce(F.when(F.col("tn").isNotNull(), _of_document(F.col("tn"))), F.when(F.col("page").isNotNull(), _of_page(F.col("page"))))
    # explode_outer keeps the optimiser from copying the whole expression into each field and into the filter
    return own.select("source_file", F.explode_outer(F.array(both)).alias("e")).filter(F.col("e").isNotNull()).select("source_file", "e.*")


def plate_key(c: Column) -> Column:
    return F.upper(F.translate(c, PLATE_FROM, PLATE_TO))


def name_key(c: Column) -> Column:
    """A name without punctuation, letters of one look made one."""
    # ё becomes е before е becomes e
    own = F.translate(F.translate(F.lower(c), "ё", "е"), NAME_FROM[1:], NAME_TO[1:])
    return F.regexp_replace(own, r"(?U)[\s\-_.,«»\"'()]+", "")


def _name_ok(expected: Column, got: Column) -> Column:
    short = strip(F.get(F.split(expected, ","), F.lit(0)))
    inside = name_key(got).contains(name_key(short))
    # only names that are not found as they are go to the scorer
    return F.coalesce(expected == "", F.lit(True)) | inside | (partial_similarity(F.when(~inside, name_key(short)), name_key(got)) >= NAME_SIMILARITY)


def _party_ok(e: Column, got: Column) -> Column:
    return F.coalesce(F.nullif(e["inn"], F.lit("")).isNull() | got.contains(e["inn"]), F.lit(True)) & _name_ok(e["name"], got)


def _surname(c: Column) -> Column:
    return F.lower(F.get(find_all(c, "[А-ЯЁ][а-яё]{2,}", 0, ""), F.lit(0)))


def _number_in(x: Column, got: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d+?)0+$", "$1"), r"\.", ",")
    return F.coalesce(F.replace(got, F.lit("."), F.lit(",")).contains(plain), F.lit(False))


def verdicts(pairs: DataFrame) -> DataFrame:
    """pairs with structs expected and got to (key columns, field, verdict): ok, fail, or skip where nothing is expected."""
    e, g = F.col("expected"), {f: strip(F.coalesce(F.col("got")[f], F.lit(""))) for f in FIELDS}

    def rule(expected: Column, field: str, ok: Column, given: Column | None = None) -> Column:
        there = expected.isNotNull() if given is None else given
        missing = (g[field] == "") | (g[field] == MISSING)
        return F.when(~F.coalesce(there, F.lit(False)), "skip").when(missing, "fail").when(ok.isNull(), "skip").when(ok, "ok").otherwise("fail")

    words = F.slice(F.filter(find_all(F.lower(e["cargo"]), "[а-яёa-z]{4,}", 0, ""), lambda w: ~w.isin(GENERIC)), 1, 3)
    plate = F.upper(replace(F.coalesce(e["vehicle"]["plate"], F.lit("")), r"\s+", ""))
    volume = F.coalesce(g["volume"].contains(e["volume"]["places"].cast("string")), F.lit(False)) | _number_in(e["volume"]["vol"], g["volume"]) | _number_in(e["volume"]["net"], g["volume"])
    checks = {
        "number": rule(e["number"], "number", plate_key(e["number"]) == plate_key(g["number"]), e["number"] != ""),
        "date": rule(e["date"], "date", e["date"] == g["date"], e["date"] != ""),
        "shipper": rule(e["shipper"], "shipper", _party_ok(e["shipper"], g["shipper"])),
        "consignee": rule(e["consignee"], "consignee", _party_ok(e["consignee"], g["consignee"])),
        "driver": rule(e["driver"], "driver", F.when(_surname(e["driver"]).isNotNull(), F.coalesce(_surname(e["driver"]) == _surname(g["driver"]), F.lit(False))), e["driver"] != ""),
        "vehicle": rule(e["vehicle"], "vehicle", (plate != "") & plate_key(replace(g["vehicle"], r"\s+", "")).contains(plate_key(plate)), e["vehicle"]["make"].isNotNull() | e["vehicle"]["plate"].isNotNull()),
        "cargo": rule(e["cargo"], "cargo", F.when(F.size(words) > 0, F.exists(words, lambda w: F.lower(g["cargo"]).contains(w))), e["cargo"] != ""),
        "volume": rule(e["volume"], "volume", volume, e["volume"]["places"].isNotNull() | e["volume"]["net"].isNotNull() | e["volume"]["vol"].isNotNull()),
        "reception": rule(e["reception"], "reception", _party_ok(e["reception"], g["reception"])),
    }
    keys = [c for c in pairs.columns if c not in ("expected", "got")]
    wide = pairs.select(*keys, *(checks[f].alias(f) for f in FIELDS))
    return wide.unpivot(keys, FIELDS, "field", "verdict")


def accuracy(judged: DataFrame) -> DataFrame:
    """Per field and over all (field NULL): ok, fail, skip, and the truncated percentage, NULL where nothing was judged."""
    own = judged.rollup("field").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "fail", "skip")))
    return own.withColumn("pct", F.when(F.col("ok") + F.col("fail") > 0, F.floor(100 * F.col("ok") / (F.col("ok") + F.col("fail")))))


# Endings of the names of copies, recognised ones and outputs.
RECOGNISED, OUTPUT = "[ _-]ocred$", "[_-]выход$"


def _named(path: Column) -> tuple[Column, Column]:
    """A file's name without its suffix, and its base name, which copies share."""
    name = F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)
    return name, F.regexp_replace(name, f"(?:{RECOGNISED}|{OUTPUT})", "")


def pick_inputs(files: DataFrame) -> DataFrame:
    """files(path) to one per base name: a recognised copy, else an output copy, else the plain one; ties by path."""
    name, base = _named(F.col("path"))
    rank = F.when(name.rlike(RECOGNISED), 0).when(name.rlike(OUTPUT), 1).otherwise(2)
    return files.select("path", base.alias("base"), rank.alias("rank")).groupBy("base").agg(F.min_by("path", F.struct("rank", "path")).alias("path"), F.min("rank").alias("rank"))


def with_experts(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files(path) beside the expert file (source_file, <base name>.json) of the same base name; without one, source_file is NULL."""
    own = expected.select(F.regexp_replace("source_file", r"\.json$", "").alias("_base"), "source_file")
    return files.withColumn("_base", _named(F.col("path"))[1]).join(own, "_base", "left").drop("_base")


def folder_verdicts(files: DataFrame, expected: DataFrame, as_of_year: int) -> DataFrame:
    """(path, field, verdict) of a folder: of the copies of a file(path, source, text) one is taken, its first waybill is held against the expert
    file of its base name. Files without an expert file, and those without text, are left out."""
    told = expectations(expected)
    picked = with_experts(pick_inputs(files).select("path"), told).filter(F.col("source_file").isNotNull())
    texts = files.join(picked, "path").filter(strip(F.coalesce("text", F.lit(""))) != "")
    first = parse(texts.select(F.col("path").alias("source"), "text"), as_of_year).groupBy("source").agg(F.min_by(F.struct(*FIELDS), "doc_idx").alias("got"))
    one = told.select("source_file", F.struct(*FIELDS).alias("expected"))
    pairs = first.join(picked, first["source"] == picked["path"]).join(one, "source_file").select("path", "expected", "got")
    return verdicts(pairs)


def rule_failures(value: Column, rule: Column) -> Column:
    """Of a golden rule struct(equals, contains, not_contains): the names of the checks that a value fails."""
    own = F.coalesce(value, F.lit(MISSING))
    return F.array_compact(
        F.array(
            F.when(rule["equals"].isNotNull() & (own != rule["equals"]), "equals"),
            F.when(~F.forall(F.coalesce(rule["contains"], F.array().cast("array<string>")), lambda n: own.contains(n)), "contains"),
            F.when(F.exists(F.coalesce(rule["not_contains"], F.array().cast("array<string>")), lambda n: own.contains(n)), "not_contains"),
        )
    )


#: Fields that golden cases have rules of, and the form of a rule that is more than a value.
GOLDEN = ["number", "date", "shipper", "consignee", "cargo", "driver", "vehicle", "reception"]
RULE = "equals string, contains array<string>, not_contains array<string>"
#: By how much a frozen case may fall below its confidence.
MARGIN = 0.05


def golden_rules(cases: DataFrame) -> DataFrame:
    """(case, text) of golden files, {"rows": [...]}, to (case, doc_idx, rules) of each row; rules map a field to its value or to the JSON of its rule."""
    own = cases.select("case", F.from_json("text", "rows array<map<string,string>>")["rows"].alias("rows"))
    return own.select("case", F.posexplode("rows").alias("doc_idx", "rules"))


def golden_failures(results: DataFrame, rules: DataFrame) -> DataFrame:
    """(case, doc_idx, what, failed) of all that golden_rules and result rows disagree on: what is a field, with its check, or `row`, with conf_min,
    note_not_contains, missing or extra. The source of a result is its case with any suffix; results of no case are not looked at."""
    got = results.select(F.regexp_replace("source", r"\.[^.]*$", "").alias("case"), "doc_idx", *GOLDEN, F.coalesce("note", F.lit("")).alias("note"), overall(F.col("confidence")).alias("_overall"), F.lit(True).alias("_there"))
    both = rules.join(got, ["case", "doc_idx"], "left")

    def failed(field: str) -> Column:
        told = F.col("rules")[field]
        plain = F.struct(told.alias("equals"), *(F.lit(None).cast("array<string>").alias(k) for k in ("contains", "not_contains")))
        bad = rule_failures(F.col(field), F.when(told.startswith("{"), F.from_json(told, RULE)).otherwise(plain))
        return F.when(told.isNotNull(), F.transform(bad, lambda x: F.struct(F.lit(field).alias("what"), x.alias("failed"))))

    one = lambda what, bad: F.array(F.when(bad, F.struct(F.lit("row").alias("what"), F.lit(what).alias("failed"))))
    unwanted = F.coalesce(F.from_json(F.col("rules")["note_not_contains"], "array<string>"), F.array().cast("array<string>"))
    of_row = F.concat(
        *(F.coalesce(failed(f), F.array().cast("array<struct<what:string,failed:string>>")) for f in GOLDEN),
        one("conf_min", F.col("_overall") < F.col("rules")["conf_min"].cast("double")),
        one("note_not_contains", F.exists(unwanted, lambda n: F.col("note").contains(n))),
    )
    all_ = F.when(F.col("_there"), F.array_compact(of_row)).otherwise(one("missing", F.lit(True)))
    more = got.join(rules.select("case", "doc_idx"), ["case", "doc_idx"], "left_anti").join(rules.select("case"), "case", "left_semi")
    return both.select("case", "doc_idx", F.inline(all_)).unionByName(more.select("case", "doc_idx", F.lit("row").alias("what"), F.lit("extra").alias("failed")))


def fresh_rules(results: DataFrame) -> DataFrame:
    """Result rows as golden_rules gives them: values as they are, a confidence that is little less, and no error in the note if it has none."""
    told = {f: F.to_json(F.struct(F.coalesce(F.col(f), F.lit(MISSING)).alias("equals"))) for f in GOLDEN}
    told["conf_min"] = F.round(overall(F.col("confidence")) - MARGIN, 2).cast("string")
    told["note_not_contains"] = F.when(F.coalesce("note", F.lit("")).contains("ERROR"), "[]").otherwise('["ERROR"]')
    return results.select(F.regexp_replace("source", r"\.[^.]*$", "").alias("case"), "doc_idx", F.create_map(*(x for k, v in told.items() for x in (F.lit(k), v))).alias("rules"))


def frozen(fresh: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(case, doc_idx, rules) of fresh results; with previous ones, whose rules stay as they are. Rows that only the previous ones have go."""
    if previous is None:
        return fresh
    own = fresh.join(previous.withColumnRenamed("rules", "_old"), ["case", "doc_idx"], "left")
    old = F.coalesce("_old", F.create_map().cast("map<string,string>"))
    new = F.map_filter("rules", lambda k, v: ~F.array_contains(F.map_keys(old), k))
    return own.select("case", "doc_idx", F.map_concat(new, old).alias("rules"))


def _json(text: Column) -> Column:
    own = F.to_json(F.array(text))
    return own.substr(F.lit(2), F.length(own) - 2)


def golden_json(rules: DataFrame) -> DataFrame:
    """(case, text): rules as golden files have them, a text for each case."""

    def told(e: Column) -> Column:
        # what is a rule, a list or a number in JSON stays so; all else is text
        value = F.when(e["key"].isin("conf_min", "note_not_contains") | e["value"].startswith("{"), e["value"]).otherwise(_json(e["value"]))
        return F.concat(_json(e["key"]), F.lit(":"), value)

    row = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("rules"), told), ","), F.lit("}"))
    own = rules.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("doc_idx", row.alias("t")))).alias("r"))
    return own.select("case", F.concat(F.lit('{"rows":['), F.array_join(F.transform("r", lambda x: x["t"]), ","), F.lit("]}")).alias("text"))
