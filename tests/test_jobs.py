"""Whole jobs: queries against their SQL, splitting, sinks and sources there and back, the command line, the stream."""

import json
import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from cargolex import cli
from cargolex.operators import documents, feedback, organisations, rows, scoring
from cargolex.operators.reports import file_status
from cargolex.plans import catalog, forms
from cargolex.schema import FIELDS
from cargolex.sources import cache as cached_rows
from cargolex.sources import files, sinks
from cargolex.streaming import directory

SF, NOW = "/root/testdata/sf0.001", datetime(2026, 1, 2, 3, 4, 5)
CHECKED = ["normalize_text", "column_edges", "two_column_detect", "org_directory_refresh", "garbage_token_flags", "split_pages", "noise_doc_filter", "first_marker_per_role", "extract_number", "log_lines", "batch_file_status", "feedback_diff", "accuracy_by_field", "header_fuzzy", "input_priority_pick", "expert_expectations", "file_expert_match", "golden_rule_check", "golden_case_check", "fields_without_sections", "taxid_checksum_12", "split_registries", "line_grouping", "waybill_pipeline"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_as_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "customer", "documents"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    own = sorted(df.columns)
    want = db.sql(f"select {', '.join(own)} from ({catalog.SQL[name]})").fetchall()
    key = lambda r: tuple("" if x is None else f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r)
    assert sorted(map(key, df.select(own).collect())) == sorted(map(key, want))


def form_texts(spark, n):
    return [(f"{r.o_orderkey}.txt", r.text) for r in forms.rendered(spark, SF).orderBy("o_orderkey").limit(n).collect()]


def test_several_waybills_in_a_file(spark):
    (_, a), (_, b) = form_texts(spark, 2)
    texts = [("two", f"{a}\n{b}"), ("one", a), ("empty", ""), ("null", None), ("none", "Транспортная накладная\n" + "x " * 60 + "\nТранспортная накладная\n" + "y " * 60)]
    df = files.normalized(spark.createDataFrame(texts, "source string, text string"))
    got = rows.parse(df, forms.AS_OF_YEAR).select("row_source", "number", "note", "waybill").collect()
    by = {r.row_source: r for r in got}
    assert set(by) == {"two#1", "two#2", "one", "empty", "null", "none"}
    assert by["one"].number == by["two#1"].number and by["empty"].note == "LOW_TEXT;LOW_CONF" and by["empty"].waybill == rows.TITLE


def test_errors_become_rows(spark):
    df = spark.createDataFrame([("a.pdf", "", "нет страниц")], "source string, text string, error string")
    out = rows.parse_or_error(df, forms.AS_OF_YEAR)
    assert out.first().note == "ERROR: нет страниц" and file_status(out).first().status == "ERR"
    assert sinks.cacheable(out).count() == 0


def test_decoder_errors_and_layout(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def decoder(content):
        if content == b"bad":
            raise ValueError("сломан")
        return [{"page_no": i, "width": 100.0, "plain": "текст " * 30, "blocks": [], "spans": []} for i in (1, 2)]

    out = files.decoded(files.list_documents(spark, str(tmp_path)), decoder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    got = {r.source.rsplit("/", 1)[1]: r for r in out.collect()}
    assert set(got) == {"a.PDF", "b.pdf"} and got["b.pdf"].error == "сломан" and got["a.PDF"].text.count("\f") == 1


def test_enrichment_fills_blanks_of_weak_rows(spark):
    df = spark.createDataFrame([("x", "пусто", None)], "source string, text string, error string")
    weak = rows.parse_or_error(df, forms.AS_OF_YEAR)
    told = spark.createDataFrame([("x", "Иванов И.И.", "отсутствует")], "row_source string, driver string, number string").select("row_source", *(F.col(f) if f in ("driver", "number") else F.lit(None).cast("string").alias(f) for f in FIELDS))
    out = rows.enrich(weak, told).first()
    assert out.driver == "Иванов И.И." and out.number is None and out.confidence.driver == 0.6 and out.note == "LOW_TEXT;LOW_CONF;LLM_FALLBACK"
    assert rows.enrich(weak, None) is weak
    back = rows.from_json(rows.to_json(weak)).first()
    assert back.source == "x" and back.confidence.driver == 0.0


def test_plugin_errors_never_fail_the_job(spark):
    df = spark.createDataFrame([("x", "пусто", None)], "source string, text string, error string")
    weak = rows.parse_or_error(df, forms.AS_OF_YEAR)

    def broken(batches):
        raise ValueError("no network")

    assert [r.note for r in rows.enrich_with(weak, broken).collect()] == ["LOW_TEXT;LOW_CONF"]


def test_expert_files_and_parties(spark, tmp_path):
    owner = lambda inn: {"infrastructure_owner": {"name": "Порт", "inn": inn}}
    whole = {"documents": [{"type": "TN", "number": 7, "parties": [{"role": "shipper", "inn": "7736207543", "name": "А"}], "cargo_header": {"net_weight_t": 12.50, "places_count": 3}, "loading": owner("500100732259"), "unloading": owner("7707083893")}]}
    for name, text in {"a": json.dumps(whole), "b": "[1, 2", "c": "{}", "d": '{"documents": 5, "pages": "x"}', "e": " "}.items():
        (tmp_path / f"{name}.json").write_text(text)
    expected = files.read_expected(spark, str(tmp_path))
    assert expected.count() == 5
    got = scoring.expectations(expected).collect()
    assert [(r.source_file, r.number, r.date, r.shipper.inn, r.volume.net, r.volume.places, r.reception.name) for r in got] == [("a.json", "7", None, "7736207543", "12.5", "3", "Порт")]
    assert [r.inn for r in organisations.parties_of(expected).orderBy("seq").collect()] == ["7736207543", "500100732259", "7707083893"]


def test_golden_files_frozen_and_read_again(spark, tmp_path):
    out = rows.parse(files.normalized(spark.createDataFrame(form_texts(spark, 2), "source string, text string")), forms.AS_OF_YEAR).cache()
    fresh = scoring.frozen(scoring.fresh_rules(out))
    for r in scoring.golden_json(fresh).collect():
        assert json.loads(r.text)["rows"][0]["note_not_contains"] == ["ERROR"]
        (tmp_path / f"{r.case}.expected.json").write_text(r.text, encoding="utf-8")
        (tmp_path / f"{r.case}.txt").write_text("x", encoding="utf-8")
    (tmp_path / "alone.expected.json").write_text('{"rows": []}')
    texts, cases = files.read_golden(spark, str(tmp_path))
    assert texts.count() == 2 and cases.count() == 2
    rules = scoring.golden_rules(cases)
    assert scoring.golden_failures(out, rules).count() == 0
    told = rules.withColumn("rules", F.create_map(F.lit("number"), F.lit("иной")))
    kept = scoring.frozen(scoring.fresh_rules(out), told)
    assert {(r.what, r.failed) for r in scoring.golden_failures(out, kept).collect()} == {("number", "equals")}
    assert all(set(r.rules) == {*scoring.GOLDEN, "conf_min", "note_not_contains"} for r in kept.collect())


def test_sinks_there_and_back(spark, tmp_path):
    out = catalog._rows(spark, SF).filter("doc_idx < 30").cache()
    path = sinks.write_workbook_safe(out, str(tmp_path / "r.xlsx"), NOW)
    sheet = files.read_workbooks(spark, str(tmp_path)).orderBy("row_no").collect()
    want = rows.written(out).collect()
    assert [(r.waybill, r.shipper, r.source, int(r.pct)) for r in sheet] == [(r.waybill, r.shipper, r.source, r.pct) for r in want]
    snap = files.read_snapshot(spark, path + ".snapshot.json")
    assert snap.count() == out.count() and json.load(open(path + ".snapshot.json"))["schema_version"] == 1
    edited = files.read_workbooks(spark, str(tmp_path)).withColumn("driver", F.when(F.col("row_no") == 3, "Новый Н.Н.").otherwise(F.col("driver")))
    fixes = feedback.differences(snap, edited)
    assert [(r.field, r.corrected) for r in fixes.collect()] == [("driver", "Новый Н.Н.")]
    log = str(tmp_path / "c")
    sinks.append_corrections(fixes.select("source", "field", "original", "corrected", "original_confidence", "kind", F.lit("t").alias("timestamp"), "excel_row", F.lit(None).cast("string").alias("context")), log)
    with open(os.path.join(log, "more.json"), "w") as f:
        f.write('\nбред\n{"source": "x", "field": "date"}\n')
    assert files.read_corrections(spark, log).count() == 1
    text = list(sinks.log_text(out, "in", "out", 1.0, NOW))
    assert text[0] == "=" * 70 and any("ERROR" in x for x in text)


def test_snapshot_and_log_are_streamed(spark, tmp_path):
    out = rows.parse_or_error(spark.createDataFrame([(f"f{i}", None, "bad") for i in (2, 0, 1, 1)], "source string, text string, error string"), forms.AS_OF_YEAR)
    pieces = list(sinks.snapshot_json(out, NOW))
    assert len(pieces) == 6 and [r["source"] for r in json.loads("".join(pieces))["rows"]] == ["f0", "f1", "f1", "f2"]
    assert json.loads("".join(sinks.snapshot_json(out.limit(0), NOW)))["rows"] == []
    sinks.write_snapshot(out, str(tmp_path / "s.json"), NOW)
    assert os.listdir(tmp_path) == ["s.json"] and files.read_snapshot(spark, str(tmp_path / "s.json")).count() == 4
    log, there = str(tmp_path / "x.log"), []
    assert sinks.write_log_safe((there.append(os.path.exists(log)) or str(i) for i in range(3)), log, NOW) == log
    assert there == 3 * [True] and open(log).read() == "0\n1\n2\n"


def test_sidecars_and_directory(spark):
    docs = spark.createDataFrame([("a.pdf", "из pdf"), ("b.pdf", "из pdf")], "source string, text string")
    side = spark.createDataFrame([("a.txt", "рядом")], "source string, text string")
    assert {r.source: r.text for r in files.with_sidecars(docs, side).collect()} == {"a.pdf": "рядом", "b.pdf": "из pdf"}
    cached = spark.createDataFrame([("7736207543", "Старое")], "inn string, name string")
    found = spark.createDataFrame([("7736207543", "Новое"), ("500100732259", "ИП")], "inn string, name string")
    assert {r.inn: r.name for r in organisations.merged(cached, found).collect()} == {"7736207543": "Старое", "500100732259": "ИП"}
    assert [r.inn for r in organisations.remembered(cached, found).collect()] == ["500100732259"]


def test_cli(spark, tmp_path, capsys):
    assert cli.main([str(tmp_path / "no")], spark) == 2 and cli.main([str(tmp_path)], spark) == 1
    texts = form_texts(spark, 3)
    for name, text in texts[:2]:
        (tmp_path / name).write_text(text, encoding="utf-8")
    year = ["--as-of-year", str(forms.AS_OF_YEAR)]
    assert cli.main([str(tmp_path), *year], spark) == 0
    (tmp_path / texts[2][0]).write_text(texts[2][1], encoding="utf-8")
    # rows that the cache holds are taken from it, so that they can be told from rows that are read
    cache = str(tmp_path / ".cargolex_cache")
    held = cached_rows.read(spark, cache)
    marked = [r.asDict(True) | {"note": "CACHED"} for r in held.collect()]
    spark.createDataFrame(marked, held.schema).write.mode("overwrite").parquet(f"{cache}/batch=1")
    capsys.readouterr()
    told = []
    assert cli.main([str(tmp_path), "-v", *year], spark, lambda done, total: told.append((done, total)) or 1 / 0) == 0
    assert told[-1] == (1, 1)
    assert (tmp_path / "extraction.xlsx").exists() and "Файлов:     3" in (tmp_path / "extraction.log").read_text()
    assert capsys.readouterr().out.count("[OK  ]") == 3
    notes = {r.source: r.note for r in files.read_workbooks(spark, str(tmp_path)).collect()}
    assert notes == {texts[0][0]: "CACHED", texts[1][0]: "CACHED", texts[2][0]: ""}
    assert cached_rows.read(spark, cache).count() == 3


def test_cli_with_decoder(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"good")
    (tmp_path / "in" / "b.PDF").write_bytes(b"bad")
    (tmp_path / "ownpages.py").write_text(
        "def pages(content):\n    if content == b'bad':\n        raise ValueError('broken')\n    return [{'page_no': 1, 'width': 100.0, 'plain': 'Транспортная накладная ' * 20, 'blocks': [], 'spans': []}]\n", encoding="utf-8"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "ownpages.py"))
    out = tmp_path / "out.xlsx"
    assert cli.main([str(tmp_path / "in"), "--decoder", "ownpages:pages", "--out", str(out), "--no-cache"], spark) == 3
    assert out.exists() and "broken" in (tmp_path / "out.log").read_text() and not (tmp_path / ".cargolex_cache").exists()


def test_stream_reads_each_file_once(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    os.mkdir(inbox)
    texts = form_texts(spark, 3)
    for part in (texts[:2], texts[2:], []):
        for name, text in part:
            with open(os.path.join(inbox, name), "w", encoding="utf-8") as f:
                f.write(text)
        directory.parse_to(directory.watch(spark, inbox), out, mark, forms.AS_OF_YEAR).awaitTermination()
    assert sorted(r.source for r in spark.read.parquet(out).collect()) == sorted(n for n, _ in texts)


def _by_first_byte(content):
    if content[:1] == b"!":
        raise ValueError("нет страниц")
    return [{"page_no": 1, "width": 480.0, "plain": content.decode(), "blocks": [], "spans": []}]


def test_stream_of_documents(spark, tmp_path):
    """PDFs in two batches, one of them tried again after its commit was lost: each file once, files that cannot be read among them."""
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    os.mkdir(inbox)
    texts = form_texts(spark, 2)

    def put(name, content):
        with open(os.path.join(inbox, name), "wb") as f:
            f.write(content)

    def run():
        directory.parse_to(directory.watch_documents(spark, inbox, _by_first_byte), out, mark, forms.AS_OF_YEAR).awaitTermination()
        return sorted((r.source, (r.note or "")[:5], r.number is not None) for r in spark.read.parquet(out).collect())

    put("a.pdf", texts[0][1].encode())
    put("bad.PDF", b"!")
    put("note.txt", b"no document")
    first = [("a.pdf", "", True), ("bad.PDF", "ERROR", False)]
    assert run() == first
    put("b.pdf", texts[1][1].encode())
    assert run() == sorted([*first, ("b.pdf", "", True)])
    last = max((x for x in os.listdir(os.path.join(mark, "commits")) if x.isdigit()), key=int)
    for x in (last, f".{last}.crc"):
        os.remove(os.path.join(mark, "commits", x))
    assert run() == sorted([*first, ("b.pdf", "", True)])


def test_directory_versions(spark, tmp_path):
    path = str(tmp_path / "dir")
    make = lambda name, *seqs: spark.createDataFrame([("7707083893", f"{name}{i}", i) for i in seqs] + [("123", "wrong", 0)], "inn string, name string, seq int")
    assert organisations.read_directory(spark, path) is None
    assert organisations.update_directory(make("a", 2, 1), path) == 1
    assert organisations.update_directory(make("b", 5), path) == 2
    read = lambda: [(r.inn, r.name) for r in organisations.read_directory(spark, path).collect()]
    assert read() == [("7707083893", "a1")]
    os.makedirs(os.path.join(path, "version=9"))  # a run that died while it wrote
    assert organisations.update_directory(make("c", 7), path, refresh=True) == 3 and read() == [("7707083893", "c7")]


def test_differences_of_a_frequent_source(spark, monkeypatch):
    monkeypatch.setattr(feedback, "SPLIT", 3)
    fields = [x for f in FIELDS for x in (f"'old' as {f}", f"0.5D as {f}_conf")]
    before = spark.range(6).selectExpr("if(id < 4, 'hot', concat('s', id)) as source", "cast(id as int) as row_no", *fields).withColumn("date", F.concat(F.lit("d"), F.col("row_no").cast("string")))
    after = before.select("source", "row_no", *FIELDS).union(before.select("source", (F.col("row_no") + 10).alias("row_no"), *FIELDS))
    out = feedback.differences(before, after)
    got = sorted((r.source, r.field, r.original, r.corrected, r.excel_row) for r in out.collect())
    assert got == sorted(("hot", "date", "d0", f"d{i % 10}", i + 2) for i in (1, 2, 3, 11, 12, 13))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_parsing_is_planned_soon_and_shuffles_nothing(spark):
    """The optimiser must neither repeat the fields' expressions nor derive constraints from them, filters on the result included."""
    import time

    out = rows.parse(spark.createDataFrame([("a", "b")], "source string, text string"), 2026).filter("number is not null and note = ''")
    began = time.time()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 15 and "Exchange" not in plan
    assert "Python" not in plan


def test_noise_in_the_row_as_over_rows(spark):
    """Files of one to three waybills, every pattern of noise among them, by the array of a file and by the table of all rows."""
    cases = [(n, bits) for n in (1, 2, 3) for bits in range(1 << n)]
    own = [(f"{n}-{b}", i, n, f"{n}-{b}#{i + 1}" if n > 1 else f"{n}-{b}", *([None] * 4), None if b >> i & 1 else "x") for n, b in cases for i in range(n)]
    df = spark.createDataFrame(own, "source string, doc_idx int, n_docs int, row_source string, number string, date string, vehicle string, driver string, shipper string")
    want = sorted(tuple(r) for r in documents.drop_noise_documents(df).collect())
    as_array = df.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(*df.columns[1:]))).alias("a"))
    got = as_array.select("source", F.inline(documents.without_noise(F.col("a"), F.col("source"))))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
