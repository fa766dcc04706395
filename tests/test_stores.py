"""Stores of rows (snapshots as tables, the cache), progress, and the commands beside parsing."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from cargolex import commands
from cargolex.operators import feedback, rows
from cargolex.plans import forms
from cargolex.progress import Progress
from cargolex.schema import FIELDS
from cargolex.sources import cache, files, sinks, snapshots, versions

SF, NOW = "/root/testdata/sf0.001", datetime(2026, 1, 2, 3, 4, 5)
YEAR = ["--as-of-year", str(forms.AS_OF_YEAR)]


def made(spark, *sources, note=""):
    """Result rows without any parsing."""
    ids = spark.createDataFrame([(s, i) for i, s in enumerate(sources)], "source string, i int")
    zero = F.struct(*(F.lit(0.5).alias(f) for f in FIELDS))
    own = [F.concat(F.lit(f"{f} of "), "source").alias(f) for f in FIELDS]
    return ids.select("source", F.lit(0).alias("doc_idx"), F.lit(1).alias("n_docs"), F.col("source").alias("row_source"), *own, F.lit("ТН").alias("waybill"), zero.alias("confidence"), F.lit(note).alias("note"))


def test_snapshot_table_there_and_back(spark, tmp_path):
    path = str(tmp_path / "s.snapshot")
    out = made(spark, *(f"f{i:03}" for i in reversed(range(500)))).repartition(7)
    assert not snapshots.is_table(spark, path) and snapshots.write(out, path, NOW) == 1
    got = files.read_snapshot(spark, path)
    assert sorted((r.row_no, r.source) for r in got.collect()) == [(i, f"f{i:03}") for i in range(500)]
    # the same rows as the one JSON text holds
    sinks.write_snapshot(out, str(tmp_path / "s.json"), NOW)
    old = files.read_snapshot(spark, str(tmp_path / "s.json"))
    assert got.columns == old.columns and got.exceptAll(old).count() == 0 and old.exceptAll(got).count() == 0
    # a run that died before its head leaves the version before; a later one takes its place
    os.makedirs(os.path.join(path, "rows", "version=2"))
    assert files.read_snapshot(spark, path).count() == 500
    assert snapshots.write(made(spark, "x"), path, NOW) == 2 and [(r.row_no, r.source) for r in files.read_snapshot(spark, path).collect()] == [(0, "x")]
    assert snapshots.read(spark, path, 1).count() == 500
    assert snapshots.write(out.limit(0), path, NOW) == 3 and files.read_snapshot(spark, path).count() == 0
    plan = snapshots.read(spark, path, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_cache_keeps_one_version(spark, tmp_path):
    path = str(tmp_path / "cache")
    marks = lambda *m: spark.createDataFrame(m, "source string, signature string, path string")
    assert cache.read(spark, path) is None and cache.compact(spark, path) is None
    for i in range(3):  # a file that changes thrice beside one that does not
        assert cache.put(made(spark, "a", note=f"v{i}"), marks(("a", f"sa{i}", "/in/a")), path) == i + 1
    assert cache.put(made(spark, "b", "b", note=""), marks(("b", "sb", "/in/b")), path) == 4
    assert cache.put(made(spark, "bad", note="ERROR: x"), marks(("bad", "sx", "/in/bad")), path) == 5
    os.makedirs(os.path.join(path, "batch=9"))  # a run that died while it wrote
    assert cache.read(spark, path).count() == 5
    held = lambda: sorted((r.source, r.signature, r.note) for r in cache.read(spark, path).collect())
    assert cache.compact(spark, path) == 5
    assert held() == [("a", "sa2", "v2"), ("b", "sb", ""), ("b", "sb", "")] and versions.numbers(spark, path, "batch") == []
    assert cache.compact(spark, path) is None
    # a batch beside the base; the file changes again, and the other one is no more
    assert cache.put(made(spark, "a", note="v3"), marks(("a", "sa3", "/in/a")), path) == 6
    assert sinks.cache_get(marks(("a", "sa3", "/in/a")), cache.read(spark, path)).count() == 1
    assert cache.compact(spark, path, marks(("a", "sa3", "/in/a"))) == 6 and held() == [("a", "sa3", "v3")]
    assert versions.numbers(spark, path, "base") == [6]


def test_progress_tells_while_the_job_runs(spark):
    told = []

    def tell(done, total):
        told.append((done, total))
        raise ValueError("a caller's error reaches nobody")

    own = spark.range(40).repartition(8).withColumn("s", F.expr("reflect('java.lang.Thread', 'sleep', 40L)").isNull())
    with Progress(40, tell, every=0.05) as watch:
        assert watch.counted(own.select("id")).filter("id >= 0").count() == 40
    assert told[-1] == (40, 40) and told == sorted(told)
    with Progress(3, None) as watch:
        assert watch.counted(own) is own


def test_commands_of_corrections(spark, tmp_path, capsys):
    out = made(spark, "a", "b", "c")
    run = lambda *args: commands.main(list(map(str, args)), spark)
    log, book = tmp_path / "log", tmp_path / "r.xlsx"
    assert run("collect", book) == 1 and run("stats", "--log", log) == 0
    assert sinks.write_workbook_safe(out, str(book), NOW, as_table=True) == str(book) and os.path.isdir(tmp_path / ".r.xlsx.snapshot")
    assert run("collect", book, "--log", log) == 0 and not log.exists() and "0 corrections" in capsys.readouterr().out
    # an operator edits the workbook
    edited = out.withColumn("driver", F.when(F.col("source") == "b", "Иванов И.И.").otherwise(F.col("driver"))).withColumn("cargo", F.when(F.col("source") != "c", "").otherwise(F.col("cargo")))
    sinks.write_workbook(edited, str(book))
    assert run("collect", book, "--log", log, "--dry-run") == 0 and not log.exists()
    told = capsys.readouterr().out
    assert "3 corrections" in told and "[clear] a / cargo" in told and "[fix] b / driver: 'driver of b' -> 'Иванов И.И.' (0.50)" in told
    assert run("collect", book, "--log", log) == 0 and files.read_corrections(spark, str(log)).count() == 3
    capsys.readouterr()
    assert run("stats", "--log", log, "--top", 2) == 0
    told = capsys.readouterr().out
    assert "3 corrections" in told and "cargo           2 fix 0 fill 0 clear 2 confidence 0.50" in told and told.count("->") == 2


def test_commands_of_accuracy_and_golden(spark, tmp_path, capsys):
    form = forms.rendered(spark, SF).orderBy("o_orderkey").first()
    inputs, expected = tmp_path / "in", tmp_path / "expected"
    inputs.mkdir()
    expected.mkdir()
    run = lambda *args: commands.main([*map(str, args), *YEAR], spark)
    assert run("accuracy", inputs, tmp_path / "no") == 1 and run("golden", inputs / "no.txt") == 2
    for name in ("a", "a_ocred", "alone"):  # of copies, the recognised one is read
        (inputs / f"{name}.txt").write_text(form.text if name == "a_ocred" else "", encoding="utf-8")
    df = files.normalized(spark.createDataFrame([("a", form.text)], "source string, text string"))
    parsed = rows.parse(df, forms.AS_OF_YEAR).first()
    (expected / "a.json").write_text(json.dumps({"documents": [{"type": "TN", "number": parsed.number, "date": "1999-01-01", "parties": []}]}), encoding="utf-8")
    capsys.readouterr()
    assert run("accuracy", inputs, expected, "-v") == 0
    told = capsys.readouterr().out
    assert "ok   a_ocred.txt / number" in told and "fail a_ocred.txt / date" in told and "TOTAL      ok=1 fail=1 skip=7 acc=50%" in told
    case = inputs / "a_ocred.txt"
    assert run("golden", case) == 0
    rules = json.loads((inputs / "a_ocred.expected.json").read_text())["rows"][0]
    assert rules["number"] == {"equals": parsed.number}
    (inputs / "a_ocred.expected.json").write_text(json.dumps({"rows": [{"number": {"contains": ["z"]}}]}))
    assert run("golden", case, "--merge") == 0
    kept = json.loads((inputs / "a_ocred.expected.json").read_text())["rows"][0]
    assert kept["number"] == {"contains": ["z"]} and kept["date"] == rules["date"]


def test_rows_without_a_source_match_by_place(spark, tmp_path):
    """The table keeps the place of a row, as does one JSON text."""
    out = made(spark, "x", "y", "z").withColumn("doc_idx", F.ascii("source") - F.ascii(F.lit("x"))).withColumn("source", F.lit(""))
    out = out.withColumn("row_source", F.lit("")).repartition(3)
    snapshots.write(out, str(tmp_path / "t"), NOW)
    before = files.read_snapshot(spark, str(tmp_path / "t"))
    after = spark.createDataFrame([("", i, *(f"{f} of {'xyz'[i]}" if (f, i) != ("number", 1) else "new" for f in FIELDS)) for i in range(3)], f"source string, row_no int, {', '.join(f'{f} string' for f in FIELDS)}")
    assert [(r.field, r.original, r.corrected, r.excel_row) for r in feedback.differences(before, after).collect()] == [("number", "number of y", "new", 3)]
