"""The jobs on growing copies of small tables."""

import datetime
import logging
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import health_report, symbol_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CONFIG = symbol_index.load_config()


def put(spark, rows, path):
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(path)


def doc(k, text, source="src1"):
    return (k, text, "en", source, len(text or ""))


def everything(spark, out):
    files = symbol_index.read_output(spark, out, "files").orderBy("file", "digest").collect()
    symbols = symbol_index.read_output(spark, out, "symbols").orderBy("file", "name").collect()
    return files, symbols


def fresh(spark, rows, tmp_path, name):
    """What a first run over the rows writes."""
    put(spark, rows, f"{tmp_path}/{name}-docs")
    symbol_index.run(spark, f"{tmp_path}/{name}-docs", f"{tmp_path}/{name}-out", CONFIG)
    return everything(spark, f"{tmp_path}/{name}-out")


def test_symbol_index_takes_only_what_is_new(spark, tmp_path, caplog):
    rows = [doc(k, f"Alpha{k} the one\nBeta of and the\n lower\nAlpha{k} again", f"src{k % 3}") for k in range(40)]
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    put(spark, rows, docs)
    with caplog.at_level(logging.INFO):
        first = symbol_index.run(spark, docs, out, CONFIG)
    assert first["first"] and first["files"] == 40 and first["symbols"] == 80 and "wrote 40 files and 80 symbols" in caplog.text
    symbols = {(r["file"], r["name"]): (r["line"], r["n"]) for r in everything(spark, out)[1]}
    assert symbols[(7, "Alpha7")] == (1, 2) and symbols[(7, "Beta")] == (2, 1)
    assert symbol_index.run(spark, docs, out, CONFIG) == {"first": False, "stale_slices": 0, "files": 0, "symbols": 0}
    grown = [*rows, doc(100, "Gamma\nDelta", "src9"), doc(101, "Omega", "src0")]
    put(spark, grown, docs)
    second = symbol_index.run(spark, docs, out, CONFIG)
    assert second["stale_slices"] == 2 and 2 <= second["files"] < 42
    assert everything(spark, out) == fresh(spark, grown, tmp_path, "a")
    # one changes, one moves, one goes, and with it its whole slice
    changed = [doc(1, "Changed", "src1"), doc(2, rows[2][1], "src7"), *(r for r in grown if r[0] not in (1, 2, 100))]
    put(spark, changed, docs)
    symbol_index.run(spark, docs, out, CONFIG)
    assert everything(spark, out) == fresh(spark, changed, tmp_path, "b")
    put(spark, [], docs)
    symbol_index.run(spark, docs, out, CONFIG)
    assert everything(spark, out) == ([], [])


def test_symbol_index_after_a_run_that_failed_between_its_tables(spark, tmp_path, monkeypatch):
    rows = [doc(k, f"Name{k}") for k in range(10)]
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    put(spark, rows, docs)
    symbol_index.run(spark, docs, out, CONFIG)
    put(spark, [*rows, doc(50, "Late")], docs)
    monkeypatch.setattr(symbol_index, "metrics", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        symbol_index.run(spark, docs, out, CONFIG)
    monkeypatch.undo()
    assert symbol_index.run(spark, docs, out, CONFIG)["stale_slices"] == 1
    assert everything(spark, out) == fresh(spark, [*rows, doc(50, "Late")], tmp_path, "a")


def test_symbol_index_of_odd_rows(spark, tmp_path):
    rows = [doc(1, None), doc(2, ""), doc(None, "Lost"), doc(3, "Twice", None), doc(3, "Twice", None), doc(4, "A" * 100_000, " "), doc(5, "Éa\nAb\r\nAb")]
    files, symbols = fresh(spark, rows, tmp_path, "a")
    assert [(r["file"], r["project"]) for r in files] == [(1, "src1"), (2, "src1"), (3, "(none)"), (3, "(none)"), (4, "(none)"), (5, "src1")]
    assert [(r["file"], r["name"][:5], r["line"], r["n"]) for r in symbols] == [(3, "Twice", 1, 2), (4, "AAAAA", 1, 1), (5, "Ab", 2, 2)]
    put(spark, rows[:-1] + [doc(3, "Twice", None)], f"{tmp_path}/a-docs")
    assert symbol_index.run(spark, f"{tmp_path}/a-docs", f"{tmp_path}/a-out", CONFIG)["stale_slices"] == 2  # one more of a repeated row counts


def facts(spark, tmp_path, parts, lines):
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.mode("overwrite").parquet(f"{tmp_path}/part")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.mode("overwrite").parquet(f"{tmp_path}/lineitem")


def test_health_report(spark, tmp_path):
    day = datetime.datetime(2001, 5, 1)
    parts = [(1, "alpha", "Brand#11", "x", 5), (2, "zeta", "B", "x", 5), (3, "beta", "B", "x", 48), (4, None, "B", "x", 1), (None, "lost", "B", "x", 1), (5, "gamma", "B", "x", 2)]
    lines = [(1, 1, 1, 1, 50.0, 1.0, day), (1, 2, 1, 2, 50.0, 1.0, day), (2, 3, 1, 1, 1.0, 1.0, day), (2, 3, 2, 2, 1.0, 1.0, day), (3, None, 1, 1, 50.0, 1.0, day)]
    facts(spark, tmp_path, parts, lines)
    config = health_report.load_config() | {"hotspots": 2, "max_lines": 2, "max_members": 9}
    run = lambda label: health_report.run(spark, f"{tmp_path}/part", f"{tmp_path}/lineitem", f"{tmp_path}/out", label, config)
    told = run("mon")
    rows = health_report.read_output(spark, f"{tmp_path}/out")
    got = {(r["dimension"], r["project"], r["site"]): (r["item"], r["weight"], r["n"]) for r in rows.collect()}
    assert told["rows"] == len(got)
    assert got[("unused", "B", 1)] == (5, 2.0, 2) and got[("unused", "B", 2)] == (4, 1.0, 2)  # part 3 is excused by its size
    assert got[("obsolete", "B", 1)] == (3, 2.0, 1) and got[("naming", "B", 1)] == (2, 4.0, 2) and got[("large", "B", 1)] == (3, 2.0, 1)
    assert [got[("uncovered", "B", k)][0] for k in (1, 2)] == [3, 4] and got[("uncovered", "*", 0)] == (None, None, 3)
    assert got[("coupled", "*", 0)] == (None, None, 0)
    before = sorted(map(str, rows.collect()))
    run("mon")
    assert sorted(map(str, health_report.read_output(spark, f"{tmp_path}/out").collect())) == before
    facts(spark, tmp_path, parts[:1], lines[:1])
    run("tue")
    run("mon")  # what is no longer so goes from the label, and the dimension stays
    rows = health_report.read_output(spark, f"{tmp_path}/out")
    assert sorted(map(str, rows.where("label = 'mon'").drop("label").collect())) == sorted(map(str, rows.where("label = 'tue'").drop("label").collect()))
    assert rows.where("dimension = 'obsolete'").select("n").distinct().collect() == [(0,)]


def test_command_line(spark, tmp_path):
    """It makes and stops a session of its own."""
    put(spark, [doc(1, "Alpha")], f"{tmp_path}/docs")
    done = subprocess.run([sys.executable, "-m", "jobs.symbol_index", "--documents", f"{tmp_path}/docs", "--output", f"{tmp_path}/out"], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "wrote 1 files and 1 symbols" in done.stderr, done.stderr[-2000:]
    assert everything(spark, f"{tmp_path}/out")[1][0]["name"] == "Alpha"


def test_registered_queries_leave_settings_alone(spark, tmp_path):
    from jobs import queries

    put(spark, [doc(1, "Alpha\nBeta"), doc(2, "lower")], f"{tmp_path}/documents.parquet")
    before = dict(spark.conf.getAll)
    got = queries.job1_symbol_index(spark, str(tmp_path)).orderBy("file", F.col("name")).collect()
    assert [(r["file"], r["name"], r["line"]) for r in got] == [(1, "Alpha", 1), (1, "Beta", 2), (2, None, None)]
    assert dict(spark.conf.getAll) == before
