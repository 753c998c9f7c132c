"""CSV read by many tasks against Python's reader of the whole text."""

import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.sources import delimited, tables

CELL = st.text(alphabet='ab ,"\n\ré', max_size=8)


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def found(spark, path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        scanned = delimited.scan(spark, str(path))
        n = delimited._lines(spark, str(path)).rdd.getNumPartitions()
        return [tuple(r) for r in sorted(scanned.rows("_row").collect(), key=lambda r: r["_row"])], n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(CELL, CELL, CELL), min_size=1, max_size=12), st.integers(3, 60))
def test_any_split_gives_the_rows_of_one_task(spark, tmp_path_factory, rows, split):
    rows = [("".join(x.replace("\r", "") for x in r[:1]) or "k", *r[1:]) for r in rows]  # a blank line is no record
    path = tmp_path_factory.mktemp("csv") / "a.csv"
    path.write_text(written([("x", "y", "z"), *rows]), newline="")
    got, _ = found(spark, path, split)
    assert [tuple(c or "" for c in r[:3]) for r in got] == [tuple(r) for r in rows]


def test_one_file_with_quoted_line_ends_is_read_by_many_tasks(spark, tmp_path):
    rows = [(str(i), f'say "{i}",\nand\n\nmore' if i % 3 else f"plain {i}", "end") for i in range(400)]
    path = tmp_path / "a.csv"
    path.write_text(written([("id", "said", "z"), *rows], "\r\n"), newline="")
    got, tasks = found(spark, path, 1500)
    assert [r[:3] for r in got] == rows and tasks >= 8
    places = [r[3] for r in got]
    assert places == sorted(set(places)) and places[0] == 1


def test_places_follow_files_of_any_size(spark, tmp_path):
    """The first row of the input wins, however files are packed into tasks: the largest comes first in Spark's packing."""
    for name, n in (("a", 3), ("b", 900), ("c", 40)):
        (tmp_path / f"{name}.csv").write_text("id,v\n" + "".join(f"{name}{i},{'x' * 30}\n\n" for i in range(n)))
    got, _ = found(spark, tmp_path, 4000)
    assert [r[0] for r in got] == [f"{name}{i}" for name, n in (("a", 3), ("b", 900), ("c", 40)) for i in range(n)]


def test_short_rows_blank_lines_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,x,y\n\n1\n  \n2,5" disk,b\n3,"",c\n"4","a ""b""","d"\n', encoding="utf-8")
    got, _ = found(spark, tmp_path / "a.csv", 1000)
    assert [r[:3] for r in got] == [("1", None, None), ("2", '5" disk', "b"), ("3", None, "c"), ("4", 'a "b"', "d")]


@pytest.mark.parametrize(("text", "line", "what"), [
    ("id,x\n1,a\n2,b,c\n", 3, "3 cells, where the header has 2"), ('id,x\n1,"a\nb",c\n', 2, "3 cells, where the header has 2"),
    ('id,x\n1,a\n2,"open\n3,b\n', 3, "a quoted cell is not closed")])
def test_malformed_rows_name_file_and_line(spark, tmp_path, text, line, what):
    (tmp_path / "bad.csv").write_text(text)
    with pytest.raises(delimited.MalformedInput, match="bad.csv, line") as e:
        tables.read_csv(spark, str(tmp_path / "bad.csv"))
    assert e.value.faults[0][0].endswith("bad.csv") and e.value.faults[0][1:] == (line, what)


def test_other_headers_are_faults(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,a\n")
    (tmp_path / "b.csv").write_text("x,id\n1,a\n")
    with pytest.raises(delimited.MalformedInput, match="other names"):
        tables.read_csv(spark, str(tmp_path))


def test_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,a\n2,b,c\n3,NaN\n")
    staged, counts = tables.stage_sources(spark, {"a": str(tmp_path / "a.csv")}, f"{tmp_path}/staged", f"{tmp_path}/bad")
    assert counts == {"a": 2} and [tuple(r) for r in staged["a"].orderBy("_row").collect()] == [("1", "a", 1), ("3", None, 3)]
    assert [tuple(r)[1:] for r in spark.read.parquet(f"{tmp_path}/bad/a").collect()] == [(3, "3 cells, where the header has 2", "2,b,c")]
    with pytest.raises(delimited.MalformedInput):
        tables.stage_sources(spark, {"a": str(tmp_path / "a.csv")}, f"{tmp_path}/staged")


def test_lines_without_quoted_ends_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n" + "".join(f"{i},v\n" for i in range(50)))
    scanned = delimited.scan(spark, str(tmp_path / "a.csv"))
    rows = scanned.rows("_row")
    assert rows.count() == 50
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "PythonUDF" not in plan
