import hashlib
import json

import pandas as pd
import pytest

from quern.plans import alerts, lineage, staging
from quern.sources import publish, ranges, settings, tables, weather


def test_csv_is_text_with_missing_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,NaN\n2,\n3,N/A\n4, keep \n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r)[:2] for r in df.orderBy("_row").collect()] == [("1", None), ("2", None), ("3", None), ("4", " keep ")]


def test_csv_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x\n1,"a ""b"" c"\n2,"two\nlines, and a comma"\n3,back\\slash\n4,""\n')
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    rows = [tuple(r)[:2] for r in df.orderBy("_row").collect()]
    assert rows == [("1", 'a "b" c'), ("2", "two\nlines, and a comma"), ("3", "back\\slash"), ("4", None)]
    tables.write_table(df.drop("_row"), f"{tmp_path}/b.csv", "csv")
    back = tables.read_rejected(spark, f"{tmp_path}/b.csv", df.drop("_row").schema)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_csv_faults(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(FileNotFoundError, match="none.csv"):
        tables.read_sources(spark, {"a": str(tmp_path / "none.csv")})


def test_write_formats(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    for fmt in ("csv", "parquet"):
        tables.write_table(df, f"{tmp_path}/x.{fmt}", fmt, order=["k"])
        tables.write_table(df, f"{tmp_path}/x.{fmt}", fmt, order=["k"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/x.parquet").collect()] == [(1, None), (2, "b")]
    assert spark.read.csv(f"{tmp_path}/x.csv", header=True).count() == 2
    with pytest.raises(ValueError):
        tables.write_table(df, f"{tmp_path}/x.orc", "orc")


def test_single_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    (tmp_path / "x.csv").mkdir()  # as an earlier release left
    for n in (2, 1):
        tables.write_table(df.limit(n), f"{tmp_path}/x.parquet", "parquet", single=True)
        tables.write_table(df, f"{tmp_path}/x.csv", "csv", single=True, order=["k"])
    assert (tmp_path / "x.parquet").is_file() and len(pd.read_parquet(tmp_path / "x.parquet")) == 1
    assert (tmp_path / "x.csv").read_text() == 'k,v\n1,""\n2,b\n' or len(pd.read_csv(tmp_path / "x.csv")) == 2
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"x.parquet", "x.csv"}


@pytest.fixture
def exports(tmp_path):
    out = settings.merged(settings.DEFAULTS, {"exports": {"mart_formats": ["csv", "parquet"], "star_schema_formats": ["parquet"]}})
    out["paths"] = {k: str(tmp_path / k) for k in out["paths"]}
    return out


def _gold(spark, n):
    rows = spark.range(n)
    keys = {t: {c: "id" for c in tables.EXPORT_ORDER[t]} for t in (*tables.STAR, tables.MART)}
    return {t: rows.selectExpr(*[f"{v} AS {k}" for k, v in names.items()], f"{n} AS version") for t, names in keys.items()}


def test_a_publication_is_seen_whole_or_not_at_all(spark, exports, monkeypatch):
    with pytest.raises(FileNotFoundError):
        tables.read_gold(spark, exports)
    tables.save_gold(_gold(spark, 3), exports)
    seen = tables.published(spark, exports, "gold")
    real, calls = tables.write_table, []

    def fourth_fails(*args, **more):
        calls.append(args[1])
        if len(calls) == 4:
            raise OSError("lost")
        real(*args, **more)

    monkeypatch.setattr(tables, "write_table", fourth_fails)
    with pytest.raises(OSError):
        tables.save_gold(_gold(spark, 5), exports)
    monkeypatch.setattr(tables, "write_table", real)
    assert len(calls) == 4 and tables.published(spark, exports, "gold") == seen
    assert {df.first()["version"] for df in tables.read_gold(spark, exports).values()} == {3} and {df.count() for df in tables.read_gold(spark, exports).values()} == {3}
    held = tables.read_gold(spark, exports)  # a reader of the old version goes on
    tables.save_gold(_gold(spark, 5), exports)
    assert {df.first()["version"] for df in tables.read_gold(spark, exports).values()} == {5} and {df.count() for df in held.values()} == {3}
    tables.save_gold(_gold(spark, 6), exports)
    folder = f"{exports['paths']['gold_parquet_dir']}/{publish.VERSIONS}"
    assert len([p for p in __import__("os").listdir(folder) if not p.startswith(".")]) == publish.KEPT


def test_names_are_turned_to_whole_tables(spark, monkeypatch):
    spark.sql("CREATE DATABASE IF NOT EXISTS turned")
    spark.range(1).write.mode("overwrite").saveAsTable("turned.dim_products")  # as an earlier release left
    tables.publish_tables(_gold(spark, 2), "turned")
    real, calls = tables.write_table, []

    def third_fails(*args, **more):
        calls.append(args[1])
        if len(calls) == 3:
            raise OSError("lost")
        real(*args, **more)

    monkeypatch.setattr(tables, "write_table", third_fails)
    with pytest.raises(OSError):
        tables.publish_tables(_gold(spark, 4), "turned")
    monkeypatch.setattr(tables, "write_table", real)
    assert {spark.table(f"turned.{t}").count() for t in (*tables.STAR, tables.MART)} == {2}
    tables.publish_tables(_gold(spark, 4), "turned")
    assert {spark.table(f"turned.{t}").count() for t in (*tables.STAR, tables.MART)} == {4}
    spark.sql("DROP DATABASE turned CASCADE")


def test_contract_projection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, extra int, a int")
    assert tables.to_contract(df, ["a", "b"]).columns == ["a", "b"]


def test_settings_merge_and_check(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("quality:\n  max_reject_rate: 0.1\nexports:\n  mart_formats: [CSV, parquet, csv]\nweather:\n  start_date: 2025-01-02\n")
    monkeypatch.setenv(settings.BASE_ENV, str(tmp_path))
    found = settings.get_settings(str(tmp_path / "c.yaml"))
    assert found["quality"] == {"max_reject_rate": 0.1, "min_valid_price_coverage": 0.9, "max_unknown_city_rate": 0.08}
    assert found["exports"]["mart_formats"] == ["csv", "parquet"] and found["paths"]["raw_dir"] == str(tmp_path / "data/raw")
    found["quality"]["max_reject_rate"] = 9
    assert settings.get_settings(str(tmp_path / "c.yaml"))["quality"]["max_reject_rate"] == 0.1
    assert "gold_mart_csv" in tables.artifact_paths(found)


@pytest.mark.parametrize("bad", [{"odd": 1}, {"quality": {"max_reject_rate": 2}}, {"exports": {"mart_formats": []}}, {"exports": {"mart_formats": ["xml"]}}, {"weather": {"start_date": "2026-01-01"}},
                                 {"analytics": {"buckets": {"temperature": {"cold_lt_c": 30}}}}, {"weather": {"request": {"max_workers": 0}}}, {"quality": 3}, {"weather": {"start_date": "x"}}])
def test_settings_faults(bad):
    with pytest.raises(settings.SettingsError):
        settings.validated(settings.merged(settings.DEFAULTS, bad))


def test_normalization_falls_back():
    cities, categories, leet = settings.normalization({"normalization": {"city_map": {" X ": "Y", "": "z"}, "category_map": {}, "product_name": {"leet_enabled": "no"}}})
    assert cities == {"x": "y"} and categories["misc"] == "unknown" and leet == {}


DAILY = {"time": ["2025-01-01", "2025-01-02"], "temperature_2m_mean": [1.5, None], "precipitation_sum": [0.0, 2.0], "precipitation_hours": [0, 1], "weather_code": [3, 61]}


def test_weather_rows_in_order_after_retries(spark, tmp_path):
    """Tasks fetch: what they did is seen in files."""
    folder = str(tmp_path)

    def get(url, params, timeout):
        import os

        name = f"{folder}/{params['latitude']}-{params['start_date']}"
        tries = len([x for x in os.listdir(folder) if x.startswith(name.rsplit("/", 1)[1])])
        open(f"{name}-{tries}", "w").close()
        if tries == 0 and params["latitude"] > 41:
            raise weather.HttpError(503)
        return json.dumps({"daily": DAILY})

    def sleep(seconds):
        assert 1.0 <= seconds <= 1.5
        open(f"{folder}/slept", "w").close()

    cfg = settings.merged(settings.DEFAULTS, {"weather": {"start_date": "2025-01-01", "end_date": "2025-01-02", "request": {"max_workers": 1}}})
    found = weather.fetch_weather(spark, cfg, get, sleep)
    got = found.collect()
    assert [(r["city"], r["date"]) for r in got] == [("Madrid", "2025-01-01"), ("Madrid", "2025-01-02"), ("Barcelona", "2025-01-01"), ("Barcelona", "2025-01-02")]
    assert got[1]["temp_c"] is None and got[1]["weather_code"] == "61"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["40.4168-2025-01-01-0", "41.3851-2025-01-01-0", "41.3851-2025-01-01-1", "slept"]


def test_weather_requests_are_spans_of_days_in_few_tasks(spark):
    cfg = settings.merged(settings.DEFAULTS, {"weather": {"start_date": "2020-02-01", "end_date": "2022-03-01", "request": {"max_workers": 2}}})
    spans = [(city, p["start_date"], p["end_date"]) for city, p in weather.requests_of(cfg)]
    assert spans[:3] == [("Madrid", "2020-02-01", "2021-01-31"), ("Madrid", "2021-02-01", "2022-02-01"), ("Madrid", "2022-02-02", "2022-03-01")] and len(spans) == 6
    parts = weather.answers_source(cfg, None, None)({}).reader(None).partitions()
    assert [len(p.wanted) for p in parts] == [3, 3]


@pytest.mark.parametrize(("answer", "says"), [(404, "HTTP status 404"), (TimeoutError, "TimeoutError"), ("[1]", "not a JSON object"), ("{}", "unexpected answer for")])
def test_weather_faults(spark, answer, says):
    def get(url, params, timeout):
        if isinstance(answer, int):
            raise weather.HttpError(answer)
        if isinstance(answer, type):
            raise answer("late")
        return answer

    with pytest.raises(Exception, match=says):
        weather.fetch_weather(spark, settings.DEFAULTS, get, lambda s: None).collect()


def test_cities():
    odd = {"weather": {"cities": {"x": {"lat": 1, "lon": "2"}, "y": {"lat": 1}, "z": 3, "w": {"lat": "a", "lon": 1}, "v": {"lat": None, "lon": 1}, "u": {"name": " new  York", "lat": "-1.5", "lon": 3}}}}
    assert weather.cities_of(odd) == {"X": (1.0, 2.0), "New  York": (-1.5, 3.0)}
    near = {"weather": {"cities": {"a": {"lat": "5e-05", "lon": "+51.5"}, "b": {"lat": ".5", "lon": -0.0001}, "c": {"lat": "nan", "lon": 1}, "d": {"lat": 1, "lon": "inf"}, "e": {"lat": [], "lon": 1}}}}
    assert weather.cities_of(near) == {"A": (5e-05, 51.5), "B": (0.5, -0.0001)}
    for none in ({}, {"cities": {}}, {"cities": {"x": {}}}):
        assert weather.cities_of({"weather": none}) == {"Madrid": (40.4168, -3.7038), "Barcelona": (41.3851, 2.1734)}


def test_lineage_marks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("part-0", "x"), ("part-1", "yz"), ("_SUCCESS", "")):
        (tmp_path / "d" / name).write_text(text)
    (tmp_path / "one.csv").write_text("a,b\n")
    found = lineage.marks(spark, inputs={"one": str(tmp_path / "one.csv")}, final_outputs={"folder": str(tmp_path / "d"), "gone": str(tmp_path / "no")})
    assert found["inputs"]["one"]["sha256"] == hashlib.sha256(b"a,b\n").hexdigest()
    folder = found["final_outputs"]["folder"]
    parts = "".join(hashlib.sha256(x).hexdigest() for x in (b"x", b"yz"))
    assert (folder["files"], folder["size_bytes"], folder["sha256"]) == (2, 3, hashlib.sha256(parts.encode()).hexdigest())
    assert found["final_outputs"]["gone"] == {"path": str(tmp_path / "no"), "exists": False}


def test_large_files_have_the_digest_of_a_tree(spark, tmp_path, monkeypatch):
    data = bytes(range(256)) * 40
    (tmp_path / "x").write_bytes(data)
    (tmp_path / "y").write_bytes(data[:700])

    def tree(hashes, fan):
        while len(hashes) > 1:
            hashes = [hashes[i] if i + 1 == len(hashes) and len(hashes) % fan == 1 else hashlib.sha256("".join(hashes[i : i + fan]).encode()).hexdigest() for i in range(0, len(hashes), fan)]
        return hashes[0]

    files = [(str(tmp_path / "x"), len(data)), (str(tmp_path / "y"), 700)]
    monkeypatch.setattr(ranges, "FAN", 4)
    for tasks in (1, 3, 50):  # the number of tasks does not matter
        monkeypatch.setattr(ranges, "TASK_RANGES", tasks)
        found = {r["path"]: r["digest"] for r in ranges.digests(spark, files, 1000).collect()}
        pieces = [hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, len(data), 1000)]
        assert found == {files[0][0]: tree(pieces, 4), files[1][0]: hashlib.sha256(data[:700]).hexdigest()}
    monkeypatch.setattr(ranges, "RANGE", 5000)
    assert lineage.mark(spark, files[1][0])["sha256"] == hashlib.sha256(data[:700]).hexdigest()
    found = lineage.mark(spark, files[0][0])
    assert found["sha256"] is not None and found["range_bytes"] == 5000 and found["size_bytes"] == len(data) and found["modified_ms"] > 0


def test_accounts_of_rows(spark):
    rows = {r["dataset"]: tuple(r)[1:] for r in lineage.accounts({"a": spark.range(10), "b": spark.range(0)}, {"a": spark.range(6), "other": spark.range(3)}, {"a": spark.range(3)}).collect()}
    assert rows == {"a": (10, 6, 3, 9, 1), "b": (0, None, None, 0, 0)}


def test_a_run_is_told(spark, tmp_path):
    story = lineage.RunLog()
    with story.stage("one"):
        pass
    with pytest.raises(KeyError), story.stage("two"):
        raise KeyError
    story.count(lineage.accounts({"a": spark.range(2)}, {"a": spark.range(1)}))
    story.figures |= {"mart": {"rows": 3}, "quality": {"status": "passed", "warnings": ["w"]}}
    story.marks = {"final_outputs": {"x": {"exists": True}, "y": {"exists": False}}}
    report = story.report(ValueError("no"))
    assert report["error"] == {"type": "ValueError", "message": "no"} and report["status"] == "failed" and "duration_seconds" not in report["stages"]["two"]
    kept = json.loads(open(lineage.keep(spark, report, str(tmp_path))).read())
    assert kept["row_counts"]["unpublished"] == {"a": 1} and list(kept) == sorted(kept) and story.run_id in kept["run_id"]
    short = lineage.summary(kept)
    assert list(short["stage_seconds"]) == ["one"] and short["outputs"] == {"all": 2, "missing": 1} and short["quality"] == {"status": "passed", "warnings": 1, "critical_failures": 0}
    assert lineage.summary({"stages": 3, "artifacts": [], "quality_report": "x"})["stage_seconds"] == {}


ON = {"ALERTS_ENABLED": "Y", "ALERTS_CHANNEL": "slack", "ALERTS_SLACK_WEBHOOK_URL": "http://x", "ALERTS_TIMEOUT_SECONDS": "odd"}


def test_alerts(monkeypatch):
    sent = []
    post = lambda url, payload, timeout: sent.append((url, payload["text"].split("\n"), timeout))
    assert not alerts.tell(alerts.Alert("t", "m"), post, {}) and not alerts.tell(alerts.Alert("t", "m"), post, ON | {"ALERTS_CHANNEL": "none"})
    assert alerts.tell(alerts.Alert("t", "m", "odd", {"a": 1, "b": None}), post, ON)
    assert sent == [("http://x", ["HIGH | quern/local | t", "m", "a = 1"], 5.0)]
    assert alerts.tell(alerts.Alert("t", "m", "Critical"), post, ON | {"ALERTS_TIMEOUT_SECONDS": "2.5", "ALERTS_PROJECT": "p"}) and sent[1][1:] == (["CRITICAL | p/local | t", "m"], 2.5)

    def broken(*a):
        raise OSError

    assert not alerts.tell(alerts.Alert("t", "m"), broken, ON)
    for fault in ({"ALERTS_CHANNEL": "mail"}, {"ALERTS_SLACK_WEBHOOK_URL": ""}):
        assert not alerts.tell(alerts.Alert("t", "m"), post, ON | fault)
    for k, v in ON.items():
        monkeypatch.setenv(k, v)
    task = type("Task", (), {"dag_id": "d", "task_id": "t", "try_number": 2})()
    assert alerts.task_failure({"run_id": "r", "exception": ValueError("no"), "task_instance": task}, post)
    assert sent[2][1][2:] == ["dag_id = d", "task_id = t", "run_id = r", "try_number = 2", "error = ValueError: no"]


def test_staged_tables_come_back(spark, tmp_path):
    assert staging.folder_name("manual__2025-01-01T00:00:00+00:00/é x") == "manual__2025-01-01T00_00_00_00_00_x"
    for n in (3, 2):
        folder = staging.stage({"a": spark.range(n)}, str(tmp_path), "run:1")
    assert staging.staged(spark, folder, ("a",))["a"].count() == 2
    for wrong in (str(tmp_path), str(tmp_path.parent), f"{tmp_path}/x/../..", f"{tmp_path}2/run"):
        with pytest.raises(ValueError):
            staging.unstage(spark, wrong, str(tmp_path))
    staging.unstage(spark, folder, str(tmp_path))
    assert not tables.exists(spark, folder) and tmp_path.exists()
