import json
import os
from pathlib import Path

import pandas as pd
import pytest

from quern.operators.cleaning import reason_counts
from quern.operators.quality import QualityGateError
from quern.plans import lineage, run
from quern.plans.run import Hooks, run_pipeline
from quern.plans.star import InvariantError
from quern.sources import settings
from quern.sources.delimited import MalformedInput

FILES = {
    "customers": "customer_id,first_name,last_name,city,signup_date\n1,ana,x,madríd,2024-01-01\n1,ana,,madrid,\n2,bo,y,bar celona,2024/02/01\n",
    "products": "product_id,product_name,category,price\n10,B0tella,fotwear,\"$15,50\"\n11,Cap,misc,-1\n",
    "sales": "sale_id,customer_id,product_id,sale_date,quantity,discount\n1,1.0,10,2024-03-01,2,10\n1,1.0,10,,2,10\n2,2.0,11,2024-03-01,1,\n3,,10,2024-03-01,1,NaN\n4,9.0,99,bad,one,200\n",
    "weather_daily": "date,city,temp_c,precip_mm,precip_hours,weather_code\n2024-03-01,Madrid,9,0,0,1\n2024-03-01,Barcelona,20,3,1,61\n",
}


@pytest.fixture
def cfg(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, text in FILES.items():
        (raw / f"{name}.csv").write_text(text)
    out = settings.merged(settings.DEFAULTS, {"exports": {"mart_formats": ["csv", "parquet"]}})
    out["paths"] = {k: str(tmp_path / k) for k in out["paths"]} | {"raw_dir": str(raw)}
    return out


def test_whole_run_twice(spark, cfg):
    for _ in range(2):
        out = run_pipeline(spark, cfg)
        rows = out.report["row_counts"]
        assert rows["extract"] == {"customers": 3, "products": 2, "sales": 5, "weather_daily": 2}
        assert rows["cleaned"] == {"customers": 2, "products": 2, "sales": 2, "weather_daily": 2} and rows["rejected"] == {"sales": 2}
        assert rows["unpublished"] == {"customers": 1, "products": 0, "sales": 1, "weather_daily": 0} and rows["mart"] == {"rows": 2, "columns": 14}
        assert all(x["exists"] for x in out.report["artifacts"]["final_outputs"].values())
        assert {r["sale_id"]: (r["discount"], r["reject_reasons"]) for r in out.rejected.collect()} == {
            "3": (None, "missing_customer_id"), "4": ("200", "invalid_sale_date|unknown_customer_id|unknown_product_id|invalid_quantity|discount_out_of_range")}
    reports = list(Path(cfg["paths"]["lineage_dir"]).glob("lineage_*.json"))
    assert len(reports) == 2 and json.loads(reports[0].read_text())["status"] == "passed"


def test_failed_runs_leave_a_report_and_no_gold(spark, cfg):
    def broken(cleaned, rejected, limits):
        raise QualityGateError("no", {"status": "failed", "critical_failures": ["x"]})

    with pytest.raises(QualityGateError):
        run_pipeline(spark, cfg, hooks=Hooks(checks=broken))
    report = json.loads(next(Path(cfg["paths"]["lineage_dir"]).glob("*.json")).read_text())
    assert report["status"] == "failed" and report["quality_report"]["critical_failures"] == ["x"] and report["error"]["type"] == "QualityGateError"
    assert Path(cfg["paths"]["silver_dir"]).exists() and not Path(cfg["paths"]["gold_parquet_dir"]).exists()

    def doubled(raw, cities):
        from quern.operators.cleaning import clean_customers

        found = clean_customers(raw, cities)
        return found.union(found)

    with pytest.raises((InvariantError, QualityGateError)):
        run_pipeline(spark, cfg, hooks=Hooks(customers=doubled))


def test_the_weather_file_is_needed_offline(spark, cfg):
    Path(cfg["paths"]["raw_dir"], "weather_daily.csv").unlink()
    with pytest.raises(FileNotFoundError):
        run_pipeline(spark, cfg)


@pytest.mark.skipif("QUERN_ACCEPTANCE_RAW" not in os.environ, reason="QUERN_ACCEPTANCE_RAW names no folder of raw files")
def test_published_figures(spark, tmp_path):
    """The figures published for the raw files in the folder $QUERN_ACCEPTANCE_RAW, which are not kept here."""
    cfg = settings.merged(settings.DEFAULTS, {})
    cfg["paths"] = {k: str(tmp_path / k) for k in cfg["paths"]} | {"raw_dir": os.environ["QUERN_ACCEPTANCE_RAW"]}
    out = run_pipeline(spark, cfg)
    rows = out.report["row_counts"]
    assert rows["extract"] == {"customers": 820, "products": 800, "sales": 940, "weather_daily": 180}
    assert rows["cleaned"] == {"customers": 720, "products": 600, "sales": 568, "weather_daily": 180} and rows["rejected"] == {"sales": 332}
    assert rows["unpublished"] == {"customers": 100, "products": 200, "sales": 40, "weather_daily": 0} and rows["mart"] == {"rows": 415, "columns": 14}
    assert out.report["quality_report"]["warnings"] == []
    assert sum(r["rejected"] for r in reason_counts(out.rejected).collect()) == 371


def test_exports_as_csv_alone_and_tables_by_name(spark, cfg):
    cfg["exports"] = {"mart_formats": ["csv"], "star_schema_formats": ["csv"]}
    spark.sql("CREATE DATABASE IF NOT EXISTS published")
    out = run_pipeline(spark, cfg, single=True, database="published")
    assert out.gold["weather_sales_mart"].count() == 2 and spark.table("published.weather_sales_mart").count() == 2
    assert Path(cfg["paths"]["gold_csv_dir"], "marts/weather_sales_mart.csv").is_file()
    assert len(pd.read_parquet(Path(cfg["paths"]["silver_dir"], "customers_clean.parquet"))) == 2
    spark.sql("DROP DATABASE published CASCADE")


def test_malformed_rows_end_a_run_or_go_to_quarantine(spark, cfg, tmp_path):
    path = Path(cfg["paths"]["raw_dir"], "sales.csv")
    path.write_text(FILES["sales"] + "5,1,10,2024-03-01,2,10,too,many\n")
    with pytest.raises(MalformedInput, match=r"sales.csv, line 7: 8 cells"):
        run_pipeline(spark, cfg)
    out = run_pipeline(spark, cfg, quarantine=f"{tmp_path}/bad")
    assert out.report["row_counts"]["extract"]["sales"] == 5 and spark.read.parquet(f"{tmp_path}/bad/sales").count() == 1


def test_scheduled_tasks_pass_notes_and_always_clean_up(spark, cfg):
    """Each task as a scheduler runs it: notes go through JSON, and clean-up runs however the others ended."""
    notes = {}
    for name, task in (("extract", run.extract_task), ("transform", run.transform_task), ("load", run.load_task)):
        notes[name] = json.loads(json.dumps(task(spark, cfg, "day:1")))
    staged = Path(cfg["paths"]["silver_dir"], "_staged/day_1")
    assert staged.exists()
    report = run.cleanup_task(spark, cfg, "day:1", **notes)
    assert report["status"] == "passed" and not staged.exists() and report["row_counts"]["mart"] == {"rows": 2, "columns": 14} and {*report["stages"]} == {"extract", "profile", "transform", "quality", "load", "cleanup"}
    assert all(x["sha256"] for x in report["artifacts"]["staged_inputs"].values()) and lineage.summary(report)["rows"]["mart"]["rows"] == 2
    extracted = run.extract_task(spark, cfg, "day:2")
    failed = run.cleanup_task(spark, cfg, "day:2", extracted, None, None, ValueError("no"))
    assert failed["status"] == "failed" and failed["error"]["type"] == "ValueError" and failed["cleanup"]["status"] == "deleted"
    assert run.cleanup_task(spark, cfg, "day:3", None, None, None)["cleanup"]["status"] == "not_found"
