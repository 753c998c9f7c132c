import datetime

import pytest

from quern.operators import quality
from quern.operators.profile import profile, top_values

D = datetime.date(2024, 1, 1)


@pytest.fixture
def silver(spark):
    make = spark.createDataFrame
    return {
        "customers": make([(1, "A", "B", "Madrid", D), (2, "C", "D", None, None)], "customer_id long, first_name string, last_name string, city string, signup_date date"),
        "products": make([(10, "Shoe", "Footwear", 5.0, True), (11, "Cap", "Unknown", None, False)], "product_id long, product_name string, category string, price double, is_price_valid boolean"),
        "sales": make([(100, 1, 10, D, 1, 0.0), (101, 2, 10, D, 2, 5.0)], "sale_id long, customer_id long, product_id long, sale_date date, quantity long, discount double"),
        "weather_daily": make([(D, "Madrid", 1.0, 0.0, 0.0, 1)], "date date, city string, temp_c double, precip_mm double, precip_hours double, weather_code int"),
    }


@pytest.fixture
def rejected(spark):
    return spark.createDataFrame([], "sale_id string, customer_id string, product_id string, sale_date string, quantity string, discount string, reject_reasons string")


def test_passes_and_measures(silver, rejected):
    report = quality.quality_report(silver, rejected, quality.Thresholds(max_unknown_city_rate=0.5))
    assert report["status"] == "passed" and report["warnings"] == []
    w = report["metrics"]["weather"]
    assert (w["sales_with_unknown_city"], w["eligible_sales_for_weather_match"], w["weather_coverage_rate"], w["price_coverage_rate"]) == (1, 1, 1.0, 1.0)


def test_warnings(silver, rejected, spark):
    bad = spark.createDataFrame([("1",) * 7] * 3, rejected.schema)
    silver["sales"] = silver["sales"].union(spark.createDataFrame([(102, 1, 11, D + datetime.timedelta(1), 1, 0.0)], silver["sales"].schema))
    silver["products"] = silver["products"].union(spark.createDataFrame([(12, "Cap 2", "Unknown", None, False)], silver["products"].schema))
    report = quality.quality_report(silver, bad)
    assert report["status"] == "passed" and [w.split(" ")[:3] for w in report["warnings"]] == [["sales", "rejected:", "50.00%,"], ["clean", "sales", "whose"], ["1", "clean", "sales"], ["clean", "sales", "with"], ["1", "product", "names"]]
    assert report["warnings"][0].endswith("where at most 45.00% is expected")


def test_failures_in_order(silver, rejected, spark):
    silver["sales"] = silver["sales"].union(spark.createDataFrame([(100, 9, 99, D, 1, 0.0), (None, 1, 10, None, 1, 0.0)], silver["sales"].schema))
    silver["customers"] = silver["customers"].union(silver["customers"])
    with pytest.raises(quality.QualityGateError) as e:
        quality.quality_report(silver, rejected)
    assert e.value.report["critical_failures"] == [
        "null sale_id after cleaning (1)", "duplicated sale_id after cleaning (1)", "duplicated customer_id (2)", "orphan customer_id in sales (1)", "orphan product_id in sales (1)",
        "sales.silver contract violation: sale_date must not contain nulls",
    ]
    assert quality.quality_report(silver, rejected, fail_on_critical=False)["status"] == "failed"


def test_contracts(silver):
    from pyspark.sql import functions as F

    start = ".silver contract violation: "
    assert quality.contract_failures("products", silver["products"].drop("price")) == [f"products{start}missing columns ['price']"]
    assert quality.contract_failures("products", silver["products"].withColumn("price", F.lit(-1.0))) == [f"products{start}price must be positive when is_price_valid is true and NA otherwise"]
    assert quality.contract_failures("customers", silver["customers"].withColumn("city", F.lit(1))) == [f"customers{start}city must be text-like"]
    twice = silver["weather_daily"].union(silver["weather_daily"].withColumn("city", F.lit(None).cast("string")).union(silver["weather_daily"]))
    assert quality.contract_failures("weather_daily", twice) == [f"weather_daily{start}city must not contain nulls", f"weather_daily{start}(date, city) must be unique"]
    assert quality.contract_failures("customers", silver["customers"].withColumn("extra", F.lit(1))) == []


def test_thresholds_are_clamped_and_reports_enforced():
    assert quality.Thresholds(2, -1, 0.5) == quality.Thresholds(1.0, 0.0, 0.5)
    assert quality.enforce({"status": "passed"}) == {"status": "passed"}
    with pytest.raises(quality.QualityGateError, match="x; y"):
        quality.enforce({"status": "failed", "critical_failures": ["x", "y"]})


def test_profile(rows):
    df = rows("sale_id quantity discount", ("1", "0", "200"), ("1", "0", "200"), (None, "x", None), (None, "2", "5"))
    found = profile("sales", df)
    assert (found["rows"], found["nulls_total"], found["duplicate_rows"], found["key_duplicates"]) == (4, 3, 1, 2)
    assert found["violations"] == {"quantity_le_0": 2, "discount_out_of_range": 2} and found["cardinality"] == {"sale_id": 1, "quantity": 3, "discount": 2}
    assert [tuple(r) for r in top_values(df, "quantity", 2).collect()] == [("0", 2), ("2", 1)]
    assert top_values(df, "sale_id", nulls=True).count() == 2
