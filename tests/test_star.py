import datetime
import hashlib
from decimal import Decimal

import pytest

from quern.plans import star

D = [datetime.date(2024, 3, d) for d in range(1, 6)]


@pytest.fixture
def silver(spark):
    make = spark.createDataFrame
    return {
        "customers": make([(1, "A", "B", "Madrid", None), (2, "C", "D", None, None)], "customer_id long, first_name string, last_name string, city string, signup_date date"),
        "products": make([(10, "Shoe", "Footwear", 10.0, True), (11, "Cap", "Unknown", None, False)], "product_id long, product_name string, category string, price double, is_price_valid boolean"),
        "sales": make([(101, 1, 10, D[0], 2, 10.0), (102, 1, 10, D[1], 1, 0.0), (103, 1, 11, D[1], 1, 0.0), (104, 2, 10, D[2], 1, 0.0), (105, 1, 10, D[4], 3, 0.0)],
                      "sale_id long, customer_id long, product_id long, sale_date date, quantity long, discount double"),
        "weather_daily": make([(D[0], "Madrid", 9.9, 0.0, 0.0, 1), (D[1], "Madrid", 10.0, 1.99, 1.0, 2), (D[2], "Madrid", 25.0, 2.0, 1.0, 3), (D[3], "Madrid", None, None, None, None)],
                              "date date, city string, temp_c double, precip_mm double, precip_hours double, weather_code int"),
    }


def test_dimensions_and_buckets(silver):
    found = {r["date"]: r for r in star.dim_weather(silver["weather_daily"]).collect()}
    assert [found[d]["rain_bucket"] for d in D[:4]] == ["no_rain", "light_rain", "heavy_rain", "unknown"]
    assert [found[d]["temp_bucket"] for d in D[:4]] == ["cold", "mild", "mild", "unknown"]
    assert found[D[0]]["weather_sk"] == hashlib.md5(b"2024-03-01|Madrid").hexdigest()
    assert [r["is_price_valid"] for r in star.dim_products(silver["products"]).orderBy("product_id").collect()] == [1, 0]


def test_fact_and_mart(silver):
    gold = star.build(silver)
    fact = {r["sale_id"]: r for r in gold["fact_sales"].collect()}
    assert (fact[101]["gross_amount"], fact[101]["discount_amount"], fact[101]["net_amount"]) == (Decimal("20.00"), Decimal("2.00"), Decimal("18.00"))
    assert fact[103]["gross_amount"] is None and fact[103]["has_valid_price"] == 0 and fact[104]["weather_sk"] is None
    mart = {(r["sale_date"], r["category"]): r for r in gold["weather_sales_mart"].collect()}
    assert (D[2], "Footwear") not in mart  # the customer's city is not known
    assert mart[D[4], "Footwear"]["rain_bucket"] is None and mart[D[4], "Footwear"]["total_revenue"] == Decimal("30.00")
    assert mart[D[1], "Unknown"]["avg_ticket"] is None and mart[D[1], "Unknown"]["valid_price_rate"] == 0.0
    assert [f.dataType.simpleString() for f in gold["weather_sales_mart"].schema.fields if f.name in ("total_units", "total_revenue")] == ["bigint", "decimal(38,2)"]
    star.require(gold)


@pytest.mark.parametrize(("table", "message"), [("customers", "dim_customers"), ("products", "dim_products"), ("weather_daily", "weather_sk"), ("sales", "fact_sales")])
def test_invariants(silver, table, message):
    silver[table] = silver[table].union(silver[table])
    with pytest.raises(star.InvariantError, match=message):
        star.require(star.build(silver))


def test_null_weather_key(silver, spark):
    silver["weather_daily"] = silver["weather_daily"].union(spark.createDataFrame([(D[0], None, 1.0, 1.0, 1.0, 1)], silver["weather_daily"].schema))
    with pytest.raises(star.InvariantError, match="weather_sk is null"):
        star.require(star.build(silver))


def test_bucket_limits():
    for bad in ({"light_rain_lt_mm": -1}, {"cold_lt_c": 30}):
        with pytest.raises(ValueError):
            star.Buckets(**bad)
