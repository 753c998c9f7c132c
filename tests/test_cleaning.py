import datetime

import pytest
from pyspark.errors import PySparkException

from quern.operators import cleaning
from quern.sources.settings import CATEGORY_SPELLINGS, CITY_SPELLINGS, LEET

D = datetime.date


def test_customers_keep_the_most_complete_row(rows):
    raw = rows("customer_id first_name last_name city signup_date", ("1", " ana ", "lópez", None, "2024/1/2"), ("1.0", "ANA", "lópez", "madríd", "2024-01-05"), ("2", "b", "", "bar celona", "x"),
               (None, "n", "n", "n", "n"), ("2.5", "f", "f", "f", "f"), ("abc", "t", "t", "t", "t"))
    found = {tuple(r) for r in cleaning.clean_customers(raw, CITY_SPELLINGS).collect()}
    assert found == {(1, "Ana", "López", "Madrid", D(2024, 1, 5)), (2, "B", None, "Barcelona", None)}


def test_customer_ties_keep_the_first_row(spark):
    data = [("1", "first", "a", "x", "2024-01-01", 0), ("1", "second", "a", "x", "2024-01-01", 1)]
    for order in (data, data[::-1]):
        raw = spark.createDataFrame(order, "customer_id string, first_name string, last_name string, city string, signup_date string, _row long")
        assert cleaning.clean_customers(raw).first()["first_name"] == "First"


def test_products(rows):
    raw = rows("product_id product_name category price", ("1", "B0tella  grande", "fotwear", "$15,50"), ("1", "b", None, "-1"), ("2", "Pack 10L", "nonsense", "-5"), ("3", None, None, None))
    found = {r["product_id"]: tuple(r)[1:] for r in cleaning.clean_products(raw, CATEGORY_SPELLINGS, LEET).collect()}
    assert found == {1: ("Botella Grande", "Footwear", 15.5, True), 2: ("Pack 10L", "Unknown", None, False), 3: (None, "Unknown", None, False)}


def test_products_without_leet(rows):
    raw = rows("product_id product_name category price", ("1", "B0tella", "x", "1"))
    assert cleaning.clean_products(raw, {}, {}).first()["product_name"] == "B0Tella"


@pytest.fixture
def judged(spark, rows):
    customers, products = spark.createDataFrame([(1,), (2,)], "customer_id long"), spark.createDataFrame([(10,), (11,)], "product_id long")

    def make(*sales):
        return cleaning.judge_sales(rows("sale_id customer_id product_id sale_date quantity discount", *sales), customers, products)

    return make


def test_sales_split(judged):
    found = judged(("1", "1", "10", "2024-01-01", "2", ""), ("2", "9", "99", "bad", "one", "abc"), (None, "", None, "2024-01-01", "2.5", "200"), ("x", "y", "z", "2024-01-01", "-1", "-1"), ("1", "1", "10", None, "2", "5"))
    clean, bad = cleaning.accepted_sales(found).collect(), cleaning.rejected_sales(found).collect()
    assert [tuple(r) for r in clean] == [(1, 1, 10, D(2024, 1, 1), 2, 0.0)]
    reasons = {r["sale_id"]: r["reject_reasons"] for r in bad}
    assert reasons == {
        "2": "invalid_sale_date|unknown_customer_id|unknown_product_id|invalid_quantity|invalid_discount",
        None: "missing_sale_id|missing_customer_id|missing_product_id|invalid_quantity|discount_out_of_range",
        "x": "invalid_sale_id|invalid_customer_id|invalid_product_id|invalid_quantity|discount_out_of_range",
    }
    counts = cleaning.reason_counts(cleaning.rejected_sales(found)).collect()
    assert [r["rank"] for r in counts] == sorted(r["rank"] for r in counts) and sum(r["rejected"] for r in counts) == 15


def test_rows_without_an_id_all_stay(judged):
    assert judged(*[(None, "1", "10", "2024-01-01", "1", "0")] * 3).count() == 3


def test_empty_sales(judged, spark):
    customers = spark.createDataFrame([], "customer_id long")
    raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in cleaning.SALES_COLUMNS))
    assert cleaning.judge_sales(raw, customers, spark.createDataFrame([], "product_id long")).count() == 0


def test_weather_nulls_negative_rain_before_it_scores(rows):
    raw = rows("date city temp_c precip_mm precip_hours weather_code", ("2024-03-01", " madrid", "10", "-1", "1", "3"), ("2024/03/01", "MADRID ", "11", "0", "1", "3.0"), ("2024-03-02", "x", "a", None, None, None))
    found = {tuple(r) for r in cleaning.clean_weather(raw).collect()}
    assert found == {(D(2024, 3, 1), "Madrid", 11.0, 0.0, 1.0, 3), (D(2024, 3, 2), "X", None, None, None, None)}


def test_weather_without_measures_and_with_odd_codes(rows):
    assert [tuple(r) for r in cleaning.clean_weather(rows("date city", ("2024-03-01", "a"), ("2024-03-01", "A"))).collect()] == [(D(2024, 3, 1), "A")]
    with pytest.raises(PySparkException, match="weather_code"):
        cleaning.clean_weather(rows("date city weather_code", ("2024-03-01", "a", "1.5"))).collect()


def test_long_ids_stay_apart(rows):
    ids = ("9007199254740993", "9007199254740992", "+9007199254740994.0", "9223372036854775808", "1e3", "1.5", "x", " ")
    customers = cleaning.clean_customers(rows("customer_id first_name last_name city signup_date", *[(i, "a", "b", "c", "2024-01-01") for i in ids]))
    assert {r["customer_id"] for r in customers.collect()} == {9007199254740993, 9007199254740992, 9007199254740994, 1000}
    products = cleaning.clean_products(rows("product_id product_name category price", ("9007199254740993", "a", "b", "1")))
    sales = rows("sale_id customer_id product_id sale_date quantity discount", *[(i, "9007199254740993", "9007199254740993", "2024-01-01", "1", "") for i in ids], ("7", "9007199254740995", "9007199254740993", "2024-01-01", "1", ""))
    judged = cleaning.judge_sales(sales, customers, products)
    assert {r["sale_id"] for r in cleaning.accepted_sales(judged).collect()} == {9007199254740993, 9007199254740992, 9007199254740994, 1000}
    assert {r["sale_id"]: r["reject_reasons"] for r in judged.filter("reject_reasons IS NOT NULL").collect()} == {
        "9223372036854775808": "invalid_sale_id", "1.5": "invalid_sale_id", "x": "invalid_sale_id", " ": "missing_sale_id", "7": "unknown_customer_id"}


def test_cleaners_take_the_tables_of_the_settings(rows, tmp_path, monkeypatch):
    from quern.plans import configured
    from quern.sources import settings

    raw = rows("customer_id first_name last_name city signup_date", ("1", "a", "b", "madríd", None), ("2", "a", "b", "xx", None))
    products = rows("product_id product_name category price", ("5", "B0tella", "xx", "3"))
    assert sorted(r["city"] for r in configured.clean_customers(raw).collect()) == ["Madrid", "Xx"]
    (tmp_path / "c.yaml").write_text("normalization:\n  city_map: {xx: lugo}\n  category_map: {xx: things}\n  product_name: {leet_enabled: false}\n")
    monkeypatch.setenv(settings.CONFIG_ENV, str(tmp_path / "c.yaml"))
    assert "Lugo" in {r["city"] for r in configured.clean_customers(raw).collect()}
    assert configured.clean_products(products).first()[1:3] == ("B0Tella", "Things")
    sales = rows("sale_id customer_id product_id sale_date quantity discount", ("1", "1", "5", "2024-01-01", "1", None), ("2", "7", "5", "2024-01-01", "1", None))
    clean, bad = configured.clean_sales(sales, configured.clean_customers(raw), configured.clean_products(products))
    assert [r["sale_id"] for r in clean.collect()] == [1] and [r["reject_reasons"] for r in bad.collect()] == ["unknown_customer_id"]
    assert configured.clean_weather(rows("date city temp_c", ("2024-01-01", " madrid ", "1"))).first()["city"] == "Madrid"
