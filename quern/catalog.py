"""All registered queries of the analytics engine; names begin with the operator families of the inventory that they apply."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern import roles
from quern.functions.dates import to_ymd
from quern.functions.numbers import is_whole, money, to_number, to_price
from quern.functions.text import letters_for_digits, looked_up, squeezed, tidy, title_case, trimmed
from quern.operators import cleaning, profile, quality
from quern.operators.best import repeated
from quern.oracles import ORACLES
from quern.plans import star
from quern.plans.lineage import accounts
from quern.sources import weather
from quern.sources.scratch import stored, stored_together
from quern.sources.tables import MART, first_rows

FLAGSHIP = "a1_mart"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]


def _round6(*columns: str) -> list[Column]:
    """Means agree between engines up to the order of summation."""
    return [F.round(F.col(c) * F.lit(1e6)).cast("long").alias(c) for c in columns]


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_customers(roles.raw(spark, sf, "customers"), roles.CITIES)


def _products(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_products(roles.raw(spark, sf, "products"), roles.CATEGORIES, roles.LETTERS)


def _judged(spark: SparkSession, sf: str, known: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Judged sales; `known` has silver customers and products where they are stored."""
    known = known or {"customers": _customers(spark, sf), "products": _products(spark, sf)}
    return cleaning.judge_sales(roles.raw(spark, sf, "sales"), known["customers"], known["products"])


def _weather(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_weather(roles.raw(spark, sf, "weather_daily"))


def _referred(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Silver customers, products and weather, each cleaned once: sales are judged by them and joined with them."""
    return {"customers": _customers(spark, sf), "products": _products(spark, sf), "weather_daily": _weather(spark, sf)}


def _silver(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    referred = stored_together(_referred(spark, sf))
    return referred | {"sales": cleaning.accepted_sales(_judged(spark, sf, referred))}


def _gold(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return star.build(_silver(spark, sf))


#: What is read of judged sales again: the typed columns, the raw ones and the reasons.
_JUDGEMENT = ("_sale", "_customer", "_product", "_date", "_quantity", "_discount", *cleaning.SALES_COLUMNS, "reject_reasons")


def s4_pruned_scan(spark, sf):
    """Scan with pushed filters and a pruned schema, cast and projected."""
    rows = roles.table(spark, sf, "lineitem").filter(F.col("l_quantity").between(10, 20) & (F.col("l_discount") > 0.05))
    return rows.select(F.col("l_orderkey").cast("int").alias("order_id"), F.col("l_shipdate").cast("date").cast("string").alias("shipped"), money(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("net"))


def t1_tidy_texts(spark, sf):
    """Trim, lower, collapse white space and blank to null over whole texts."""
    rows = roles.table(spark, sf, "documents").select("doc_id", tidy(F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))).alias("tidy"))
    return rows.select("doc_id", F.md5(F.col("tidy").cast("binary")).alias("tidy_md5"), F.length("tidy").alias("n_chars"))


def t4_title_case(spark, sf):
    """Title case after any non-letter (T4), and a lookup that keeps what it does not know."""
    rows = roles.raw(spark, sf, "customers")
    return rows.select("last_name", title_case(tidy(F.col("first_name"))).alias("first_title"), title_case(looked_up(tidy(F.col("city")), roles.CITIES)).alias("city_title"))


def t6_prices(spark, sf):
    """Prices out of text."""
    price = to_price(F.col("price"))
    return roles.raw(spark, sf, "products").select("product_id", "price", price.alias("parsed"), F.when(price > 0, price).alias("valid"))


def t15_categories(spark, sf):
    """Canonical categories, all else unknown."""
    return roles.raw(spark, sf, "products").select("product_id", "category", cleaning.category_of(tidy(F.col("category")), roles.CATEGORIES).alias("canonical"))


def d1_leet_names(spark, sf):
    """Look-alike digits back to letters by a left-to-right fold."""
    return roles.raw(spark, sf, "products").select("product_id", "product_name", letters_for_digits(squeezed(trimmed(F.col("product_name"))), roles.LETTERS).alias("plain"))


def d1_dates(spark, sf):
    """Year-month-day dates, anything else null (D-1, D-3)."""
    return roles.raw(spark, sf, "customers").select("customer_id", "signup_date", to_ymd(F.col("signup_date")).cast("string").alias("parsed"))


def m1_numbers(spark, sf):
    """Numbers out of text, whole or not."""
    rows = roles.raw(spark, sf, "sales").select("sale_id", "customer_id", "quantity", "discount").distinct()
    number = to_number(F.col("quantity"))
    return rows.select("sale_id", "customer_id", "quantity", "discount", number.alias("quantity_num"), is_whole(number).alias("quantity_whole"),
                       F.when(F.coalesce(trimmed(F.col("discount")), F.lit("")) == "", F.lit(0.0)).otherwise(to_number(F.col("discount"))).alias("discount_num"))


def n4_json_rows(spark, sf):
    """Parallel arrays in JSON answers as rows (N1, N4): each event becomes an answer with the letters of its type and its number."""
    letters, k = F.filter(F.split("event_type", ""), lambda x: x != ""), F.from_json("props", "k long").getField("k")
    arrays = F.struct(letters.alias("time"), F.transform(letters, lambda x: k).alias("k"))
    answers = roles.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("city"), F.to_json(F.struct(arrays.alias("daily"))).alias("body"))
    return weather.days_of(answers, {"k": "k"}).groupBy(F.col("date").alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k").cast("long")).alias("sum_k"))


def w1_customers(spark, sf):
    """Silver customers: the best row of each id."""
    return _customers(spark, sf).withColumn("signup_date", F.col("signup_date").cast("string"))


def w2_products(spark, sf):
    """Silver products."""
    return _products(spark, sf)


def w3_sales(spark, sf):
    """Silver sales."""
    return cleaning.accepted_sales(_judged(spark, sf)).withColumn("sale_date", F.col("sale_date").cast("string"))


def t12_rejected_sales(spark, sf):
    """Rejected sales with their ordered reasons."""
    return cleaning.rejected_sales(_judged(spark, sf))


def a19_reason_counts(spark, sf):
    """Rejected sales by reason, in reporting order."""
    return cleaning.reason_counts(cleaning.rejected_sales(_judged(spark, sf)))


def f3_split(spark, sf):
    """Clean and rejected counts and the reject rate."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("reject_reasons").isNotNull())
    return _judged(spark, sf).agg(n.alias("judged"), bad.alias("rejected"), (n - bad).alias("accepted"), F.round(bad / n * F.lit(1e6)).cast("long").alias("reject_ppm"))


def w4_weather(spark, sf):
    """Silver weather: the most complete row of each date and city."""
    return _weather(spark, sf).withColumn("date", F.col("date").cast("string"))


def w5_repeated_lines(spark, sf):
    """Rows whose key occurs more than once."""
    rows = roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return repeated(rows, ["l_orderkey", "l_linenumber"]).groupBy("l_linenumber", "is_repeated").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("sum_part"))


def p3_dim_customers(spark, sf):
    """Customer dimension (P3, D-2)."""
    return star.dim_customers(_customers(spark, sf)).withColumn("signup_date", F.col("signup_date").cast("string"))


def p3_dim_products(spark, sf):
    """Product dimension."""
    return star.dim_products(_products(spark, sf))


def m5_dim_weather(spark, sf):
    """Weather dimension with surrogate key and buckets."""
    return star.dim_weather(_weather(spark, sf)).withColumn("date", F.col("date").cast("string"))


def p6_fact_sales(spark, sf):
    """Sales fact with amounts and weather."""
    return _gold(spark, sf)["fact_sales"].withColumn("sale_date", F.col("sale_date").cast("string"))


def a1_mart(spark, sf):
    """Sales by date, city and category with weather."""
    mart = star.mart_of_silver(_silver(spark, sf))
    means = ("avg_temp_c", "avg_precip_mm", "avg_precip_hours")
    return mart.select(F.col("sale_date").cast("string").alias("sale_date"), *[c for c in mart.columns if c not in (*means, "sale_date")], *_round6(*means))


def o3_mart_preview(spark, sf):
    """The first ten rows of the sorted mart of the fact and its dimensions."""
    return first_rows(_gold(spark, sf)[MART]).select(F.col("sale_date").cast("string").alias("sale_date"), "city", "category", "total_units", "num_orders", "total_revenue")


def o4_duplicate_samples(spark, sf):
    """The first ten raw sales whose id occurs again, in the order of their ids."""
    return profile.duplicate_samples(roles.raw(spark, sf, "sales"), "sale_id")


def v13_invariants(spark, sf):
    """Violations of the nine invariants (A10-A12, A24, J6, V13). The fact is computed once: two of its readers are invariants, one the mart."""
    gold = _gold(spark, sf)
    gold["fact_sales"] = stored(gold["fact_sales"], "fact")
    return star.invariants(gold | {MART: star.mart_of(gold)})


def v11_link_counts(spark, sf):
    """Counts over sales and what they refer to."""
    silver = _silver(spark, sf)
    return quality.link_counts(silver["sales"], silver["customers"], silver["products"], silver["weather_daily"])


def a13_profile(spark, sf):
    """Null counts and rule violations of raw sales in one pass."""
    return profile.counts_row("sales", roles.raw(spark, sf, "sales"))


def a14_duplicates(spark, sf):
    """Duplicate rows and keys, and exact cardinalities."""
    return profile.duplicate_counts(roles.raw(spark, sf, "products"), ["product_id"])


def a16_column_facts(spark, sf):
    """Every raw sales column's nulls, different values and ten most frequent ones, from one count of all values."""
    facts = profile.column_facts(roles.raw(spark, sf, "sales"), ["sale_id"]).filter(~F.col("column").isin(profile.ROW, profile.KEY))
    return facts.select("column", "rows", "nulls", "distinct", F.array_join(F.transform("top", lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), "|").alias("top"))


def a18_top_categories(spark, sf):
    """The ten most frequent raw categories."""
    return profile.top_values(roles.raw(spark, sf, "products"), "category", 10)


def a22_digits_in_names(spark, sf):
    """Silver product names that still hold a digit."""
    return quality.names_with_digits(_products(spark, sf))


def a23_row_accounts(spark, sf):
    """Extracted, judged and unpublished rows by dataset (A20, A23, U2). Sales are judged once; of what was judged, counts need only the reasons."""
    silver = stored_together(_referred(spark, sf))
    judged = stored(_judged(spark, sf, silver).select(*_JUDGEMENT), "judged")
    extracted = {name: roles.raw(spark, sf, name) for name in roles.RAW}
    found = accounts(extracted, silver | {"sales": cleaning.accepted_sales(judged)}, {"sales": cleaning.rejected_sales(judged)})
    return found.select("dataset", "extracted", "judged", "unpublished")


def _observed(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]]]:
    """Tables computed once into scratch, and what the gate counts of each, observed meanwhile."""
    seen = {name: Observation() for name in tables}
    kept = stored_together({name: df.observe(seen[name], *[c.alias(k) for k, c in quality.table_counts(name, df).items()]) for name, df in tables.items()})
    return kept, {name: dict(o.get) for name, o in seen.items()}


def _sales(spark: SparkSession, sf: str, known: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected sales, judged once."""
    judged = stored(_judged(spark, sf, known).select(*_JUDGEMENT), "judged")
    return cleaning.accepted_sales(judged), cleaning.rejected_sales(judged)


def v1_gate(spark, sf):
    """The quality gate's blocks of metrics over silver, and what it would block and warn of (V1-V10): one row for each figure."""
    silver, counts = _observed(_referred(spark, sf))
    silver["sales"], rejected = _sales(spark, sf, silver)
    counts["sales"] = quality.counted("sales", silver["sales"])
    report = quality.quality_report(silver, rejected, fail_on_critical=False, counts=counts)
    rows = [(block, name, round(value * 1_000_000)) for block, figures in report["metrics"].items() for name, value in figures.items()]
    rows += [("gate", "critical_failures", 1_000_000 * len(report["critical_failures"])), ("gate", "warnings", 1_000_000 * len(report["warnings"]))]
    return spark.createDataFrame(rows, "block string, figure string, millionths long")


def spoiled(silver: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Silver in which every kind of failure occurs, by fixed rules: repeated customers, products and days, null ids and dates, price
    states that lie, and sales that refer to no one."""
    customers, products, sales, weather = (silver[n] for n in ("customers", "products", "sales", "weather_daily"))
    lie = F.col("product_id") % 7 == 0
    return {
        "customers": customers.unionByName(customers.filter("customer_id % 10 = 0")).withColumn("customer_id", F.when(F.col("customer_id") % 29 != 0, F.col("customer_id"))),
        "products": products.withColumns({"is_price_valid": F.col("is_price_valid") != lie, "product_id": F.when(F.col("product_id") % 31 != 0, F.col("product_id"))}),
        "sales": sales.withColumns({"sale_date": F.when(F.col("sale_id") % 11 != 0, F.col("sale_date")), "customer_id": F.when(F.col("sale_id") % 13 == 0, F.col("customer_id") + 7_000_000).otherwise(F.col("customer_id")),
                                    "sale_id": F.when(F.col("sale_id") % 17 != 0, F.col("sale_id"))}),
        "weather_daily": weather.unionByName(weather.filter("city < 'C'")).withColumn("city", F.when(F.col("city") < "X", F.col("city"))),
    }


def v7_spoiled_gate(spark, sf):
    """What blocks when silver is spoiled in every way, in its order: contracts that break, ids that are null, repeat or refer to no
    one (V1-V7, V10)."""
    silver = stored_together(_referred(spark, sf))
    silver["sales"], rejected = _sales(spark, sf, silver)
    silver, counts = _observed(spoiled(silver))
    report = quality.quality_report(silver, rejected, fail_on_critical=False, counts=counts)
    return spark.createDataFrame([(i + 1, text) for i, text in enumerate(report["critical_failures"])], "place int, failure string")


def j6_orphans(spark, sf):
    """Raw sales that refer to no customer, by an anti join."""
    rows = roles.raw(spark, sf, "sales").select(to_number(F.col("customer_id")).cast("long").alias("customer_id")).filter("customer_id IS NOT NULL")
    return rows.join(_customers(spark, sf).select("customer_id"), "customer_id", "left_anti").groupBy("customer_id").agg(F.count(F.lit(1)).alias("sales"))


QUERIES = {f.__name__: f for f in (
    a1_mart, s4_pruned_scan, t1_tidy_texts, t4_title_case, t6_prices, t15_categories, d1_leet_names, d1_dates, m1_numbers, n4_json_rows, w1_customers, w2_products, w3_sales, t12_rejected_sales,
    a19_reason_counts, f3_split, w4_weather, w5_repeated_lines, p3_dim_customers, p3_dim_products, m5_dim_weather, p6_fact_sales, o3_mart_preview, o4_duplicate_samples, v13_invariants, v1_gate, v7_spoiled_gate, v11_link_counts, a13_profile,
    a14_duplicates, a16_column_facts, a18_top_categories, a22_digits_in_names, a23_row_accounts, j6_orphans,
)}
