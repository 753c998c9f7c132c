"""Rows without a key and hot keys do not meet in one task."""

import pytest
from pyspark.sql import functions as F

from quern.operators import cleaning, quality
from quern.operators.profile import column_facts, profile
from quern.operators.spread import hot_values, left_join


@pytest.fixture
def plain(spark):
    """Shuffled joins as they are planned, without adaptive execution or broadcasts."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sizes(df):
    """Rows by task; the last column is looked at, or the optimizer would leave a join with unique rows out."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(df.columns[-1])).collect()]


def test_null_and_hot_keys_are_spread(spark, plain):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 20 == 0, 7).otherwise(F.col("id"))).alias("k"))  # nine tenths null, half of the rest 7
    others = spark.range(0, 20_000, 2).select(F.col("id").alias("other"), (F.col("id") * 2).alias("v")).union(spark.sql("SELECT 7L, 14L"))
    for hot in ((), (7,)):
        found = left_join(rows, others, {"k": "other"}, hot)
        assert sorted(found.columns) == ["id", "k", "other", "v"] and "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert sum(sizes(found)) == 20_000
        got = {r["k"]: (r["n"], r["v"]) for r in found.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v")).filter("k IS NULL OR k IN (7, 10, 11)").collect()}
        assert got == {None: (18_000, None), 7: (1000, 14), 10: (1, 20)}
        assert max(sizes(found)) < (1.3 if hot else 1.7) * 20_000 / 8


def test_sales_without_a_customer_are_judged_in_many_tasks(spark, plain):
    raw = spark.range(8000).select(F.col("id").cast("string").alias("sale_id"), F.when(F.col("id") % 10 == 0, "1").alias("customer_id"), F.lit("2").alias("product_id"), F.lit("2024-01-01").alias("sale_date"), F.lit("1").alias("quantity"), F.lit("0").alias("discount"))
    customers, products = spark.range(1, 500).withColumnRenamed("id", "customer_id"), spark.range(2, 500).withColumnRenamed("id", "product_id")
    parsed = raw.withColumn("_customer", F.col("customer_id").cast("long"))
    assert max(sizes(cleaning._known(parsed, customers, "_customer", "_has", ()))) < 2 * 8000 / 8
    hot = {"customer_id": [1], "product_id": [2]}
    usual, dealt = (cleaning.judge_sales(raw, customers, products, hot=h).groupBy("reject_reasons").count().collect() for h in (None, hot))
    assert sorted(map(tuple, usual), key=str) == sorted(map(tuple, dealt), key=str) == [("missing_customer_id", 7200), (None, 800)]


def test_hot_values():
    assert hot_values({"a": [("x", 50), ("y", 1)], "b": []}, 100) == {"a": ["x"], "b": []}


def test_a_profile_reads_and_shuffles_once(spark, tmp_path):
    data = [("1", None, "a"), ("1", None, "a"), ("2", "", "b"), (None, "x", "b"), ("3", "x", None)]
    spark.createDataFrame(data, "sale_id string, customer_id string, quantity string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    facts = column_facts(df, ["sale_id"])
    rows = {r["column"]: r for r in facts.collect()}
    assert (rows["customer_id"]["nulls"], rows["customer_id"]["distinct"], [tuple(x) for x in rows["customer_id"]["top"]]) == (2, 2, [("x", 2), ("", 1)])
    plan = facts._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert plan.count("FileScan") == 1 and sum("column#" in x and "value#" in x for x in shuffles) == 1
    found = profile("sales", df)
    assert (found["rows"], found["duplicate_rows"], found["key_duplicates"], found["top"]["quantity"]) == (5, 1, 1, [("a", 2), ("b", 2)])
    empty = profile("sales", df.limit(0))
    assert (empty["rows"], empty["duplicate_rows"], empty["cardinality"]["sale_id"], empty["violations"]["quantity_le_0"]) == (0, 0, 0, 0)


def test_observed_counts_are_those_of_jobs(spark, monkeypatch):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(1, "A1", "c", 5.0, True), (None, None, None, None, True), (3, "B", "c", -1.0, False)], "product_id long, product_name string, category string, price double, is_price_valid boolean")
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in quality.table_counts("products", df).items()]).write.format("noop").mode("overwrite").save()
    assert dict(seen.get) == quality.counted("products", df) == {"rows": 3, "null_product_id": 1, "price_state": 2, "price_le_0": 1, "with_digit": 1}
    monkeypatch.setattr(quality, "counted", None)  # no job where the counts are known
    assert quality.contract_failures("products", df, seen.get) == ["products.silver contract violation: price must be positive when is_price_valid is true and NA otherwise"]
