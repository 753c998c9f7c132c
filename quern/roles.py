"""Raw retail and weather tables made from the benchmark tables by fixed rules, in SQL text that both engines read alike.

Customers, parts, order lines and events play the parts of customers, products, sales and daily weather; modulo rules spoil
ids, names, dates, prices, quantities and discounts in every way that the cleaners handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.sources.settings import CITY_SPELLINGS, LEET

#: Part types in lower case that are canonical, and the spellings mapped to them.
CATEGORIES = {"small": "small goods", "medium": "medium goods", "large": "large goods", "economy": "economy goods", "promo": "promo goods"}
CITIES = {**CITY_SPELLINGS, "uk": "united kingdom"}
LETTERS = dict(LEET)

RAW_CUSTOMERS = """
SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 'C' || CAST(c_custkey AS STRING)
            WHEN c_custkey % 83 = 0 THEN CAST(c_custkey AS STRING) || '.5' WHEN c_custkey % 5 = 0 THEN '  ' || CAST(c_custkey - 1 AS STRING) || ' '
            ELSE CAST(c_custkey AS STRING) END AS customer_id,
       CASE WHEN c_custkey % 13 = 0 THEN '   ' ELSE ' ' || c_mktsegment || '   o''neil ' END AS first_name,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS last_name,
       CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN ' Mad   Rid' ELSE n_name END AS city,
       CASE WHEN c_custkey % 10 = 0 THEN 'A_A_A' WHEN c_custkey % 29 = 0 THEN '2024-01-01 00:00:00' WHEN c_custkey % 31 = 0 THEN '2024-02-30'
            WHEN c_custkey % 6 = 0 THEN '2024/' || CAST(c_custkey % 12 + 1 AS STRING) || '/' || CAST(c_custkey % 28 + 1 AS STRING)
            ELSE '2024-' || CAST(c_custkey % 12 + 1 AS STRING) || '-' || CAST(c_custkey % 28 + 1 AS STRING) END AS signup_date
FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey
"""

RAW_PRODUCTS = """
SELECT CASE WHEN p_partkey % 101 = 0 THEN '' WHEN p_partkey % 103 = 0 THEN 'p-' || CAST(p_partkey AS STRING)
            WHEN p_partkey % 4 = 0 THEN CAST(p_partkey - 1 AS STRING) ELSE CAST(p_partkey AS STRING) || ' ' END AS product_id,
       CASE WHEN p_partkey % 19 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN replace(replace(p_name, 'o', '0'), 'e', '3')
            WHEN p_partkey % 7 = 0 THEN p_name || '  10L' ELSE p_name END AS product_name,
       CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'A/A' WHEN p_partkey % 2 = 0 THEN ' ' || split_part(p_type, ' ', 1) ELSE lower(split_part(p_type, ' ', 1)) END AS category,
       CASE WHEN p_partkey % 37 = 0 THEN 'free' WHEN p_partkey % 41 = 0 THEN '-5' WHEN p_partkey % 43 = 0 THEN NULL
            WHEN p_partkey % 5 = 0 THEN '$' || CAST(p_partkey % 900 + 10 AS STRING) || ',50' WHEN p_partkey % 47 = 0 THEN '1.234,50'
            ELSE CAST(p_partkey % 900 + 10 AS STRING) || '.' || CAST(p_partkey % 90 + 10 AS STRING) || ' EUR' END AS price
FROM {part}
"""

RAW_SALES = """
SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN 'S' || CAST(l_orderkey AS STRING)
            ELSE CAST(l_orderkey * 10 + l_linenumber AS STRING) END AS sale_id,
       CASE WHEN l_suppkey % 53 = 0 THEN ' ' WHEN l_suppkey % 59 = 0 THEN 'x' WHEN l_suppkey % 43 = 0 THEN CAST(o_custkey + 9000000 AS STRING) ELSE CAST(o_custkey AS STRING) END AS customer_id,
       CASE WHEN l_partkey % 61 = 0 THEN CAST(l_partkey + 9000000 AS STRING) WHEN l_partkey % 67 = 0 THEN NULL WHEN l_partkey % 71 = 0 THEN '7.5' ELSE ' ' || CAST(l_partkey AS STRING) END AS product_id,
       CASE WHEN l_orderkey % 43 = 0 THEN 'A_A_A' WHEN l_orderkey % 47 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN '2024/01/' || CAST(day(o_orderdate) AS STRING)
            ELSE '2024-01-' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') END AS sale_date,
       CASE WHEN l_partkey % 41 = 0 THEN 'one' WHEN l_partkey % 73 = 0 THEN '-3' WHEN l_partkey % 79 = 0 THEN '2.5' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity,
       CASE WHEN l_partkey % 83 = 0 THEN '200' WHEN l_partkey % 31 = 0 THEN '' WHEN l_partkey % 29 = 0 THEN 'abc' ELSE CAST(CAST(round(l_discount * 100) AS INT) AS STRING) END AS discount
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

RAW_WEATHER = """
SELECT CASE WHEN event_id % 211 = 0 THEN replace(CAST(CAST(ts AS DATE) AS STRING), '-', '/') ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date,
       CASE WHEN event_id % 2 = 0 THEN lower(n_name) ELSE ' ' || n_name || ' ' END AS city,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(floor(value * 4) AS BIGINT) AS STRING) || 'e-1' END AS temp_c,
       CASE WHEN event_id % 5 = 0 THEN '-1' WHEN event_id % 3 = 0 THEN '0' ELSE CAST(event_id % 40 AS STRING) || 'e-1' END AS precip_mm,
       CASE WHEN event_id % 11 = 0 THEN 'n' ELSE CAST(event_id % 24 AS STRING) END AS precip_hours,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 100 AS STRING) END AS weather_code
FROM {events} JOIN {nation} ON user_id % 25 = n_nationkey
"""

#: Table, query text and the benchmark tables that it reads.
RAW = {
    "customers": (RAW_CUSTOMERS, ("customer", "nation")), "products": (RAW_PRODUCTS, ("part",)),
    "sales": (RAW_SALES, ("lineitem", "orders")), "weather_daily": (RAW_WEATHER, ("events", "nation")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table, all columns text."""
    text, needs = RAW[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needs})


def raw_text(name: str) -> str:
    """The same query over tables that are registered by their own names."""
    text, needs = RAW[name]
    return text.format(**{n: n for n in needs})
