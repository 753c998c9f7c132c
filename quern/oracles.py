"""The catalogue's queries as DuckDB SQL, written from the rules and not from the Spark plans."""

from __future__ import annotations

from quern import roles
from quern.operators.cleaning import REASONS


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def tidy(x: str) -> str:
    return f"nullif({squeeze(f'lower({trim(x)})')}, '')"


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda r: upper(r[1]) || lower(r[2:])), '')"


def number(x: str) -> str:
    return f"CASE WHEN regexp_full_match({trim(x)}, '(?i)[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?|inf|infinity)') THEN TRY_CAST({trim(x)} AS DOUBLE) END"


def price(x: str) -> str:
    digits = f"replace(regexp_replace({trim(x)}, '[^0-9,.\\-]', '', 'g'), ',', '.')"
    return number(digits)


def whole(n: str) -> str:
    return f"coalesce(NOT isinf({n}) AND ({n}) % 1 = 0, false)"


def day(x: str) -> str:
    t = trim(x)
    return (f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) "
            f"WHEN regexp_full_match({t}, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN TRY_CAST(try_strptime({t}, '%Y/%m/%d') AS DATE) END")


def mapped(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in table.items()) + f" ELSE {x} END"


def category(x: str) -> str:
    known = ", ".join(_quote(v) for v in sorted({*roles.CATEGORIES.values(), "unknown"}))
    m = mapped(x, roles.CATEGORIES)
    return title(f"(CASE WHEN {m} IN ({known}) THEN {m} ELSE 'unknown' END)")


def leet(x: str) -> str:
    """The fold over a word's characters; the state is the rewritten prefix, whose length gives the place."""
    swap = mapped("ch", roles.LETTERS)
    step = f"acc || CASE WHEN regexp_matches(right(acc, 1), '\\p{{L}}') OR regexp_matches(substr(w, length(acc) + 2, 1), '\\p{{L}}') THEN {swap} ELSE ch END"
    word = f"CASE WHEN w = '' OR regexp_matches(w, '^\\p{{Nd}}|\\p{{Nd}}$') THEN w ELSE list_reduce(list_prepend('', string_split(w, '')), lambda acc, ch: {step}) END"
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: {word}), ' ')"


def cents(x: str) -> str:
    return f"round(({x}) * 100.0::DOUBLE) / 100.0::DOUBLE"


def _raw(*names: str) -> str:
    return ", ".join(f"raw_{n} AS ({roles.raw_text(n)})" for n in names)


_CUSTOMERS = f"""
customers_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY (c IS NOT NULL)::INT + (d IS NOT NULL)::INT + (f IS NOT NULL)::INT + (l IS NOT NULL)::INT DESC, d DESC NULLS LAST,
    customer_id NULLS LAST, first_name NULLS LAST, last_name NULLS LAST, city NULLS LAST, signup_date NULLS LAST) AS rn
  FROM (SELECT *, ({number('customer_id')})::BIGINT AS id, {tidy('city')} AS c, {tidy('first_name')} AS f, {tidy('last_name')} AS l, {day('signup_date')} AS d
        FROM raw_customers WHERE {whole(number('customer_id'))})),
customers_silver AS (
  SELECT id AS customer_id, {title('f')} AS first_name, {title('l')} AS last_name, {title(mapped('c', roles.CITIES))} AS city, d AS signup_date FROM customers_ranked WHERE rn = 1)
"""

_PRODUCTS = f"""
products_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY (n IS NOT NULL)::INT + (c IS NOT NULL)::INT + coalesce(p > 0, false)::INT DESC, p DESC NULLS LAST,
    product_id NULLS LAST, product_name NULLS LAST, category NULLS LAST, price NULLS LAST) AS rn
  FROM (SELECT *, ({number('product_id')})::BIGINT AS id, nullif({leet(squeeze(trim('product_name')))}, '') AS n, {tidy('category')} AS c, {price('price')} AS p
        FROM raw_products WHERE {whole(number('product_id'))})),
products_silver AS (
  SELECT id AS product_id, {title('n')} AS product_name, {category('c')} AS category, CASE WHEN p > 0 THEN p END AS price, coalesce(p > 0, false) AS is_price_valid FROM products_ranked WHERE rn = 1)
"""

_JUDGED = f"""
sales_parsed AS (
  SELECT *, {number('sale_id')} AS s, {number('customer_id')} AS c, {number('product_id')} AS p, {day('sale_date')} AS d, {number('quantity')} AS q,
    coalesce({trim('sale_id')}, '') = '' AS no_s, coalesce({trim('customer_id')}, '') = '' AS no_c, coalesce({trim('product_id')}, '') = '' AS no_p,
    CASE WHEN coalesce({trim('discount')}, '') = '' THEN 0.0::DOUBLE ELSE {number('discount')} END AS disc FROM raw_sales),
sales_flagged AS (
  SELECT *, NOT no_s AND NOT {whole('s')} AS bad_s, NOT no_c AND NOT {whole('c')} AS bad_c, NOT no_p AND NOT {whole('p')} AS bad_p,
    c IN (SELECT customer_id::DOUBLE FROM customers_silver) IS TRUE AS has_c, p IN (SELECT product_id::DOUBLE FROM products_silver) IS TRUE AS has_p,
    coalesce({whole('q')} AND q > 0, false) AS has_q, coalesce(disc BETWEEN 0 AND 100, false) AS has_disc FROM sales_parsed),
sales_best AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY s::BIGINT ORDER BY
      (d IS NOT NULL)::INT + has_q::INT + has_disc::INT + (NOT bad_c AND has_c)::INT + (NOT bad_p AND has_p)::INT DESC, d DESC NULLS LAST,
      sale_id NULLS LAST, customer_id NULLS LAST, product_id NULLS LAST, sale_date NULLS LAST, quantity NULLS LAST, discount NULLS LAST) AS rn
    FROM sales_flagged WHERE NOT no_s AND NOT bad_s) WHERE rn = 1
  UNION ALL SELECT * FROM sales_flagged WHERE no_s OR bad_s),
judged AS (
  SELECT *, nullif(concat_ws('|', {", ".join(f"CASE WHEN {test} THEN '{reason}' END" for reason, test in zip(REASONS, (
    "no_s", "bad_s", "no_c", "bad_c", "no_p", "bad_p", "d IS NULL", "NOT no_c AND NOT bad_c AND NOT has_c", "NOT no_p AND NOT bad_p AND NOT has_p", "NOT has_q", "disc IS NULL", "disc < 0 OR disc > 100"), strict=True))}), '') AS reject_reasons
  FROM sales_best),
sales_silver AS (
  SELECT s::BIGINT AS sale_id, c::BIGINT AS customer_id, p::BIGINT AS product_id, d AS sale_date, q::BIGINT AS quantity, disc AS discount FROM judged WHERE reject_reasons IS NULL)
"""

_WEATHER = f"""
weather_silver AS (
  SELECT d AS date, c AS city, t AS temp_c, m AS precip_mm, h AS precip_hours, w AS weather_code FROM (
    SELECT *, row_number() OVER (PARTITION BY d, c ORDER BY (t IS NOT NULL)::INT + (m IS NOT NULL)::INT + (h IS NOT NULL)::INT + (w IS NOT NULL)::INT DESC,
      date NULLS LAST, city NULLS LAST, temp_c NULLS LAST, precip_mm NULLS LAST, precip_hours NULLS LAST, weather_code NULLS LAST) AS rn
    FROM (SELECT *, {day('date')} AS d, {title(f"lower({squeeze(trim('city'))})")} AS c, {number('temp_c')} AS t, CASE WHEN {number('precip_mm')} >= 0 THEN {number('precip_mm')} END AS m,
            {number('precip_hours')} AS h, ({number('weather_code')})::INT AS w FROM raw_weather_daily)) WHERE rn = 1)
"""

_SILVER = f"{_raw('customers', 'products', 'sales', 'weather_daily')}, {_CUSTOMERS}, {_PRODUCTS}, {_JUDGED}, {_WEATHER}"

_GOLD = f"""
{_SILVER},
dim_customers AS (SELECT customer_id::INT AS customer_id, first_name, last_name, city, signup_date FROM customers_silver),
dim_products AS (SELECT product_id::INT AS product_id, product_name, category, price, is_price_valid::INT AS is_price_valid FROM products_silver),
dim_weather AS (
  SELECT md5(CAST(date AS VARCHAR) || '|' || city) AS weather_sk, *,
    CASE WHEN precip_mm IS NULL THEN 'unknown' WHEN precip_mm = 0 THEN 'no_rain' WHEN precip_mm < 2 THEN 'light_rain' ELSE 'heavy_rain' END AS rain_bucket,
    CASE WHEN temp_c IS NULL THEN 'unknown' WHEN temp_c < 10 THEN 'cold' WHEN temp_c <= 25 THEN 'mild' ELSE 'hot' END AS temp_bucket FROM weather_silver),
fact_sales AS (
  SELECT s.sale_id::INT AS sale_id, c.customer_id, p.product_id, w.weather_sk, s.sale_date, s.quantity::INT AS quantity, s.discount, p.price AS unit_price_at_sale,
    (w.weather_sk IS NOT NULL)::INT AS has_weather_match, (p.is_price_valid = 1)::INT AS has_valid_price,
    CASE WHEN p.is_price_valid = 1 THEN CAST({cents('s.quantity * p.price')} AS DECIMAL(18,2)) END AS gross_amount,
    CASE WHEN p.is_price_valid = 1 THEN CAST({cents('(s.quantity * p.price) * (s.discount / 100.0::DOUBLE)')} AS DECIMAL(18,2)) END AS discount_amount,
    CASE WHEN p.is_price_valid = 1 THEN CAST({cents('(s.quantity * p.price) * (1.0::DOUBLE - s.discount / 100.0::DOUBLE)')} AS DECIMAL(18,2)) END AS net_amount
  FROM sales_silver s JOIN dim_customers c ON s.customer_id = c.customer_id JOIN dim_products p ON s.product_id = p.product_id
  LEFT JOIN dim_weather w ON w.date = s.sale_date AND w.city = c.city),
mart AS (
  SELECT f.sale_date, c.city, p.category, SUM(f.quantity)::BIGINT AS total_units, COUNT(*) AS num_orders, SUM(f.has_valid_price)::BIGINT AS num_orders_priced,
    SUM(CASE WHEN f.has_valid_price = 1 THEN f.net_amount ELSE 0 END)::DECIMAL(38,2) AS total_revenue,
    {cents("SUM(CASE WHEN f.has_valid_price = 1 THEN f.net_amount ELSE 0 END)::DECIMAL(38,2)::DOUBLE / nullif(SUM(f.has_valid_price), 0)::DOUBLE")} AS avg_ticket,
    round(AVG(w.temp_c) * 1e6)::BIGINT AS avg_temp_c, round(AVG(w.precip_mm) * 1e6)::BIGINT AS avg_precip_mm, round(AVG(w.precip_hours) * 1e6)::BIGINT AS avg_precip_hours,
    {cents('100.0::DOUBLE * SUM(f.has_valid_price)::DOUBLE / COUNT(*)::DOUBLE')} AS valid_price_rate, ANY_VALUE(w.rain_bucket) AS rain_bucket, ANY_VALUE(w.temp_bucket) AS temp_bucket
  FROM fact_sales f JOIN dim_customers c USING (customer_id) JOIN dim_products p USING (product_id) LEFT JOIN dim_weather w ON f.weather_sk = w.weather_sk
  WHERE c.city IS NOT NULL GROUP BY ALL)
"""


def _text_date(column: str, source: str) -> str:
    return f"SELECT * REPLACE (CAST({column} AS VARCHAR) AS {column}) FROM {source}"


_JUDGED_ALL = f"WITH {_raw('customers', 'products', 'sales')}, {_CUSTOMERS}, {_PRODUCTS}, {_JUDGED}"
_RANKS = ", ".join(f"('{r}', {i + 1})" for i, r in enumerate(REASONS))
_INVARIANTS = [
    ("dim_customers is not unique on customer_id", "SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM dim_customers"), ("dim_products is not unique on product_id", "SELECT COUNT(*) - COUNT(DISTINCT product_id) FROM dim_products"),
    ("dim_weather.weather_sk is null", "SELECT COUNT(*) FROM dim_weather WHERE weather_sk IS NULL"), ("dim_weather is not unique on weather_sk", "SELECT COUNT(*) - COUNT(DISTINCT weather_sk) FROM dim_weather"),
    ("dim_weather is not unique on (date, city)", "SELECT COUNT(*) - COUNT(DISTINCT CAST(date AS VARCHAR) || '|' || city) FROM dim_weather"), ("fact_sales is not unique on sale_id", "SELECT COUNT(*) - COUNT(DISTINCT sale_id) FROM fact_sales"),
    ("fact_sales has orphan customer_id", "SELECT COUNT(*) FROM fact_sales f LEFT JOIN dim_customers c USING (customer_id) WHERE c.customer_id IS NULL"),
    ("fact_sales has orphan product_id", "SELECT COUNT(*) FROM fact_sales f LEFT JOIN dim_products p USING (product_id) WHERE p.product_id IS NULL"), ("num_orders_priced exceeds num_orders", "SELECT COUNT(*) FROM mart WHERE num_orders_priced > num_orders"),
]

#: The gate's figures over silver, by block (the last two count what it blocks and warns of).
_GATE = {
    ("rows", "customers"): "SELECT COUNT(*) FROM customers_silver", ("rows", "products"): "SELECT COUNT(*) FROM products_silver", ("rows", "sales_clean"): "SELECT COUNT(*) FROM sales_silver",
    ("rows", "sales_rejected"): "SELECT COUNT(reject_reasons) FROM judged", ("rows", "weather"): "SELECT COUNT(*) FROM weather_silver",
    ("customers", "null_customer_id"): "SELECT COUNT(*) - COUNT(customer_id) FROM customers_silver", ("customers", "dup_customer_id"): "SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM customers_silver",
    ("products", "null_product_id"): "SELECT COUNT(*) - COUNT(product_id) FROM products_silver", ("products", "dup_product_id"): "SELECT COUNT(*) - COUNT(DISTINCT product_id) FROM products_silver",
    ("products", "invalid_price_le_0"): "SELECT COUNT(*) FILTER (price <= 0) FROM products_silver", ("products", "digits_in_name"): "SELECT COUNT(*) FILTER (regexp_matches(product_name, '\\d')) FROM products_silver",
    ("sales", "null_sale_id"): "SELECT COUNT(*) - COUNT(sale_id) FROM sales_silver", ("sales", "dup_sale_id"): "SELECT COUNT(*) - COUNT(DISTINCT sale_id) FROM sales_silver",
    ("sales", "invalid_qty"): "SELECT COUNT(*) FILTER (quantity IS NULL OR quantity <= 0) FROM sales_silver", ("sales", "invalid_disc"): "SELECT COUNT(*) FILTER (discount IS NULL OR discount < 0 OR discount > 100) FROM sales_silver",
    ("sales", "unknown_cust_fk"): "SELECT COUNT(*) FILTER (no_customer) FROM linked", ("sales", "unknown_prod_fk"): "SELECT COUNT(*) FILTER (no_product) FROM linked",
    ("sales", "reject_rate"): "SELECT COUNT(reject_reasons)::DOUBLE / COUNT(*)::DOUBLE FROM judged", ("sales", "max_reject_rate"): "SELECT 0.45::DOUBLE",
    ("weather", "null_weather_date"): "SELECT COUNT(*) - COUNT(date) FROM weather_silver", ("weather", "dup_weather_key"): "SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT date, city FROM weather_silver)) FROM weather_silver",
    ("weather", "neg_precip"): "SELECT COUNT(*) FILTER (precip_mm < 0) FROM weather_silver", ("weather", "sales_with_unknown_city"): "SELECT COUNT(*) FILTER (no_city) FROM linked",
    ("weather", "unknown_city_rate"): "SELECT COUNT(*) FILTER (no_city)::DOUBLE / COUNT(*)::DOUBLE FROM linked", ("weather", "eligible_sales_for_weather_match"): "SELECT COUNT(*) FILTER (NOT no_city) FROM linked",
    ("weather", "sales_with_no_weather_match"): "SELECT COUNT(*) FILTER (NOT no_city AND no_weather) FROM linked",
    ("weather", "weather_coverage_rate"): "SELECT COUNT(*) FILTER (NOT no_city AND NOT no_weather)::DOUBLE / COUNT(*) FILTER (NOT no_city)::DOUBLE FROM linked",
    ("weather", "missing_valid_price_rows"): "SELECT COUNT(*) FILTER (no_price) FROM linked", ("weather", "price_coverage_rate"): "SELECT COUNT(*) FILTER (NOT no_price)::DOUBLE / COUNT(*)::DOUBLE FROM linked",
    ("weather", "min_valid_price_coverage"): "SELECT 0.9::DOUBLE", ("weather", "max_unknown_city_rate"): "SELECT 0.08::DOUBLE",
}
_LINKED = """linked AS (
  SELECT c.customer_id IS NULL AS no_customer, p.product_id IS NULL AS no_product, c.city IS NULL AS no_city, w.date IS NULL AS no_weather, NOT coalesce(p.price > 0, false) AS no_price
  FROM sales_silver s LEFT JOIN customers_silver c ON s.customer_id = c.customer_id LEFT JOIN products_silver p ON s.product_id = p.product_id
  LEFT JOIN (SELECT DISTINCT date, city FROM weather_silver) w ON w.date = s.sale_date AND w.city = c.city)"""
_V1 = f"""WITH {_SILVER}, {_LINKED},
figures AS ({" UNION ALL ".join(f"SELECT '{block}' AS block, '{figure}' AS figure, ({sql})::DOUBLE AS v" for (block, figure), sql in _GATE.items())}),
one AS (SELECT figure, max(v) AS v FROM figures GROUP BY figure)
SELECT block, figure, round(v * 1e6)::BIGINT AS millionths FROM figures
UNION ALL SELECT 'gate', 'critical_failures', 1000000 * (SELECT COUNT(*) FROM figures WHERE v > 0 AND figure IN ('null_sale_id', 'dup_sale_id', 'null_customer_id', 'dup_customer_id', 'null_product_id', 'dup_product_id', 'unknown_cust_fk', 'unknown_prod_fk'))
  + 1000000 * (SELECT (COUNT(*) FILTER (sale_date IS NULL) > 0)::INT FROM sales_silver) + 1000000 * (SELECT (COUNT(*) FILTER (date IS NULL) > 0)::INT + (COUNT(*) FILTER (city IS NULL) > 0)::INT FROM weather_silver)
  + 1000000 * (SELECT (v > 0)::INT FROM one WHERE figure = 'dup_weather_key')
UNION ALL SELECT 'gate', 'warnings', 1000000 * ((SELECT v FROM one WHERE figure = 'reject_rate') > 0.45)::INT + 1000000 * ((SELECT v FROM one WHERE figure = 'unknown_city_rate') > 0.08)::INT
  + 1000000 * ((SELECT v FROM one WHERE figure = 'sales_with_no_weather_match') > 0)::INT + 1000000 * ((SELECT v FROM one WHERE figure = 'price_coverage_rate') < 0.9)::INT
  + 1000000 * ((SELECT v FROM one WHERE figure = 'digits_in_name') > 0)::INT"""

_SPOILED = """
spoiled_customers AS (SELECT CASE WHEN customer_id % 29 <> 0 THEN customer_id END AS customer_id FROM (SELECT customer_id FROM customers_silver UNION ALL SELECT customer_id FROM customers_silver WHERE customer_id % 10 = 0)),
spoiled_products AS (SELECT CASE WHEN product_id % 31 <> 0 THEN product_id END AS product_id, price, is_price_valid <> (product_id % 7 = 0) AS is_price_valid FROM products_silver),
spoiled_sales AS (SELECT CASE WHEN sale_id % 17 <> 0 THEN sale_id END AS sale_id, CASE WHEN sale_id % 13 = 0 THEN customer_id + 7000000 ELSE customer_id END AS customer_id, product_id, CASE WHEN sale_id % 11 <> 0 THEN sale_date END AS sale_date FROM sales_silver),
spoiled_weather AS (SELECT date, CASE WHEN city < 'X' THEN city END AS city FROM (SELECT * FROM weather_silver UNION ALL SELECT * FROM weather_silver WHERE city < 'C'))"""
#: What blocks over spoiled silver, in its order: text, count, and whether the count is shown.
_BLOCKED = [
    ("null sale_id after cleaning", "SELECT COUNT(*) - COUNT(sale_id) FROM spoiled_sales", True), ("duplicated sale_id after cleaning", "SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT sale_id FROM spoiled_sales)) FROM spoiled_sales", True),
    ("null customer_id after cleaning", "SELECT COUNT(*) - COUNT(customer_id) FROM spoiled_customers", True), ("duplicated customer_id", "SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT customer_id FROM spoiled_customers)) FROM spoiled_customers", True),
    ("null product_id after cleaning", "SELECT COUNT(*) - COUNT(product_id) FROM spoiled_products", True), ("duplicated product_id", "SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT product_id FROM spoiled_products)) FROM spoiled_products", True),
    ("orphan customer_id in sales", "SELECT COUNT(*) FROM spoiled_sales s WHERE NOT EXISTS (SELECT 1 FROM spoiled_customers c WHERE c.customer_id = s.customer_id)", True),
    ("orphan product_id in sales", "SELECT COUNT(*) FROM spoiled_sales s WHERE NOT EXISTS (SELECT 1 FROM spoiled_products p WHERE p.product_id = s.product_id)", True),
    ("products.silver contract violation: price must be positive when is_price_valid is true and NA otherwise", "SELECT COUNT(*) FROM spoiled_products WHERE (is_price_valid AND NOT coalesce(price > 0, false)) OR (NOT is_price_valid AND price IS NOT NULL)", False),
    ("sales.silver contract violation: sale_date must not contain nulls", "SELECT COUNT(*) - COUNT(sale_date) FROM spoiled_sales", False),
    ("weather_daily.silver contract violation: date must not contain nulls", "SELECT COUNT(*) - COUNT(date) FROM spoiled_weather", False), ("weather_daily.silver contract violation: city must not contain nulls", "SELECT COUNT(*) - COUNT(city) FROM spoiled_weather", False),
    ("weather_daily.silver contract violation: (date, city) must be unique", "SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT date, city FROM spoiled_weather)) FROM spoiled_weather", False),
]
_V7 = f"""WITH {_SILVER}, {_SPOILED},
counts AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{text}' || {f"' (' || ({sql}) || ')'" if shown else "''"} AS failure, ({sql}) AS n" for i, (text, sql, shown) in enumerate(_BLOCKED))})
SELECT row_number() OVER (ORDER BY i)::INT AS place, failure FROM counts WHERE n > 0"""

_SALES_COLUMNS = ("sale_id", "customer_id", "product_id", "sale_date", "quantity", "discount")
_FACTS = " UNION ALL ".join(f"""SELECT '{c}' AS column, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS distinct,
  (SELECT string_agg(v || '=' || n, '|' ORDER BY n DESC, v) FROM (SELECT {c} AS v, COUNT(*) AS n FROM raw_sales WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top FROM raw_sales""".replace("AS column,", 'AS "column",').replace("AS distinct,", 'AS "distinct",') for c in _SALES_COLUMNS)

ORACLES = {
    "a16_column_facts": f"WITH {_raw('sales')} {_FACTS}",
    "v7_spoiled_gate": _V7,
    "a1_mart": f"WITH {_GOLD} {_text_date('sale_date', 'mart')}",
    "s4_pruned_scan": f"SELECT l_orderkey::INT AS order_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped, CAST({cents('l_extendedprice * (1.0::DOUBLE - l_discount)')} AS DECIMAL(18,2)) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount > 0.05::DOUBLE",
    "t1_tidy_texts": f"SELECT doc_id, md5(t) AS tidy_md5, length(t)::INT AS n_chars FROM (SELECT doc_id, {tidy('t')} AS t FROM (SELECT doc_id, chr(32) || chr(9) || text || chr(10) || chr(32) AS t FROM documents))",
    "t4_title_case": f"WITH {_raw('customers')} SELECT last_name, {title(tidy('first_name'))} AS first_title, {title(mapped(tidy('city'), roles.CITIES))} AS city_title FROM raw_customers",
    "t6_prices": f"WITH {_raw('products')} SELECT product_id, price, {price('price')} AS parsed, CASE WHEN {price('price')} > 0 THEN {price('price')} END AS valid FROM raw_products",
    "t15_categories": f"WITH {_raw('products')} SELECT product_id, category, {category(tidy('category'))} AS canonical FROM raw_products",
    "d1_leet_names": f"WITH {_raw('products')} SELECT product_id, product_name, {leet(squeeze(trim('product_name')))} AS plain FROM raw_products",
    "d1_dates": f"WITH {_raw('customers')} SELECT customer_id, signup_date, CAST({day('signup_date')} AS VARCHAR) AS parsed FROM raw_customers",
    "m1_numbers": f"WITH {_raw('sales')} SELECT *, {number('quantity')} AS quantity_num, {whole(number('quantity'))} AS quantity_whole, CASE WHEN coalesce({trim('discount')}, '') = '' THEN 0.0::DOUBLE ELSE {number('discount')} END AS discount_num FROM (SELECT DISTINCT sale_id, customer_id, quantity, discount FROM raw_sales)",
    "n4_json_rows": "SELECT letter, COUNT(*) AS n, SUM(k)::BIGINT AS sum_k FROM (SELECT CAST(props->>'$.k' AS BIGINT) AS k, unnest(string_split(event_type, '')) AS letter FROM events) WHERE letter <> '' GROUP BY letter",
    "w1_customers": f"WITH {_raw('customers')}, {_CUSTOMERS} {_text_date('signup_date', 'customers_silver')}",
    "w2_products": f"WITH {_raw('products')}, {_PRODUCTS} SELECT * FROM products_silver",
    "w3_sales": f"{_JUDGED_ALL} {_text_date('sale_date', 'sales_silver')}",
    "t12_rejected_sales": f"{_JUDGED_ALL} SELECT sale_id, customer_id, product_id, sale_date, quantity, discount, reject_reasons FROM judged WHERE reject_reasons IS NOT NULL",
    "a19_reason_counts": f"{_JUDGED_ALL} SELECT reason, rank::INT AS rank, COUNT(*) AS rejected FROM (SELECT unnest(string_split(reject_reasons, '|')) AS reason FROM judged WHERE reject_reasons IS NOT NULL) JOIN (VALUES {_RANKS}) AS r(reason, rank) USING (reason) GROUP BY ALL ORDER BY rank",
    "f3_split": f"{_JUDGED_ALL} SELECT COUNT(*) AS judged, COUNT(reject_reasons) AS rejected, COUNT(*) - COUNT(reject_reasons) AS accepted, round(COUNT(reject_reasons)::DOUBLE / COUNT(*)::DOUBLE * 1e6)::BIGINT AS reject_ppm FROM judged",
    "w4_weather": f"WITH {_raw('weather_daily')}, {_WEATHER} {_text_date('date', 'weather_silver')}",
    "w5_repeated_lines": "SELECT l_linenumber, is_repeated, COUNT(*) AS n, SUM(l_partkey)::BIGINT AS sum_part FROM (SELECT l_linenumber, l_partkey, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_repeated FROM lineitem) GROUP BY ALL",
    "p3_dim_customers": f"WITH {_GOLD} {_text_date('signup_date', 'dim_customers')}",
    "p3_dim_products": f"WITH {_GOLD} SELECT * FROM dim_products",
    "m5_dim_weather": f"WITH {_GOLD} {_text_date('date', 'dim_weather')}",
    "p6_fact_sales": f"WITH {_GOLD} {_text_date('sale_date', 'fact_sales')}",
    "o3_mart_preview": f"WITH {_GOLD} SELECT CAST(sale_date AS VARCHAR) AS sale_date, city, category, total_units, num_orders, total_revenue FROM mart ORDER BY sale_date, city, category LIMIT 10",
    "o4_duplicate_samples": f"WITH {_raw('sales')} SELECT * EXCLUDE (times) FROM (SELECT *, COUNT(*) OVER (PARTITION BY sale_id) AS times FROM raw_sales WHERE sale_id IS NOT NULL) WHERE times > 1 ORDER BY sale_id, customer_id NULLS LAST, product_id NULLS LAST, sale_date NULLS LAST, quantity NULLS LAST, discount NULLS LAST LIMIT 10",
    "v1_gate": _V1,
    "v13_invariants": f"WITH {_GOLD} " + " UNION ALL ".join(f"SELECT {i + 1}::INT AS place, '{t}' AS invariant, ({q})::BIGINT AS violations" for i, (t, q) in enumerate(_INVARIANTS)),
    "v11_link_counts": f"""WITH {_SILVER} SELECT COUNT(*) FILTER (c.customer_id IS NULL) AS unknown_cust_fk, COUNT(*) FILTER (p.product_id IS NULL) AS unknown_prod_fk,
        COUNT(*) FILTER (c.city IS NULL) AS sales_with_unknown_city, COUNT(*) FILTER (c.city IS NOT NULL) AS eligible_sales_for_weather_match,
        COUNT(*) FILTER (c.city IS NOT NULL AND w.date IS NULL) AS sales_with_no_weather_match, COUNT(*) FILTER (NOT coalesce(p.price > 0, false)) AS missing_valid_price_rows
        FROM sales_silver s LEFT JOIN customers_silver c ON s.customer_id = c.customer_id LEFT JOIN products_silver p ON s.product_id = p.product_id
        LEFT JOIN (SELECT DISTINCT date, city FROM weather_silver) w ON w.date = s.sale_date AND w.city = c.city""",
    "a13_profile": f"WITH {_raw('sales')} SELECT COUNT(*) AS n, " + ", ".join(f"COUNT(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("sale_id", "customer_id", "product_id", "sale_date", "quantity", "discount"))
        + f", COUNT(*) FILTER ({number('quantity')} <= 0) AS quantity_le_0, COUNT(*) FILTER ({number('discount')} < 0 OR {number('discount')} > 100) AS discount_out_of_range, COUNT(*) FILTER ({trim('sale_date')} <> '' AND {day('sale_date')} IS NULL) AS sale_date_unparsed FROM raw_sales",
    "a14_duplicates": f"WITH {_raw('products')} SELECT COUNT(DISTINCT product_id) AS distinct_product_id, COUNT(DISTINCT product_name) AS distinct_product_name, COUNT(DISTINCT category) AS distinct_category, COUNT(DISTINCT price) AS distinct_price, (COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw_products)))::BIGINT AS duplicate_rows, (COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT product_id FROM raw_products)))::BIGINT AS duplicate_keys FROM raw_products",
    "a18_top_categories": f"WITH {_raw('products')} SELECT category AS value, COUNT(*) AS rows FROM raw_products WHERE category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "a22_digits_in_names": f"WITH {_raw('products')}, {_PRODUCTS} SELECT COUNT(*) FILTER (regexp_matches(product_name, '\\d')) AS with_digit, COUNT(*) AS products FROM products_silver",
    "a23_row_accounts": f"WITH {_SILVER} " + " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, (SELECT COUNT(*) FROM raw_{n}) AS extracted, (SELECT COUNT(*) FROM {t}) AS judged, (SELECT COUNT(*) FROM raw_{n}) - (SELECT COUNT(*) FROM {t}) AS unpublished"
        for n, t in (("customers", "customers_silver"), ("products", "products_silver"), ("sales", "judged"), ("weather_daily", "weather_silver"))),
    "j6_orphans": f"WITH {_raw('customers', 'sales')}, {_CUSTOMERS} SELECT id AS customer_id, COUNT(*) AS sales FROM (SELECT ({number('customer_id')})::BIGINT AS id FROM raw_sales) WHERE id IS NOT NULL AND id NOT IN (SELECT customer_id FROM customers_silver) GROUP BY 1",
}
