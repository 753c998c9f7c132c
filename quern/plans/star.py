"""Star schema, mart and invariants over silver tables, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import money, to_cents
from quern.functions.text import truthy
from quern.operators.spread import left_join


@dataclass(frozen=True)
class Buckets:
    """Thresholds of the weather buckets."""

    light_rain_lt_mm: float = 2.0
    cold_lt_c: float = 10.0
    mild_lte_c: float = 25.0

    def __post_init__(self):
        if self.light_rain_lt_mm < 0:
            raise ValueError("light_rain_lt_mm must be >= 0")
        if self.cold_lt_c > self.mild_lte_c:
            raise ValueError("cold_lt_c must be <= mild_lte_c")


class InvariantError(Exception):
    """An invariant of the star schema does not hold; nothing was published."""


def dim_customers(silver: DataFrame) -> DataFrame:
    return silver.select(F.col("customer_id").cast("int").alias("customer_id"), "first_name", "last_name", "city", F.col("signup_date").cast("date").alias("signup_date"))


def dim_products(silver: DataFrame) -> DataFrame:
    return silver.select(F.col("product_id").cast("int").alias("product_id"), "product_name", "category", F.col("price").cast("double").alias("price"), truthy(F.col("is_price_valid")).alias("is_price_valid"))


def rain_bucket(mm: Column, b: Buckets) -> Column:
    return F.when(mm.isNull(), "unknown").when(mm == 0, "no_rain").when(mm < b.light_rain_lt_mm, "light_rain").otherwise("heavy_rain")


def temp_bucket(c: Column, b: Buckets) -> Column:
    return F.when(c.isNull(), "unknown").when(c < b.cold_lt_c, "cold").when(c <= b.mild_lte_c, "mild").otherwise("hot")


def dim_weather(silver: DataFrame, buckets: Buckets = Buckets()) -> DataFrame:  # noqa: B008
    """Weather with a surrogate key: the MD5 of `date|city`, null if either is."""
    typed = silver.select(
        F.col("date").cast("date").alias("date"), "city", *[F.col(c).cast("double").alias(c) for c in ("temp_c", "precip_mm", "precip_hours")], F.col("weather_code").cast("int").alias("weather_code"),
    )
    key = F.md5(F.concat(F.col("date").cast("string"), F.lit("|"), F.col("city")).cast("binary"))
    return typed.select(key.alias("weather_sk"), *typed.columns, rain_bucket(F.col("precip_mm"), buckets).alias("rain_bucket"), temp_bucket(F.col("temp_c"), buckets).alias("temp_bucket"))


def _sold(sales: DataFrame, customers: DataFrame, products: DataFrame, weather: DataFrame) -> DataFrame:
    """Each sale that has its customer and product, with what is known of them and of the weather of its date in its
    customer's city (rows without one are spread), and its amounts at the catalogue price (null if it is not valid). Joins carry no hints: the planner
    broadcasts what it finds small."""
    s = sales.select(*[F.col(c).cast("int").alias(c) for c in ("sale_id", "customer_id", "product_id", "quantity")], F.col("sale_date").cast("date").alias("sale_date"), F.col("discount").cast("double").alias("discount"))
    rows = s.join(customers.select("customer_id", "city"), "customer_id").join(products.select("product_id", "category", "price", "is_price_valid"), "product_id")
    days = weather.select("weather_sk", F.col("date").alias("_date"), F.col("city").alias("_city"), *MEASURES)
    rows = left_join(rows, days, {"city": "_city", "sale_date": "_date"})
    total = F.col("quantity") * F.col("price")
    share = F.col("discount") / F.lit(100.0)

    def priced(amount: Column) -> Column:
        return F.when((F.col("is_price_valid") == 1) & F.col("price").isNotNull(), money(amount))

    return rows.select(
        "sale_id", "customer_id", "product_id", "weather_sk", "sale_date", "quantity", "discount", F.col("price").alias("unit_price_at_sale"),
        F.col("weather_sk").isNotNull().cast("int").alias("has_weather_match"), F.coalesce(F.col("is_price_valid") == 1, F.lit(False)).cast("int").alias("has_valid_price"),
        priced(total).alias("gross_amount"), priced(total * share).alias("discount_amount"), priced(total * (F.lit(1.0) - share)).alias("net_amount"), "city", "category", *MEASURES,
    )


#: What the mart shows of the weather.
MEASURES = ("temp_c", "precip_mm", "precip_hours", "rain_bucket", "temp_bucket")


def fact_sales(sales: DataFrame, customers: DataFrame, products: DataFrame, weather: DataFrame) -> DataFrame:
    """One row for each sale that has its customer and product, with amounts and the key of its weather."""
    return _sold(sales, customers, products, weather).drop("city", "category", *MEASURES)


def _by_day(rows: DataFrame) -> DataFrame:
    """Sales of known city by date, city and category. Buckets are null where no weather matched."""
    n_priced = F.sum("has_valid_price")
    net = F.sum(F.when(F.col("has_valid_price") == 1, F.col("net_amount")).otherwise(F.lit(0).cast("decimal(18,2)")))
    return rows.filter(F.col("city").isNotNull()).groupBy("sale_date", "city", "category").agg(
        F.sum("quantity").cast("long").alias("total_units"), F.count(F.lit(1)).alias("num_orders"), n_priced.cast("long").alias("num_orders_priced"),
        net.cast("decimal(38,2)").alias("total_revenue"), to_cents(net.cast("double") / F.nullif(n_priced, F.lit(0)).cast("double")).alias("avg_ticket"),
        F.avg("temp_c").alias("avg_temp_c"), F.avg("precip_mm").alias("avg_precip_mm"), F.avg("precip_hours").alias("avg_precip_hours"),
        to_cents(F.lit(100.0) * n_priced.cast("double") / F.count(F.lit(1)).cast("double")).alias("valid_price_rate"),
        F.max("rain_bucket").alias("rain_bucket"), F.max("temp_bucket").alias("temp_bucket"),  # one value in each group, by the invariants
    )


def weather_sales_mart(fact: DataFrame, customers: DataFrame, products: DataFrame, weather: DataFrame) -> DataFrame:
    """The mart of stored tables: the fact joined with its dimensions again."""
    rows = fact.join(customers.select("customer_id", "city"), "customer_id")
    return _by_day(rows.join(products.select("product_id", "category"), "product_id").join(weather.select("weather_sk", *MEASURES), "weather_sk", "left"))


def mart_of_silver(silver: Mapping[str, DataFrame], buckets: Buckets = Buckets()) -> DataFrame:  # noqa: B008
    """The same mart in one go from silver tables, each of which is read once: the fact's joins know city, category and weather.
    It equals the mart of stored tables where the invariants hold."""
    return _by_day(_sold(silver["sales"], dim_customers(silver["customers"]), dim_products(silver["products"]), dim_weather(silver["weather_daily"], buckets)))


#: The nine invariants, in the order in which they are reported (fixed values).
INVARIANTS = (
    "dim_customers is not unique on customer_id", "dim_products is not unique on product_id", "dim_weather.weather_sk is null", "dim_weather is not unique on weather_sk",
    "dim_weather is not unique on (date, city)", "fact_sales is not unique on sale_id", "fact_sales has orphan customer_id", "fact_sales has orphan product_id", "num_orders_priced exceeds num_orders",
)


def invariants(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(place, invariant, violations): the nine invariants with the number of rows against each, in one plan that reads the fact
    once for all that concerns it."""

    def by_key(df: DataFrame, *keys: str, **more: Column) -> tuple[DataFrame, Column]:
        """Rows combined by key, and how many more rows than distinct non-null keys there are."""
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in more.items()])
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        return groups, F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(known)

    def told(groups: DataFrame, **violations: Column) -> DataFrame:
        """A row for each of the named places (p1 to p9)."""
        row = groups.agg(*[c.cast("long").alias(place) for place, c in violations.items()])
        return row.select(F.explode(F.array(*[F.struct(F.lit(int(p[1:])).alias("place"), F.lit(INVARIANTS[int(p[1:]) - 1]).alias("invariant"), F.coalesce(p, F.lit(0)).alias("violations")) for p in violations])).alias("x")).select("x.*")

    c, p, w, f, m = (tables[k] for k in ("dim_customers", "dim_products", "dim_weather", "fact_sales", "weather_sales_mart"))
    sales = f.select("sale_id", "customer_id", "product_id")
    for key, dim, mark in (("customer_id", c, "no_customer"), ("product_id", p, "no_product")):
        ids = dim.select(F.col(key).alias("known")).filter(F.col("known").isNotNull()).distinct()
        sales = sales.join(ids, F.col(key) == F.col("known"), "left").withColumn(mark, F.col("known").isNull()).drop("known")
    customers, one = by_key(c, "customer_id")
    products, two = by_key(p, "product_id")
    keys, four = by_key(w, "weather_sk")
    days, five = by_key(w, "date", "city")
    facts, six = by_key(sales, "sale_id", no_customer=F.count_if("no_customer"), no_product=F.count_if("no_product"))
    parts = [
        told(customers, p1=one), told(products, p2=two), told(keys, p3=F.sum(F.when(F.col("weather_sk").isNull(), F.col("n"))), p4=four), told(days, p5=five),
        told(facts, p6=six, p7=F.sum("no_customer"), p8=F.sum("no_product")), told(m, p9=F.count_if(F.col("num_orders_priced") > F.col("num_orders"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def require(tables: Mapping[str, DataFrame]) -> None:
    """Raise InvariantError with the first invariant that does not hold."""
    broken = [r for r in invariants(tables).collect() if r["violations"]]  # nine rows
    if broken:
        raise InvariantError(f"INVARIANT: {min(broken, key=lambda r: r['place'])['invariant']}")


def build(silver: Mapping[str, DataFrame], buckets: Buckets = Buckets()) -> dict[str, DataFrame]:  # noqa: B008
    """All gold tables from silver ones (customers, products, sales, weather_daily)."""
    customers, products, weather = dim_customers(silver["customers"]), dim_products(silver["products"]), dim_weather(silver["weather_daily"], buckets)
    fact = fact_sales(silver["sales"], customers, products, weather)
    gold = {"dim_customers": customers, "dim_products": products, "dim_weather": weather, "fact_sales": fact}
    return gold | {"weather_sales_mart": mart_of(gold)}


def mart_of(gold: Mapping[str, DataFrame]) -> DataFrame:
    """The mart of the other gold tables."""
    return weather_sales_mart(gold["fact_sales"], gold["dim_customers"], gold["dim_products"], gold["dim_weather"])
