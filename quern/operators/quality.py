"""The quality gate over silver tables: contracts, metrics, blocking failures and warnings."""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.spread import left_join

log = logging.getLogger("quern.quality")

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)
TEXT, FLAG, DATES = (T.StringType,), (T.BooleanType,), (T.DateType, T.TimestampType, T.TimestampNTZType)
_KIND = {INTEGERS: "integer-like", NUMBERS: "numeric", TEXT: "text-like", FLAG: "boolean-like", DATES: "datetime-like"}

#: Type family of each silver column, in the published order.
CONTRACTS = {
    "customers": {"customer_id": INTEGERS, "first_name": TEXT, "last_name": TEXT, "city": TEXT, "signup_date": DATES},
    "products": {"product_id": INTEGERS, "product_name": TEXT, "category": TEXT, "price": NUMBERS, "is_price_valid": FLAG},
    "sales": {"sale_id": INTEGERS, "customer_id": INTEGERS, "product_id": INTEGERS, "sale_date": DATES, "quantity": INTEGERS, "discount": NUMBERS},
    "weather_daily": {"date": DATES, "city": TEXT, "temp_c": NUMBERS, "precip_mm": NUMBERS, "precip_hours": NUMBERS, "weather_code": INTEGERS},
}
#: The id of a dataset, of which nulls are counted.
ID_OF = {"customers": ("customer_id",), "products": ("product_id",), "sales": ("sale_id",)}
#: Columns in which the contract allows no null.
REQUIRED = {"sales": ("sale_date",), "weather_daily": ("date", "city")}


@dataclass(frozen=True)
class Thresholds:
    """Levels at which the gate warns; values outside 0 to 1 are clamped."""

    max_reject_rate: float = 0.45
    min_valid_price_coverage: float = 0.90
    max_unknown_city_rate: float = 0.08

    def __post_init__(self):
        for name in ("max_reject_rate", "min_valid_price_coverage", "max_unknown_city_rate"):
            object.__setattr__(self, name, min(1.0, max(0.0, float(getattr(self, name)))))


class QualityGateError(Exception):
    """The gate found blocking failures; `report` has them."""

    def __init__(self, message: str, report: dict):
        super().__init__(message)
        self.report = report


def _ratio(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def table_counts(name: str, df: DataFrame) -> dict[str, Column]:
    """What the gate counts of one table alone, as aggregates of one pass: to be taken by themselves, or observed while it is written.
    Counts of columns that are missing or of another kind are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fits = lambda *columns: all(isinstance(kinds.get(c), CONTRACTS[name][c]) for c in columns)
    tests: dict[str, tuple[tuple[str, ...], Column]] = {f"null_{c}": ((), F.col(c).isNull()) for c in {*REQUIRED.get(name, ()), *ID_OF.get(name, ())} & {*kinds}}
    if name == "products":
        valid, price = F.col("is_price_valid"), F.col("price")
        tests["price_state"] = ("is_price_valid", "price"), (valid & (price.isNull() | (price <= 0))) | (~valid & price.isNotNull())
        tests["price_le_0"] = ("price",), price <= 0
        tests["with_digit"] = ("product_name",), _has_digit(F.col("product_name"))
    if name == "sales":
        tests["invalid_quantity"] = ("quantity",), F.col("quantity").isNull() | (F.col("quantity") <= 0)
        tests["invalid_discount"] = ("discount",), F.col("discount").isNull() | ~F.col("discount").between(0, 100)
    if name == "weather_daily":
        tests["negative_rain"] = ("precip_mm",), F.col("precip_mm") < 0
    return {"rows": F.count(F.lit(1))} | {n: F.count_if(F.coalesce(test, F.lit(False))) for n, (columns, test) in tests.items() if fits(*columns)}


def counted(name: str, df: DataFrame) -> dict[str, int]:
    """table_counts() by a job of their own."""
    return df.agg(*[c.alias(n) for n, c in table_counts(name, df).items()]).first().asDict()


def contract_failures(name: str, df: DataFrame, counts: Mapping[str, int] | None = None) -> list[str]:
    """What breaks the dataset's contract, each message once. With columns missing, only that is reported. `counts` are the
    table_counts() where they are known."""
    contract, start = CONTRACTS[name], f"{name}.silver contract violation: "
    missing = [c for c in contract if c not in df.columns]
    if missing:
        return [f"{start}missing columns {missing}"]
    found = [f"{start}{c} must be {_KIND[kinds]}" for c, kinds in contract.items() if not isinstance(df.schema[c].dataType, kinds)]
    typed, counts = not found, counts or counted(name, df)
    found += [f"{start}{c} must not contain nulls" for c in REQUIRED.get(name, ()) if counts[f"null_{c}"]]
    if name == "products" and typed and counts["price_state"]:
        found.append(f"{start}price must be positive when is_price_valid is true and NA otherwise")
    if name == "weather_daily" and _surplus(df, "date", "city"):
        found.append(f"{start}(date, city) must be unique")
    return list(dict.fromkeys(found))


def _surplus(df: DataFrame, *keys: str) -> int:
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def link_counts(sales: DataFrame, customers: DataFrame, products: DataFrame, weather: DataFrame) -> DataFrame:
    """One row of counts over clean sales and what they refer to: orphans, unknown cities, missing weather and prices. Each
    side is made unique by its key first, and one chain of joins serves all counts."""
    c = customers.groupBy(F.col("customer_id").alias("_of_customer")).agg(F.max("city").alias("_city"), F.lit(True).alias("_customer"))
    p = products.groupBy(F.col("product_id").alias("_of_product")).agg(F.max("price").alias("_price"), F.lit(True).alias("_product"))
    w = weather.select(F.col("date").cast("date").alias("_date"), F.col("city").alias("_at"), F.lit(True).alias("_weather")).distinct()
    rows = sales.select("customer_id", "product_id", F.col("sale_date").cast("date").alias("sale_date"))
    rows = left_join(left_join(rows, c, {"customer_id": "_of_customer"}), p, {"product_id": "_of_product"})
    rows = left_join(rows, w, {"_city": "_at", "sale_date": "_date"})
    known = F.col("_city").isNotNull()
    return rows.agg(
        F.count_if(F.col("_customer").isNull()).alias("unknown_cust_fk"), F.count_if(F.col("_product").isNull()).alias("unknown_prod_fk"),
        F.count_if(~known).alias("sales_with_unknown_city"), F.count_if(known).alias("eligible_sales_for_weather_match"),
        F.count_if(known & F.col("_weather").isNull()).alias("sales_with_no_weather_match"),
        F.count_if(~F.coalesce(F.col("_price") > 0, F.lit(False))).alias("missing_valid_price_rows"),
    )


def _has_digit(c: Column) -> Column:
    return c.rlike(r"\d")


def names_with_digits(products: DataFrame) -> DataFrame:
    """One row: products whose name still holds a digit, and all."""
    return products.agg(F.count_if(F.coalesce(_has_digit(F.col("product_name")), F.lit(False))).alias("with_digit"), F.count(F.lit(1)).alias("products"))


def metrics(cleaned: Mapping[str, DataFrame], rejected: DataFrame, limits: Thresholds, counts: Mapping[str, Mapping[str, int]] | None = None) -> dict[str, dict]:
    """The gate's figures by block. `counts` has table_counts() of each table, and rows of `rejected`, where they are known; what is
    left for jobs is what compares rows: keys that repeat, and links between tables."""
    customers, products, sales, weather = (cleaned[k] for k in ("customers", "products", "sales", "weather_daily"))
    counts = dict(counts or {})
    # a count that a column of the wrong kind does not allow is 0; the contract has said so
    c, p, s, w = (Counter(counts.get(k) or counted(k, cleaned[k])) for k in ("customers", "products", "sales", "weather_daily"))
    n_rejected = counts["rejected"]["rows"] if "rejected" in counts else rejected.count()
    try:
        links = link_counts(sales, customers, products, weather).first().asDict()
    except AnalysisException as e:  # a column that coverage needs is missing or cannot be compared
        log.error("coverage metrics unavailable: %s", e)
        links = dict.fromkeys(("unknown_cust_fk", "unknown_prod_fk", "sales_with_unknown_city", "eligible_sales_for_weather_match", "sales_with_no_weather_match"), 0) | {"missing_valid_price_rows": s["rows"]}
    eligible, unmatched = links["eligible_sales_for_weather_match"], links["sales_with_no_weather_match"]
    return {
        "rows": {"customers": c["rows"], "products": p["rows"], "sales_clean": s["rows"], "sales_rejected": n_rejected, "weather": w["rows"]},
        "customers": {"null_customer_id": c["null_customer_id"], "dup_customer_id": _surplus(customers, "customer_id")},
        "products": {"null_product_id": p["null_product_id"], "dup_product_id": _surplus(products, "product_id"), "invalid_price_le_0": p["price_le_0"], "digits_in_name": p["with_digit"]},
        "sales": {
            "null_sale_id": s["null_sale_id"], "dup_sale_id": _surplus(sales, "sale_id"), "invalid_qty": s["invalid_quantity"], "invalid_disc": s["invalid_discount"],
            "unknown_cust_fk": links["unknown_cust_fk"], "unknown_prod_fk": links["unknown_prod_fk"], "reject_rate": _ratio(n_rejected, s["rows"] + n_rejected), "max_reject_rate": limits.max_reject_rate,
        },
        "weather": {
            "null_weather_date": w["null_date"], "dup_weather_key": _surplus(weather, "date", "city"), "neg_precip": w["negative_rain"], "sales_with_unknown_city": links["sales_with_unknown_city"],
            "unknown_city_rate": _ratio(links["sales_with_unknown_city"], s["rows"]), "eligible_sales_for_weather_match": eligible, "sales_with_no_weather_match": unmatched,
            "weather_coverage_rate": _ratio(eligible - unmatched, eligible), "missing_valid_price_rows": links["missing_valid_price_rows"],
            "price_coverage_rate": _ratio(s["rows"] - links["missing_valid_price_rows"], s["rows"]), "min_valid_price_coverage": limits.min_valid_price_coverage, "max_unknown_city_rate": limits.max_unknown_city_rate,
        },
    }


#: Blocking failures: their words, and block and name of the metric that must be 0 (fixed values, in reporting order).
BLOCKING = (
    ("null sale_id after cleaning", "sales", "null_sale_id"), ("duplicated sale_id after cleaning", "sales", "dup_sale_id"),
    ("null customer_id after cleaning", "customers", "null_customer_id"), ("duplicated customer_id", "customers", "dup_customer_id"),
    ("null product_id after cleaning", "products", "null_product_id"), ("duplicated product_id", "products", "dup_product_id"),
    ("orphan customer_id in sales", "sales", "unknown_cust_fk"), ("orphan product_id in sales", "sales", "unknown_prod_fk"),
)


def failures_of(m: Mapping[str, dict], contracts: list[str]) -> list[str]:
    """Blocking failures in their fixed order: those of integrity, then the contracts."""
    return [f"{text} ({m[block][name]})" for text, block, name in BLOCKING if m[block][name]] + contracts


def warnings_of(m: Mapping[str, dict]) -> list[str]:
    """What does not block but should be seen: rates on the wrong side of their limits, and rows that lack something."""
    p, s, w = m["products"], m["sales"], m["weather"]

    def beyond(text: str, rate: float, least: float, most: float) -> list[str]:
        return [] if least <= rate <= most else [f"{text}: {rate:.2%}, where {f'at most {most:.2%}' if rate > most else f'at least {least:.2%}'} is expected"]

    def some(n: int, text: str) -> list[str]:
        return [f"{n} {text}"] if n else []

    return [
        *beyond("sales rejected", s["reject_rate"], 0, s["max_reject_rate"]),
        *beyond(f"clean sales whose customer has no known city ({w['sales_with_unknown_city']})", w["unknown_city_rate"], 0, w["max_unknown_city_rate"]),
        *some(w["sales_with_no_weather_match"], f"clean sales in a known city have no weather (coverage {w['weather_coverage_rate']:.2%})"),
        *beyond(f"clean sales with a valid product price ({w['missing_valid_price_rows']} have none)", w["price_coverage_rate"], w["min_valid_price_coverage"], 1),
        *some(p["digits_in_name"], "product names still have digits"),
    ]


def quality_report(cleaned: Mapping[str, DataFrame], rejected: DataFrame, limits: Thresholds = Thresholds(), fail_on_critical: bool = True, counts: Mapping[str, Mapping[str, int]] | None = None) -> dict:  # noqa: B008
    """The gate's report; raises QualityGateError on blocking failures unless told not to. Contracts come first: where columns
    are missing, metrics would only fail on them. `counts`: what was observed while the tables were written."""
    contracts = [x for name in CONTRACTS for x in contract_failures(name, cleaned[name], (counts or {}).get(name))]
    if any("missing columns" in x for x in contracts):
        found, failures, warnings = {}, contracts, []
    else:
        found = metrics(cleaned, rejected, limits, counts)
        failures, warnings = failures_of(found, contracts), warnings_of(found)
    report = {"status": "failed" if failures else "passed", "critical_failures": failures, "warnings": warnings, "metrics": found}
    for text in warnings:
        log.warning(text)
    return enforce(report) if fail_on_critical else report


def enforce(report: dict) -> dict:
    """The report itself if it passed; else QualityGateError."""
    if report.get("status") == "passed":
        return report
    raise QualityGateError("CRITICAL quality gate failed: " + ("; ".join(map(str, report.get("critical_failures") or [])) or str(report.get("status"))), report)
