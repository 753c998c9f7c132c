"""The four cleaners: raw rows (all text) to the silver contract.

Each takes an optional `tie` order, which decides between rows that are alike in score and date: by default the ordinal that
the CSV reader adds (`_row`), so the first row of the input wins; where there is none, all raw columns in order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.dates import parsed_ymd, to_ymd
from quern.functions.numbers import is_whole, parsed_number, to_number, to_price, to_whole
from quern.functions.text import joined_flags, letters_for_digits, looked_up, none_if_blank, squeezed, tidy, title_case, trimmed
from quern.operators.best import best_row, filled
from quern.operators.spread import left_join

ORDINAL = "_row"
UNKNOWN = "unknown"

#: Reject reasons in reporting order (fixed values).
REASONS = (
    "missing_sale_id", "invalid_sale_id", "missing_customer_id", "invalid_customer_id", "missing_product_id", "invalid_product_id",
    "invalid_sale_date", "unknown_customer_id", "unknown_product_id", "invalid_quantity", "invalid_discount", "discount_out_of_range",
)
SALES_COLUMNS = ("sale_id", "customer_id", "product_id", "sale_date", "quantity", "discount")


def _ties(df: DataFrame, tie: Sequence[Column] | None, columns: Sequence[str]) -> list[Column]:
    if tie is not None:
        return list(tie)
    if ORDINAL in df.columns:
        return [F.col(ORDINAL).asc()]
    return [F.col(c).asc_nulls_last() for c in columns if c in df.columns]


def valid_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows whose `key` is an integer, with it as `_id`; blank, fractional and other ids go."""
    return df.withColumn("_id", to_whole(trimmed(F.col(key)))).filter(F.col("_id").isNotNull())


def clean_customers(raw: DataFrame, cities: Mapping[str, str] | None = None, tie: Sequence[Column] | None = None) -> DataFrame:
    """The most complete row of each customer (then the latest sign-up), names and city tidied, city spellings mapped."""
    columns = ("customer_id", "first_name", "last_name", "city", "signup_date")
    rows = valid_ids(raw, "customer_id").withColumns({
        "_city": tidy(F.col("city")), "_first": tidy(F.col("first_name")), "_last": tidy(F.col("last_name")), "_date": to_ymd(F.col("signup_date")),
    })
    score = filled(*[F.col(c).isNotNull() for c in ("_city", "_date", "_first", "_last")])
    best = best_row(rows, ["_id"], score.desc(), F.col("_date").desc_nulls_last(), *_ties(rows, tie, columns))
    return best.select(
        F.col("_id").alias("customer_id"), title_case(F.col("_first")).alias("first_name"), title_case(F.col("_last")).alias("last_name"),
        title_case(looked_up(F.col("_city"), cities or {})).alias("city"), F.col("_date").alias("signup_date"),
    )


def category_of(c: Column, categories: Mapping[str, str]) -> Column:
    """A canonical category in title case; anything that is not mapped to one is Unknown."""
    known = sorted({*categories.values(), UNKNOWN})
    mapped = looked_up(c, categories)
    return title_case(F.when(mapped.isin(*known), mapped).otherwise(F.lit(UNKNOWN)))


def clean_products(raw: DataFrame, categories: Mapping[str, str] | None = None, leet: Mapping[str, str] | None = None, tie: Sequence[Column] | None = None) -> DataFrame:
    """The most complete row of each product (then the highest price read, valid or not). A price that is not positive
    becomes null and the row stays, marked. Without a `leet` table names are only lowered. Names are spelt out when the rows are
    chosen: look-alike letters never leave a name blank."""
    columns = ("product_id", "product_name", "category", "price")
    name = squeezed(trimmed(F.col("product_name")))
    rows = valid_ids(raw, "product_id").withColumns({
        "_name": none_if_blank(name), "_category": tidy(F.col("category")), "_price": to_price(F.col("price")),
    })
    priced = F.coalesce(F.col("_price") > 0, F.lit(False))
    score = filled(F.col("_name").isNotNull(), F.col("_category").isNotNull(), priced)
    best = best_row(rows, ["_id"], score.desc(), F.col("_price").desc_nulls_last(), *_ties(rows, tie, columns))
    return best.select(
        F.col("_id").alias("product_id"), title_case(letters_for_digits(F.col("_name"), leet or {})).alias("product_name"), category_of(F.col("_category"), categories or {}).alias("category"),
        F.when(priced, F.col("_price")).alias("price"), priced.alias("is_price_valid"),
    )


def _known(rows: DataFrame, ids: DataFrame, key: str, mark: str, hot: Sequence[int]) -> DataFrame:
    """`rows` with a flag whether `key` is one of `ids`. Rows without one, and those of `hot` keys, are spread over tasks."""
    marks = ids.select(F.col(ids.columns[0]).cast("long").alias(f"{mark}_id")).distinct().withColumn(mark, F.lit(True))
    return left_join(rows, marks, {key: f"{mark}_id"}, hot).drop(f"{mark}_id").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def judge_sales(raw: DataFrame, customers: DataFrame, products: DataFrame, tie: Sequence[Column] | None = None, hot: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """The best row of each valid sale_id (and every row without one), with parsed columns and `reject_reasons`: null for a
    row that is clean. Reasons stand in the order of REASONS with `|` between them; raw columns stay as they were read. `hot` names
    ids (by customer_id and product_id) that very many rows have; it changes how rows are dealt, and no result."""
    hot = hot or {}
    ids = {"sale_id": "_sale", "customer_id": "_customer", "product_id": "_product"}
    # trimmed once, as columns of their own: what follows looks at each several times
    rows = raw.withColumns({f"_t_{c}": none_if_blank(trimmed(F.col(c))) for c in SALES_COLUMNS})
    rows = rows.withColumns({new: to_whole(F.col(f"_t_{c}")) for c, new in ids.items()}).withColumns({
        "_date": parsed_ymd(F.col("_t_sale_date")), "_quantity": parsed_number(F.col("_t_quantity")),
        "_discount": F.when(F.col("_t_discount").isNull(), F.lit(0.0)).otherwise(parsed_number(F.col("_t_discount"))),
    })
    for c, new in ids.items():
        missing = F.col(f"_t_{c}").isNull()
        rows = rows.withColumns({f"{new}_missing": missing, f"{new}_bad": ~missing & F.col(new).isNull()})
    rows = rows.drop(*[f"_t_{c}" for c in SALES_COLUMNS])
    rows = _known(rows, customers.select("customer_id"), "_customer", "_has_customer", hot.get("customer_id", ()))
    rows = _known(rows, products.select("product_id"), "_product", "_has_product", hot.get("product_id", ()))
    in_range = F.coalesce(F.col("_discount").between(0, 100), F.lit(False))
    sold = F.coalesce((F.col("_quantity") % 1 == 0) & (F.col("_quantity") > 0), F.lit(False))
    score = filled(F.col("_date").isNotNull(), sold, in_range, ~F.col("_customer_bad") & F.col("_has_customer"), ~F.col("_product_bad") & F.col("_has_product"))
    # rows without a valid id are all kept: each gets a key of its own beside the null id
    has_id = ~F.col("_sale_missing") & ~F.col("_sale_bad")
    rows = rows.withColumns({"_key": F.when(has_id, F.col("_sale")), "_alone": F.when(~has_id, F.monotonically_increasing_id())})
    best = best_row(rows, ["_key", "_alone"], score.desc(), F.col("_date").desc_nulls_last(), *_ties(rows, tie, SALES_COLUMNS))
    flags = {
        "missing_sale_id": F.col("_sale_missing"), "invalid_sale_id": F.col("_sale_bad"), "missing_customer_id": F.col("_customer_missing"),
        "invalid_customer_id": F.col("_customer_bad"), "missing_product_id": F.col("_product_missing"), "invalid_product_id": F.col("_product_bad"),
        "invalid_sale_date": F.col("_date").isNull(), "unknown_customer_id": ~F.col("_customer_missing") & ~F.col("_customer_bad") & ~F.col("_has_customer"),
        "unknown_product_id": ~F.col("_product_missing") & ~F.col("_product_bad") & ~F.col("_has_product"), "invalid_quantity": ~sold,
        "invalid_discount": F.col("_discount").isNull(), "discount_out_of_range": ~F.col("_discount").between(0, 100),
    }
    return best.withColumn("reject_reasons", joined_flags([(r, flags[r]) for r in REASONS]))


def accepted_sales(judged: DataFrame) -> DataFrame:
    """The clean part of judged sales, typed."""
    return judged.filter("reject_reasons IS NULL").select(
        F.col("_sale").alias("sale_id"), F.col("_customer").alias("customer_id"), F.col("_product").alias("product_id"),
        F.col("_date").alias("sale_date"), F.col("_quantity").cast("long").alias("quantity"), F.col("_discount").alias("discount"),
    )


def rejected_sales(judged: DataFrame) -> DataFrame:
    """The rejected part: raw text and ordered reasons."""
    return judged.filter("reject_reasons IS NOT NULL").select(*SALES_COLUMNS, "reject_reasons")


def reason_counts(rejected: DataFrame) -> DataFrame:
    """(reason, rank, rejected) for each reason that occurs, in reporting order of rank."""
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(REASONS) for x in (r, i + 1)])
    counts = rejected.select(F.explode(F.split("reject_reasons", r"\|")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))
    return counts.select("reason", F.element_at(ranks, F.col("reason")).alias("rank"), "rejected").orderBy("rank")


def clean_weather(raw: DataFrame, tie: Sequence[Column] | None = None) -> DataFrame:
    """The most complete row of each (date, city). Measures that are missing from the input are missing from the result;
    negative rain is nulled before completeness counts; a weather code that is not whole fails the job."""
    measures = [c for c in ("temp_c", "precip_mm", "precip_hours", "weather_code") if c in raw.columns]
    rows = raw
    for c in measures:
        number = to_number(F.col(c))
        if c == "precip_mm":
            number = F.when(number >= 0, number)
        if c == "weather_code":
            fault = F.raise_error(F.concat(F.lit("weather_code is not whole: "), F.col(c))).cast("int")
            number = F.when(number.isNull(), F.lit(None).cast("int")).when(is_whole(number), number.cast("int")).otherwise(fault)
        rows = rows.withColumn(f"_{c}", number)
    city = title_case(F.lower(squeezed(trimmed(F.col("city")))))
    rows = rows.withColumns({"_date": to_ymd(F.col("date")), "_city": city})
    score = filled(*[F.col(f"_{c}").isNotNull() for c in measures])
    best = best_row(rows, ["_date", "_city"], score.desc(), *_ties(rows, tie, ("date", "city", "temp_c", "precip_mm", "precip_hours", "weather_code")))
    return best.select(F.col("_date").alias("date"), F.col("_city").alias("city"), *[F.col(f"_{c}").alias(c) for c in measures])
