"""Profiles of raw or clean tables, from one count of every column's values."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.dates import to_ymd
from quern.functions.numbers import to_number
from quern.functions.text import none_if_blank, trimmed
from quern.operators.best import repeated

log = logging.getLogger("quern.profile")

#: Business key of each dataset (fixed values).
KEYS = {"customers": ("customer_id",), "products": ("product_id",), "sales": ("sale_id",), "weather_daily": ("date", "city")}
#: Columns whose nulls are reported one by one (fixed values).
WATCHED = ("customer_id", "city", "signup_date", "product_id", "price", "category", "sale_id", "sale_date", "quantity", "discount", "date")


def _rules(name: str, columns: list[str]) -> dict[str, tuple[str, Callable[[Column], Column]]]:
    """The dataset's rules on columns that are there: a column, and when its value breaks the rule."""

    def unparsed(c: Column) -> Column:
        return none_if_blank(trimmed(c)).isNotNull() & to_ymd(c).isNull()

    rules = {
        "customers": {"signup_date_unparsed": ("signup_date", unparsed)},
        "products": {"price_le_0": ("price", lambda c: to_number(c) <= 0)},
        "sales": {"quantity_le_0": ("quantity", lambda c: to_number(c) <= 0), "discount_out_of_range": ("discount", lambda c: ~to_number(c).between(0, 100)), "sale_date_unparsed": ("sale_date", unparsed)},
        "weather_daily": {"precip_mm_lt_0": ("precip_mm", lambda c: to_number(c) < 0), "date_unparsed": ("date", unparsed)},
    }
    return {rule: (c, test) for rule, (c, test) in rules.get(name, {}).items() if c in columns}


def counts_row(name: str, df: DataFrame) -> DataFrame:
    """One row: `n`, null_<column> for each column, and violations of the dataset's rules. One scan, nothing shuffled but sums."""
    rules = _rules(name, df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns], *[F.count_if(test(F.col(c))).alias(rule) for rule, (c, test) in rules.items()])


#: Names under which value_counts() has whole rows and their keys, as digests; no column is called so.
ROW, KEY = "\0row", "\0key"


def value_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(column, value, n): how often each column has each value, as text, null included, and ROW and KEY the digests of whole rows
    and of their `keys`. Values are counted in their tasks before the one shuffle, whatever the number of columns."""
    columns, form = df.columns, {"ignoreNullFields": "false"}
    # JSON keeps null, empty text and the bounds of cells apart
    whole = {ROW: columns} | ({KEY: list(keys)} if keys else {})
    digests = [F.md5(F.to_json(F.struct(*[F.col(c) for c in own]), form).cast("binary")).alias(name) for name, own in whole.items()]
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns], *digests)
    return texts.unpivot([], texts.columns, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_facts(df: DataFrame, keys: Sequence[str] = (), rules: Mapping[str, tuple[str, Callable[[Column], Column]]] | None = None, n: int = 10) -> DataFrame:
    """(column, rows, nulls, distinct, top, violations) of each column, of ROW and of KEY: nulls and different values, the `n` most
    frequent ones as an array of (value, n) (ties by the value), and how many rows break each of `rules`, which are tested once for
    each value. All from value_counts(): the table is read and shuffled once; of it at most n values a column and task follow."""
    counts = value_counts(df, keys)
    broken = [F.sum(F.when((F.col("column") == c) & F.coalesce(test(F.col("value")), F.lit(False)), F.col("n")).otherwise(0)).alias(rule) for rule, (c, test) in (rules or {}).items()]
    sums = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("distinct"), *broken)
    violations = F.struct(*[F.col(rule) for rule in rules]) if rules else F.lit(None).cast("int")
    # null comes last and goes after the choice: a filter before it would be pushed into the scan, which then had to run twice
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("value").isNull(), F.desc("n"), "value"))
    most = counts.withColumn("place", place).filter(F.col("place") <= n).filter(F.col("value").isNotNull())
    top = most.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("top"))
    top = top.select("column", F.transform("top", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top"))
    shown = F.when(~F.col("column").isin(ROW, KEY), F.col("top")).alias("top")
    return sums.join(top, "column", "left").select("column", "rows", "nulls", "distinct", shown, violations.alias("violations"))


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct_<column> for each column (nulls left out), duplicate_rows and duplicate_keys (rows beyond the first of each;
    null counts as a value)."""
    facts = column_facts(df, keys)
    extra = {"duplicate_rows": ROW, "duplicate_keys": KEY}
    own = [F.coalesce(F.max(F.when(F.col("column") == c, F.col("distinct"))), F.lit(0)).alias(f"distinct_{c}") for c in df.columns]
    return facts.agg(*own, *[F.coalesce(F.max(F.when(F.col("column") == c, F.col("rows") - F.col("distinct"))), F.lit(0)).alias(name) for name, c in extra.items()])


def duplicate_samples(df: DataFrame, *keys: str, n: int = 10) -> DataFrame:
    """The first n rows, in the order of their keys and then all columns, of those whose key is not null and occurs again: to
    look at what the choice of the best row decides between."""
    rows = repeated(df.dropna(subset=list(keys)), list(keys)).filter("is_repeated").drop("is_repeated")
    return rows.orderBy(*keys, *[F.asc_nulls_last(c) for c in df.columns if c not in keys]).limit(n)


def profile(name: str, df: DataFrame) -> dict:
    """Rows, columns, nulls (total, mean and of watched columns), duplicate rows and keys, cardinality and the most frequent values
    of text columns, and violations of the dataset's rules: one read of the table and one shuffle."""
    texts, keys = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)], KEYS.get(name, ())
    keys = keys if {*keys} <= {*df.columns} else ()
    rules = _rules(name, df.columns)
    facts = {r["column"]: r for r in column_facts(df, keys, rules).collect()}  # one for each column
    of = lambda c, what: facts[c][what] if c in facts else 0
    nulls = {c: of(c, "nulls") for c in df.columns}
    return {
        "rows": of(ROW, "rows"), "columns": len(df.columns), "nulls": nulls, "nulls_total": sum(nulls.values()), "nulls_mean": sum(nulls.values()) / max(1, len(nulls)),
        "key_nulls": {c: nulls[c] for c in WATCHED if c in nulls}, "duplicate_rows": of(ROW, "rows") - of(ROW, "distinct"), "key_duplicates": of(KEY, "rows") - of(KEY, "distinct"),
        "cardinality": {c: of(c, "distinct") for c in texts}, "top": {c: [(x["value"], x["n"]) for x in (facts[c]["top"] or [])] if c in facts else [] for c in texts},
        "violations": {rule: facts[c]["violations"][rule] if c in facts else 0 for rule, (c, _) in rules.items()},
    }


def profile_all(tables: Mapping[str, DataFrame], detail: bool = False) -> dict[str, dict]:
    """The profile of each table, also logged."""
    out = {}
    for name, df in tables.items():
        found = out[name] = profile(name, df)
        log.info("profile %s rows=%s cols=%s nulls=%s duplicate_rows=%s duplicate_keys=%s violations=%s", name, found["rows"], found["columns"], found["nulls_total"], found["duplicate_rows"], found["key_duplicates"], found["violations"])
        if detail:
            for c, top in found["top"].items():
                log.debug("profile %s top %s: %s", name, c, top)
    return out


def top_values(df: DataFrame, column: str, n: int = 10, nulls: bool = False) -> DataFrame:
    """(value, rows): the n most frequent values, ties by the value; nulls only if asked for."""
    kept = df if nulls else df.filter(F.col(column).isNotNull())
    return kept.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.asc_nulls_last("value")).limit(n)
