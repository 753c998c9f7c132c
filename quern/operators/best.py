"""One best row for each key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. Spark cuts each task's rows to the first of a key before the shuffle
    (WindowGroupLimit), so a key with very many rows does not gather in one task. Null keys are one key."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def repeated(df: DataFrame, keys: Sequence[str], name: str = "is_repeated") -> DataFrame:
    """All rows, marked if their key has several rows: counts are combined before the shuffle and joined back null-safely."""
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.count(F.lit(1)) > 1).alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(counts, reduce(lambda x, y: x & y, same), "left").select(*df.columns, name)


def filled(*flags: Column) -> Column:
    """How many of the conditions hold."""
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(flag, F.lit(False)).cast("int")
    return total
