"""Left joins whose rows without a key, and whose hot keys, are spread over tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places to which the rows of each hot key are dealt.
SALTS = 64
#: A key is hot that holds more than this share of all rows: no more than a hundred keys are.
HOT_SHARE = 0.01


def left_join(rows: DataFrame, others: DataFrame, keys: Mapping[str, str], hot: Sequence = ()) -> DataFrame:
    """`rows` with the columns of `others` where all `keys` (a column of `rows`: one of `others`, told apart by name) are equal, else
    nulls. Rows that lack a key match nothing, so they go anywhere, by a hash of their cells; those of `hot` values of the first
    key are dealt likewise, and what they match is repeated for each place. Without hints: where the planner finds `others`
    small, it broadcasts it and nothing is dealt."""
    first = next(iter(keys))
    lacking = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    draw = F.xxhash64(*[F.col(c) for c in rows.columns])
    salt = F.when(lacking, draw)
    if hot:
        salt = salt.when(F.col(first).isin(*hot), F.pmod(draw, F.lit(SALTS)))
    rows = rows.withColumn("_salt", salt.otherwise(F.lit(0)))
    other = F.col(keys[first])
    # not a literal: the optimizer would take a constant out of the keys by which rows are dealt
    place = F.explode(F.when(other.isin(*hot), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))) if hot else F.pmod(F.xxhash64(other), F.lit(1))
    others = others.withColumn("_place", place)
    on: Column = F.col("_salt") == F.col("_place")
    for mine, theirs in keys.items():
        on &= F.col(mine) == F.col(theirs)
    return rows.join(others, on, "left").drop("_salt", "_place")


def hot_values(top: Mapping[str, Sequence[tuple[str, int]]], rows: int) -> dict[str, list[str]]:
    """Of the most frequent values of columns, as a profile has them, those that hold more than HOT_SHARE of all rows."""
    return {c: [value for value, n in values if n > HOT_SHARE * rows] for c, values in top.items()}
