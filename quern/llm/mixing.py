"""Mixing sources to target weights by Poisson replication. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import free_names, materialise, shuffle_partitions

#: Up to so many sources the rates are broadcast (a few MB at most); beyond it they are joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: A mean above this is split into equal independent parts, whose counts add up to the same distribution.
MAX_PART = 16.0
#: Terms of the cumulative distribution kept; beyond them less than 1e-16 remains for a mean of MAX_PART.
TERMS = 80
#: Salts for the join that replaces the broadcast.
SALTS = 32


def hash_unit(*parts: Column | str) -> Column:
    """A uniform value in (0, 1) from the first 52 bits of an MD5 of the parts joined by '|'."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, epochs: float, source: str, text: str) -> DataFrame:
    """One row for each source: `source`, `mass` (UTF-8 bytes, one more for each document) and `rate`, the mean number of
    copies that gives the source its share of `epochs` times the corpus. Without weights a source's weight is the whole
    part of the square root of its mass, which lifts small sources without repeating them as often as equal shares would."""
    mass = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(1)
    stats = materialise(docs.groupBy(F.col(source).alias("source")).agg(F.sum(mass).alias("mass")), "mix-sources")
    if weights is None:
        stats = stats.withColumn("weight", F.floor(F.sqrt("mass")).cast("double"))
    else:
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        stats = stats.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0)))
    total = stats.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight")
    return stats.join(F.broadcast(total)).select(  # one row
        "source", "mass", F.when(F.col("all_weight") > 0, share * F.lit(float(epochs)) * F.col("all_mass") / F.col("mass")).otherwise(0.0).alias("rate")
    )


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = 42,
                source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Copies of the rows of `docs`, each as often as a Poisson distribution with its source's rate says, in a global
    pseudo-random order. Adds `rate`, `copy` (1, 2, ...) and `shuffle_key` (the order; partitions are cut by its hash).

    The count inverts the distribution at a hash of (seed, key), so it is the same on every run and in every layout.
    A null source is a source of its own (weight 0 where weights are given); null or empty texts count one byte; rows with
    the same key get the same count; rows of a source with weight 0 go. Empty input gives an empty result. Input columns
    named like an added one are replaced."""
    rates = source_rates(docs, weights, epochs, source, text)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_PART))).cast("int")
    mean, parts_of, cdf, salt, src, item = free_names(docs.columns, "mean", "parts_of", "cdf", "salt", "mix_source", "item")
    rates = rates.withColumn(parts_of, parts).withColumn(mean, F.col("rate") / F.col(parts_of))
    rates = rates.withColumn(cdf, F.expr(
        f"transform(aggregate(sequence(1, {TERMS}), array(named_struct('p', exp(-`{mean}`), 'c', exp(-`{mean}`))), "
        f"(a, k) -> array_append(a, named_struct('p', a[k - 1].p * `{mean}` / k, 'c', a[k - 1].c + a[k - 1].p * `{mean}` / k))), x -> x.c)"
    ))
    rates = rates.select(F.col("source").alias(src), "rate", parts_of, cdf)
    docs = docs.drop("rate", "copy", "shuffle_key")
    if rates.count() <= MAX_BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(rates), docs[source].eqNullSafe(rates[src])).drop(src)
    else:
        salts = max(SALTS, shuffle_partitions(docs.sparkSession))
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = docs.withColumn(salt, F.pmod(F.xxhash64(key, text), F.lit(salts)).cast("int"))
        rated = dealt.join(salted, dealt[source].eqNullSafe(salted[src]) & (dealt[salt] == salted[salt])).drop(dealt[salt]).drop(salted[salt], src)
    ident = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    units = F.transform(F.sequence(F.lit(1), F.col(parts_of)), lambda j: hash_unit(F.lit(f"poisson|{seed}"), ident, j.cast("string")))
    draws = F.transform(units, lambda u: F.size(F.filter(F.col(cdf), lambda c: c < u)))
    count = F.aggregate(draws, F.lit(0), lambda a, n: a + n)
    kept = [c for c in rated.columns if c not in (parts_of, cdf)]
    copied = rated.select(*kept, F.posexplode(F.array_repeat(F.lit(0), count)).alias("copy", item)).drop(item)
    copied = copied.withColumn("copy", F.col("copy") + F.lit(1))
    order = F.md5(F.concat_ws("|", F.lit(f"order|{seed}"), ident, F.col("copy").cast("string")))
    return copied.withColumn("shuffle_key", order).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
