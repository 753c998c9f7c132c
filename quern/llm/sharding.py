"""Sharding by global byte-size prefix sums cut at equal targets: contiguous, balanced shards. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.storage import free_names, materialise, shuffle_partitions

#: Position of the partition number in monotonically_increasing_id().
_PART_SHIFT = 33


def _case(rid: Column, cuts: list[tuple[int, int]]) -> Column:
    """The value of the last cut (rid, value) at or below rid; cuts ascend by rid. A balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(cuts[lo][1])
        mid = (lo + hi + 1) // 2
        return F.when(rid >= F.lit(cuts[mid][0]), tree(mid, hi)).otherwise(tree(lo, mid - 1))

    return tree(0, len(cuts) - 1)


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str | None = "text", overhead: int = 16,
                    n_bytes: str | None = None, tie: str | None = None) -> DataFrame:
    """All rows of `docs` with three more columns: `size` (UTF-8 bytes of the text plus `overhead`; null text: the
    overhead), `shard` (0 to shards - 1) and `slot` (gapless from 0 within its shard). `n_bytes` and `tie` may name
    columns that stand for the text's byte count and a digest of it, where the rows to place carry no text.

    Rows are laid out in ascending `key` order (nulls first; ties by a hash of the text, repeated rows in any order).
    A row belongs to the shard that holds the middle of its bytes, so shards are contiguous in that order and their byte
    totals differ by at most the largest row. Empty input gives an empty result; a row larger than a whole target makes
    its neighbours' shards smaller or empty. Input columns named like an added one are replaced by it.

    Plan: one range shuffle, one write to the shared folder that fixes each row's partition and position; per-partition
    totals (as many rows as partitions, broadcast) give each partition's base; running sums stay inside a partition; at most
    `shards` cut rows reach the driver and label the rows by comparison, so wide rows are shuffled once."""
    spark = docs.sparkSession
    rid, digest, part, base = free_names(docs.columns, "rid", "digest", "part", "base")
    size = F.coalesce(F.col(n_bytes) if n_bytes else F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(overhead)
    laid = docs.withColumns({"size": size, digest: F.xxhash64(F.col(tie or text))})
    order = F.col(key).asc_nulls_first(), F.col(digest)
    laid = laid.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    laid = laid.drop(digest).withColumn(rid, F.monotonically_increasing_id())
    laid = materialise(laid, "shard-rows")

    slim = laid.select(F.col(rid).alias("rid"), "size", F.shiftright(rid, _PART_SHIFT).cast("int").alias("pid"))
    totals = slim.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    every = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(
        "pid",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"),
        F.sum("bytes").over(every).alias("total"),
    )
    bases = materialise(bases, "shard-bases")  # one row for each partition
    run = F.sum("size").over(Window.partitionBy("pid").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0))
    placed = slim.withColumn("run", run).join(F.broadcast(bases), "pid")  # as many rows as partitions
    middle = F.expr(f"least({shards - 1}, ({shards} * (2 * (byte_base + run) - size)) div (2 * total))")
    placed = placed.select("rid", middle.alias("shard"), (F.col("row_base") + F.col("rid").bitwiseAND((1 << _PART_SHIFT) - 1)).alias("row"))
    cuts = sorted(placed.groupBy("shard").agg(F.min("rid").alias("rid"), F.min("row").alias("row")).collect(), key=lambda r: r["rid"])
    if not cuts:
        return laid.drop(rid).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    row_bases = F.broadcast(bases.select(F.col("pid").alias(part), F.col("row_base").alias(base)))  # one row for each partition
    laid = laid.join(row_bases, F.shiftright(rid, _PART_SHIFT).cast("int") == F.col(part))
    row = F.col(base) + F.col(rid).bitwiseAND((1 << _PART_SHIFT) - 1)
    return laid.withColumns({
        "shard": _case(F.col(rid), [(c["rid"], c["shard"]) for c in cuts]).cast("int"),
        "slot": (row - _case(F.col(rid), [(c["rid"], c["row"]) for c in cuts])).cast("long"),
    }).drop(rid, part, base)
