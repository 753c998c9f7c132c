"""Shared scratch storage and range partitioning used by several operators.

All intermediate tables and files go to the folder the cluster names in spark.checkpoint.dir, which the driver and all
executors share. A local folder is made only where that setting is unset and the master is local (tests)."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Position of the partition number in monotonically_increasing_id().
PART_SHIFT = 33


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch data."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="quern-"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{scratch_root(spark)}/quern/{label}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While this lasts, an execution's shuffle files go when it ends: what it made has been written by then."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, fixes row identities."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from materialise() that nothing reads any more."""
    for path in [t._scratch for t in tables if "_scratch" in vars(t)]:
        spark = tables[0].sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it. Hadoop's names of S3 are understood."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like `wanted` that clash with none of `columns` (case-insensitively)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending values of the integer column `key` that cut it into near-equal ranges; reads only `key`."""
    if parts < 2:
        return []
    fractions = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, fractions, 100 * parts).alias("b"), F.min(key).alias("lo")).first()
    return sorted({b for b in row["b"] or [] if b > row["lo"]})


def range_index(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending `bounds` are <= value (null counts as lowest): a binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    table, steps = F.lit(bounds), len(bounds).bit_length()

    def step(at: Column, k: Column) -> Column:
        to = at + F.element_at(F.lit([1 << (steps - 1 - i) for i in range(steps)]), k)
        return F.when((to <= len(bounds)) & (value >= F.element_at(table, F.least(to, F.lit(len(bounds))))), to).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step)


#: Rows that Python takes at once; a batch of long texts stays far below a worker's memory.
BATCH_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of at most BATCH_ROWS."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """While this lasts, Python gets rows one by one: for tables whose rows are megabytes each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_key_order(df: DataFrame, key: str, tie: Column) -> DataFrame:
    """`df` in ascending key order (nulls first, then `tie`, a hash) over partitions 0, 1, ..., with one shuffle and a scan of
    the key and the hash. Ranges are cut by both, so rows that share a key are spread over tasks; only rows alike in both
    stay together."""
    spark = df.sparkSession
    order, name = free_names(df.columns, "order", "tie")
    hashed = df.withColumn(name, tie)
    bounds = pair_bounds(hashed, key, name, shuffle_partitions(spark))
    if not bounds:
        return hashed.repartition(1).sortWithinPartitions(F.col(key).asc_nulls_first(), name).drop(name)
    dealt = hashed.withColumn(order, pair_index(F.col(key), F.col(name), bounds)).repartitionById(len(bounds) + 1, F.col(order))
    return dealt.sortWithinPartitions(F.col(key).asc_nulls_first(), name).drop(order, name)


def pair_bounds(df: DataFrame, key: str, tie: str, parts: int) -> list[tuple[int | None, int]]:
    """Ascending (key, tie) pairs that cut `df` into near-equal ranges: cuts of the key, and where a key is cut more than once,
    cuts of its hashes in equal steps."""
    if parts < 2:
        return []
    fractions = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, fractions, 100 * parts).alias("b"), F.count(key).alias("n"), F.count(F.lit(1)).alias("all")).first()
    n_null = row["all"] - row["n"]
    null_cuts = parts * n_null // row["all"] if row["all"] else 0
    cuts: list[tuple[int | None, int]] = [(None, t) for t in _hash_steps(null_cuts)]
    times: dict[int, int] = {}
    for b in row["b"] or []:
        times[b] = times.get(b, 0) + 1
    for b in sorted(times):
        cuts.append((b, -(1 << 63)))
        if times[b] > 1:  # the key fills ranges of its own
            cuts += [(b, t) for t in _hash_steps(times[b] - 1)]
            cuts += [(b + 1, -(1 << 63))] if b < (1 << 63) - 1 and b + 1 not in times else []
    return cuts


def _hash_steps(n: int) -> list[int]:
    """n values that cut the 64-bit integers into equal parts."""
    return [-(1 << 63) + (i << 64) // (n + 1) for i in range(1, n + 1)]


def pair_index(key: Column, tie: Column, bounds: list[tuple[int | None, int]]) -> Column:
    """How many of the ascending (key, tie) `bounds` are not above a row, null keys being lowest: a binary search."""
    known, keys, ties = F.lit([int(k is not None) for k, _ in bounds]), F.lit([k or 0 for k, _ in bounds]), F.lit([t for _, t in bounds])
    f, k, steps = key.isNotNull().cast("int"), F.coalesce(key, F.lit(0)), len(bounds).bit_length()

    def step(at: Column, i: Column) -> Column:
        to = at + F.element_at(F.lit([1 << (steps - 1 - j) for j in range(steps)]), i)
        j = F.least(to, F.lit(len(bounds)))
        bf, bk, bt = F.element_at(known, j), F.element_at(keys, j), F.element_at(ties, j)
        above = (f > bf) | ((f == bf) & ((k > bk) | ((k == bk) & (tie >= bt))))
        return F.when((to <= len(bounds)) & above, to).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], place: str, total: str, label: str) -> DataFrame:
    """`df`, written to the shared folder, with each row's place (from 0) in its group in the order of `order` (ascending, nulls
    first), and the group's number of rows. Groups count nulls as a value; columns of `order` should tell rows apart.

    Rows are laid out in ranges of group and order, so a group with a third of all rows fills several tasks. What a range holds
    of a group is one piece of a file: a row's place is its distance from the piece's first row and the sizes of the group's
    pieces before (as many as ranges at most)."""
    rid, piece, at, low, size, base, every, *same = free_names(df.columns, "rid", "piece", "at", "low", "size", "base", "every", *(f"of_{g}" for g in groups))
    ascending = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    laid = df.repartitionByRange(shuffle_partitions(df.sparkSession), *ascending).sortWithinPartitions(*ascending)
    laid = materialise(laid.withColumn(rid, F.monotonically_increasing_id()), f"{label}-laid")
    cut = laid.withColumn(piece, F.shiftright(rid, PART_SHIFT).cast("int"))
    own = Window.partitionBy(*groups)
    pieces = cut.groupBy(*groups, piece).agg(F.min(rid).alias(low), F.count(F.lit(1)).alias(size)).withColumns({
        base: F.coalesce(F.sum(size).over(own.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), every: F.sum(size).over(own),
    })
    pieces = pieces.select(F.col(piece).alias(at), low, base, every, *[F.col(g).alias(s) for g, s in zip(groups, same, strict=True)])
    on = F.col(piece) == F.col(at)
    for g, s in zip(groups, same, strict=True):
        on &= F.col(g).eqNullSafe(F.col(s))
    places = cut.join(pieces, on).select(*df.columns, (F.col(rid) - F.col(low) + F.col(base)).alias(place), F.col(every).alias(total))
    out = materialise(places, label)
    discard(laid)
    return out
