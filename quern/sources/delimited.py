"""CSV files (RFC 4180) cut into splits: many tasks read one file, quoted cells may hold line ends, and rows keep their order.

Spark's text reader cuts files at line ends, wherever these stand. A line with an odd number of quotes that open or close a
cell begins or ends a stretch of lines that belong together, so a prefix sum over the splits of how many such lines each has
tells every split whether it begins within a cell, and one of their lines gives every row its place in the whole input. Where a
split has no such line, its lines are the records; elsewhere a window over the split finds which lines to put together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Quotes within a quoted cell are doubled, and it may hold line ends.
QUOTES = {"quote": '"', "escape": '"'}
#: A split's facts are broadcast to the lines up to so many splits (some 50 MB); beyond it they are joined by a shuffle.
MAX_BROADCAST_SPLITS = 500_000
#: The mark that some writers put before UTF-8 text.
_MARK = "\ufeff"
#: Faulty records that an error names.
_NAMED = 5


class MalformedInput(ValueError):
    """Records that cannot be read as the header says; `faults` has the first of them: (path, line, what)."""

    def __init__(self, faults: Sequence[tuple[str, int, str]], count: int):
        super().__init__(f"{count} malformed records: " + "; ".join(f"{path}, line {line}: {what}" for path, line, what in faults))
        self.faults = list(faults)


def _knots(line: Column) -> Column:
    """1 if an odd number of the line's quotes open or close a cell: after doubled ones are gone, those at a cell's edge."""
    edges = F.regexp_count(F.replace(line, F.lit('""'), F.lit("")), F.lit(r'(?<![^,])"|"(?=,|\r?$)'))
    return F.when(F.contains(line, F.lit('"')), edges % 2).otherwise(F.lit(0))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def _fields(record: Column) -> Column:
    """How many cells a record has: commas outside quoted cells, and one."""
    bare = F.when(F.contains(record, F.lit('"')), F.regexp_replace(record, r'(?<![^,])"(?:[^"]|"")*"', "")).otherwise(record)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


@dataclass
class Delimited:
    """The records of CSV files: `names` of the header, and `records`, lazy: (row, path, line, first, record, fault)."""

    names: list[str]
    records: DataFrame

    def rows(self, ordinal: str) -> DataFrame:
        """All records without a fault as text columns, and their place in the input. Records of fewer cells than the header end
        in nulls."""
        ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in self.names)
        cells = F.from_csv("record", F.lit(ddl), QUOTES)
        return self.records.filter("fault IS NULL").select(cells.alias("cells"), F.col("row").alias(ordinal)).select("cells.*", ordinal)

    def faults(self) -> DataFrame:
        """(path, line, fault, record) of the records that cannot be read."""
        return self.records.filter("fault IS NOT NULL").select("path", "line", "fault", "record")

    def require(self) -> None:
        """MalformedInput if any record cannot be read."""
        found = self.faults()
        if n := found.count():
            raise MalformedInput([(r["path"], r["line"], r["fault"]) for r in found.orderBy("path", "line").limit(_NAMED).collect()], n)


def header_of(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """The names in the header and its (first) line; ValueError if there is none."""
    found = [r["value"] for r in spark.read.text(path).limit(1).collect()]
    if not found or not found[0].strip():
        raise ValueError(f"{path} is empty")
    names = spark.read.options(header="true", multiLine="true", **QUOTES).csv(path).columns
    return [n.removeprefix(_MARK) for n in names], found[0]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, at, id, value, knot): every line, its file, the start of its split there, and an id that ascends within a split."""
    rows = spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    return rows.withColumn("knot", _knots(F.col("value")))


def _splits(lines: DataFrame) -> DataFrame:
    """One row for each split: its first id, and over all splits before it, in the order of paths, lines (`base`) and knotted lines
    (`open`); for its file the lines before it (`start`), its first line that isn't blank (`head`), and its knotted lines (`knots`).
    The window has one row for each split, some 100 MB of input."""
    own = lines.groupBy("file", "at").agg(F.max("path").alias("path"), F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.sum("knot").alias("own"), F.min(F.when(~_blank(F.col("value")), F.col("id"))).alias("seen"))
    before = Window.orderBy("path", "at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    own = own.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "open": F.coalesce(F.sum("own").over(before), F.lit(0))})
    return own.select("file", "at", "path", "low", "base", "open", "own", F.min("base").over(whole).alias("start"), F.min(F.col("base") + F.col("seen") - F.col("low")).over(whole).alias("head"), F.sum("own").over(whole).alias("knots"))


def scan(spark: SparkSession, path: str) -> Delimited:
    """The records of the CSV file or files under `path`, each with a header of its own.

    A record's `row` is the place of its first line in the whole input, files in the order of their paths; `line` is that in its
    file, from 1. Blank lines between records are passed over. Faults: a record of more cells than the header has names, a file
    whose header has other names. A file that ends within a quoted cell raises MalformedInput here, before its rest is put together
    as one cell. Quotes inside an unquoted cell are text, but at its end they would close a cell and are a fault of the file.

    The text is read twice, once for the facts of the splits. Only lines of splits that hold or lie within quoted line ends are
    shuffled."""
    names, header = header_of(spark, path)
    lines = _lines(spark, path)
    splits = _splits(lines)
    files = splits.groupBy("file").agg(F.max("path").alias("path"), F.max("knots").alias("knots"), F.count(F.lit(1)).alias("n"))
    n_splits, unclosed = files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("knots") % 2 == 1)).first()
    if unclosed:
        ends = lines.filter("knot = 1").join(files.filter("knots % 2 = 1").select("file"), "file", "left_semi").join(splits.select("file", "at", "low", "base", "start"), ["file", "at"])
        last = ends.groupBy("path").agg(F.max(F.col("base") - F.col("start") + F.col("id") - F.col("low") + 1).alias("line")).orderBy("path").limit(_NAMED)
        raise MalformedInput([(r["path"], r["line"], "a quoted cell is not closed") for r in last.collect()], unclosed)

    facts = splits.drop("path")
    met = lines.join(F.broadcast(facts) if n_splits <= MAX_BROADCAST_SPLITS else facts, ["file", "at"])
    met = met.withColumn("row", F.col("base") + F.col("id") - F.col("low"))
    kept = ["path", "row", "start", "head", "value"]
    plain = met.filter("own = 0 AND open % 2 = 0").select(*kept, F.lit(0).alias("knot"))
    earlier = Window.partitionBy("file", "at").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    tied = met.filter("NOT (own = 0 AND open % 2 = 0)").withColumn("open", F.col("open") + F.coalesce(F.sum("knot").over(earlier), F.lit(0)))
    single = tied.filter("knot = 0 AND open % 2 = 0").select(*kept, F.lit(0).alias("knot"))
    several = tied.filter("NOT (knot = 0 AND open % 2 = 0)").groupBy((F.expr("open div 2")).alias("stretch")).agg(
        F.max("path").alias("path"), F.min("row").alias("row"), F.max("start").alias("start"), F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("row", "value"))).alias("parts"))
    joined = several.select("path", "row", "start", "head", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"), F.lit(1).alias("knot"))

    records = plain.unionByName(single).unionByName(joined).filter((F.col("knot") == 1) | ~_blank(F.col("value")))
    record = F.regexp_replace("value", r"\r$", "")
    records = records.select("row", "path", (F.col("row") - F.col("start") + 1).alias("line"), (F.col("row") == F.col("head")).alias("first"), record.alias("record"))
    cells, most = _fields(F.col("record")), len(names)
    head = F.replace("record", F.lit(_MARK), F.lit(""))
    other = (cells != most) if '"' in header else head != F.lit(header.removeprefix(_MARK).rstrip("\r"))
    long = F.when(cells > most, F.concat(cells.cast("string"), F.lit(f" cells, where the header has {most}")))
    fault = F.when(F.col("first"), F.when(other, F.lit("a header with other names"))).otherwise(long)
    return Delimited(names, records.withColumn("fault", fault).filter("NOT first OR fault IS NOT NULL"))
