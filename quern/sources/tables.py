"""Reading raw CSV and silver Parquet; writing silver, rejected and gold tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.cleaning import ORDINAL, SALES_COLUMNS
from quern.operators.quality import CONTRACTS, table_counts
from quern.sources import delimited, files, publish
from quern.sources.delimited import QUOTES
from quern.sources.files import exists
from quern.sources.publish import VERSIONS
from quern.sources.settings import FORMATS

log = logging.getLogger("quern.tables")

#: Cells of a CSV file that count as missing (fixed values).
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
DATASETS = ("customers", "products", "sales", "weather_daily")
STAR = ("dim_customers", "dim_products", "dim_weather", "fact_sales")
MART = "weather_sales_mart"
#: Sort columns of the exported tables.
EXPORT_ORDER = {"dim_customers": ["customer_id"], "dim_products": ["product_id"], "dim_weather": ["date", "city"], "fact_sales": ["sale_id"], MART: ["sale_date", "city", "category"]}


def _present(df: DataFrame) -> DataFrame:
    """Text columns with the cells that mean nothing as nulls."""
    return df.select(*[F.when(F.col(c).isin(*MISSING), None).otherwise(F.col(c)).alias(c) if c != ORDINAL else F.col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text with missing cells null, and the row's place in the whole input in `_row`. The header names the columns;
    quoted cells may hold commas, doubled quotes and line ends, and one file is read by many tasks. A file without a header
    raises ValueError; records of more cells than the header, and cells that are not closed, raise MalformedInput (a ValueError)
    that names file and line. Records of fewer cells end in nulls."""
    found = delimited.scan(spark, path)
    found.require()
    return _present(found.rows(ORDINAL))


def _require_all(spark: SparkSession, paths: Mapping[str, str]) -> None:
    lacking = [p for p in paths.values() if not exists(spark, p)]
    if lacking:
        raise FileNotFoundError(f"missing inputs: {', '.join(lacking)}")


def read_sources(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """All datasets; every path must exist before anything is read."""
    _require_all(spark, paths)
    return {name: read_csv(spark, p) for name, p in paths.items()}


def stage_sources(spark: SparkSession, paths: Mapping[str, str], folder: str, quarantine: str | None = None) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """All datasets, each parsed once into Parquet below `folder`, and their numbers of rows, observed on the way. Records that cannot
    be read go to `quarantine`/<dataset> (path, line, fault, record), and without one raise MalformedInput, as in read_csv()."""
    _require_all(spark, paths)
    staged, counts = {}, {}
    for name, path in paths.items():
        found, seen = delimited.scan(spark, path), Observation()
        watched = replace(found, records=found.records.observe(seen, F.count_if(F.col("fault").isNull()).alias("rows"), F.count_if(F.col("fault").isNotNull()).alias("faults")))
        _present(watched.rows(ORDINAL)).write.mode("overwrite").parquet(f"{folder}/{name}")
        if quarantine is not None:
            found.faults().write.mode("overwrite").parquet(f"{quarantine}/{name}")
        elif seen.get["faults"]:
            found.require()
        staged[name], counts[name] = spark.read.parquet(f"{folder}/{name}"), seen.get["rows"]
        log.info("extracted %s: %s rows of %s", name, counts[name], path)
    return staged, counts


def source_paths(settings: Mapping) -> dict[str, str]:
    return {name: f"{settings['paths']['raw_dir']}/{name}.csv" for name in DATASETS}


def to_contract(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The published columns in order; others are dropped and named in the log."""
    if extra := [c for c in df.columns if c not in columns]:
        log.warning("dropping columns outside the contract: %s", extra)
    return df.select(*columns)


def write_table(df: DataFrame, path: str, fmt: str, single: bool = False, order: Sequence[str] = ()) -> None:
    """Write as Parquet or CSV with a header, replacing what was there, in parallel and range-sorted by `order`. `single`: one
    file of that very name, for small tables that a person opens; it takes the old one's place when it is whole."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format: {fmt}")
    if order:
        df = df.orderBy(*order)
    folder = files.beside(path) if single else path
    writer = (df.coalesce(1) if single else df).write.mode("overwrite")
    writer.parquet(folder) if fmt == "parquet" else writer.options(header="true", **QUOTES).csv(folder)
    if single:
        (part,) = files.data_files(df.sparkSession, folder)
        files.replace(df.sparkSession, part.path, path)
        files.delete_folder(df.sparkSession, folder)


def read_rejected(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rejected sales as write_table() wrote them."""
    return spark.read.options(multiLine="true", **QUOTES).csv(path, header=True, schema=schema)


def artifact_paths(settings: Mapping, version: str | None = None) -> dict[str, str]:
    """Every output of a run, by name: where `version` of it lies, or its plain path, which runs that export single files keep up."""
    paths, exports = settings["paths"], settings["exports"]
    root = lambda folder: f"{paths[folder]}/{VERSIONS}/{version}" if version else paths[folder]
    out = {f"silver_{n.removesuffix('_daily')}": f"{root('silver_dir')}/{n}_clean.parquet" for n in DATASETS}
    out["rejected_sales"] = f"{root('rejected_dir')}/sales_rejected.csv"
    folders = {"csv": root("gold_csv_dir"), "parquet": root("gold_parquet_dir")}
    out |= {f"gold_mart_{f}": f"{folders[f]}/marts/{MART}.{f}" for f in exports["mart_formats"]}
    return out | {f"gold_{t}_{f}": f"{folders[f]}/star_schema/{t}.{f}" for t in STAR for f in exports["star_schema_formats"]}


#: The layers that are published as a whole, and where the pointer of each lies.
POINTERS = {"silver": "silver_dir", "gold": "gold_parquet_dir"}


def _layer(settings: Mapping, layer: str, version: str | None) -> dict[str, str]:
    return {n: p for n, p in artifact_paths(settings, version).items() if n.startswith("gold_") == (layer == "gold")}


def _export(tables: Mapping[str, tuple[DataFrame, str, Sequence[str]]], settings: Mapping, layer: str, version: str, single: bool) -> None:
    """Publish `tables` (table, format, order; by artifact) as a whole: all are written into folders of this version, which
    nothing changes again; then the layer's pointer is swapped, so readers see the old version or the new one, whatever fails.
    With `single` each is one file, and the plain paths get copies of it, each in one step. The version before stays for those
    who still read it; older ones go."""
    at = _layer(settings, layer, version)
    for name, (df, fmt, order) in tables.items():
        write_table(df, at[name], fmt, single, order)
    spark = next(iter(tables.values()))[0].sparkSession
    publish.point(spark, settings["paths"][POINTERS[layer]], version, at)
    if single:
        for name, path in _layer(settings, layer, None).items():
            publish.copy(spark, at[name], path)


def save_silver(cleaned: Mapping[str, DataFrame], rejected: DataFrame, settings: Mapping, single: bool = False, version: str | None = None) -> dict[str, dict[str, int]]:
    """Publish the silver tables and the rejected sales as a whole. Returns what was observed while they were written: the gate's
    table_counts() of each, and the rows of `rejected`."""
    seen = {n: Observation() for n in (*DATASETS, "rejected")}
    kept = {n: to_contract(cleaned[n], list(CONTRACTS[n])) for n in DATASETS}
    kept = {n: df.observe(seen[n], *[c.alias(k) for k, c in table_counts(n, df).items()]) for n, df in kept.items()}
    bad = to_contract(rejected, [*SALES_COLUMNS, "reject_reasons"]).observe(seen["rejected"], F.count(F.lit(1)).alias("rows"))
    out = {f"silver_{n.removesuffix('_daily')}": (df, "parquet", ()) for n, df in kept.items()}
    _export(out | {"rejected_sales": (bad, "csv", ())}, settings, "silver", version or publish.new_version(), single)
    return {n: dict(o.get) for n, o in seen.items()}


def published(spark: SparkSession, settings: Mapping, layer: str) -> dict[str, str]:
    """Where the artifacts of a layer's current version lie, by name; FileNotFoundError if none was published."""
    return publish.current(spark, settings["paths"][POINTERS[layer]])


def read_silver(spark: SparkSession, settings: Mapping) -> dict[str, DataFrame]:
    """The silver tables of the current version."""
    paths = published(spark, settings, "silver")
    return {name: spark.read.parquet(paths[f"silver_{name.removesuffix('_daily')}"]) for name in DATASETS}


def save_gold(gold: Mapping[str, DataFrame], settings: Mapping, single: bool = False, version: str | None = None) -> None:
    """Publish all exports of the gold tables as a whole."""
    out = {}
    for table in (*STAR, MART):
        for fmt in settings["exports"]["mart_formats" if table == MART else "star_schema_formats"]:
            out[f"gold_{'mart' if table == MART else table}_{fmt}"] = gold[table], fmt, EXPORT_ORDER[table]
    _export(out, settings, "gold", version or publish.new_version(), single)


def read_gold(spark: SparkSession, settings: Mapping) -> dict[str, DataFrame]:
    """All gold tables of the current version from their Parquet exports; empty if some are exported as CSV alone."""
    paths = published(spark, settings, "gold")
    names = {t: f"gold_{'mart' if t == MART else t}_parquet" for t in (*STAR, MART)}
    return {t: spark.read.parquet(paths[n]) for t, n in names.items()} if {*names.values()} <= {*paths} else {}


def publish_tables(gold: Mapping[str, DataFrame], database: str | None = None, version: str | None = None) -> None:
    """Full refresh of the tables by name: all are written into a new folder in the database's own, and then each name is turned to
    it, which is a step in the catalog alone. No name is without its table meanwhile, whatever fails."""
    spark = next(iter(gold.values())).sparkSession
    name = database or spark.catalog.currentDatabase()
    home = f"{spark.catalog.getDatabase(name).locationUri.rstrip('/')}/{VERSIONS}"
    folder = f"{home}/{version or publish.new_version()}"
    for table in (*STAR, MART):
        write_table(gold[table], f"{folder}/{table}", "parquet")
    for table in (*STAR, MART):
        named = f"`{name}`.`{table}`"
        if spark.catalog.tableExists(f"{name}.{table}") and spark.catalog.getTable(f"{name}.{table}").tableType != "VIEW":
            spark.sql(f"DROP TABLE {named}")  # of an earlier release, which kept tables
        spark.sql(f"CREATE OR REPLACE VIEW {named} AS SELECT * FROM parquet.`{folder}/{table}`")
    publish.forget(spark, home)


def first_rows(mart: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows of the mart in its order."""
    return mart.orderBy(*EXPORT_ORDER[MART]).limit(n)


def preview(mart: DataFrame, n: int = 10) -> dict:
    """The first n rows of the mart and its size."""
    return {"rows": mart.count(), "columns": len(mart.columns), "preview": [r.asDict() for r in first_rows(mart, n).collect()]}
