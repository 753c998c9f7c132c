"""The whole run as four tasks: extract and profile; clean, publish, gate; star schema, invariants, publish; lineage and clean-up."""

from __future__ import annotations

import contextlib
import json
import logging
import logging.handlers
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.operators import cleaning
from quern.operators.profile import profile_all
from quern.operators.quality import QualityGateError, Thresholds, quality_report
from quern.operators.spread import hot_values
from quern.plans import lineage, staging, star
from quern.plans.alerts import Alert, tell
from quern.sources import files, tables
from quern.sources.settings import get_settings, normalization
from quern.sources.weather import fetch_weather, http_get

log = logging.getLogger("quern.run")


@dataclass
class Hooks:
    """Steps that a caller may replace; each has the signature of the step it stands for."""

    customers: Callable = cleaning.clean_customers
    products: Callable = cleaning.clean_products
    judge: Callable = cleaning.judge_sales
    weather: Callable = cleaning.clean_weather
    checks: Callable = quality_report
    save: Callable = tables.save_silver


@dataclass
class Outcome:
    cleaned: dict[str, DataFrame] = field(default_factory=dict)
    rejected: DataFrame | None = None
    gold: dict[str, DataFrame] = field(default_factory=dict)
    preview: dict = field(default_factory=dict)
    report: dict = field(default_factory=dict)


def transform(raw: Mapping[str, DataFrame], settings: Mapping | None = None, hooks: Hooks | None = None, keep: Callable[[str, DataFrame], DataFrame] | None = None, hot: Mapping | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Silver tables and rejected sales: customers and products first, as sales refer to both. Without settings, those of the
    configuration hold. All is lazy, unless `keep` stores what several tables are made of and gives it back. `hot`: see judge_sales()."""
    settings, hooks, keep = settings or get_settings(), hooks or Hooks(), keep or (lambda name, df: df)
    cities, categories, leet = normalization(settings)
    customers = keep("customers", hooks.customers(raw["customers"], cities))
    products = keep("products", hooks.products(raw["products"], categories, leet))
    spread = {"hot": hot} if hot and hooks.judge is cleaning.judge_sales else {}
    judged = keep("judged", hooks.judge(raw["sales"], customers, products, **spread))
    cleaned = {"customers": customers, "products": products, "sales": cleaning.accepted_sales(judged), "weather_daily": hooks.weather(raw["weather_daily"])}
    return cleaned, cleaning.rejected_sales(judged)


def install_log(settings: Mapping) -> logging.Logger:
    """A rotating file and the console on the library's logger, once."""
    root, cfg = logging.getLogger("quern"), settings["logging"]
    if not root.handlers:
        Path(cfg["file"]).parent.mkdir(parents=True, exist_ok=True)
        for handler in (logging.StreamHandler(), logging.handlers.RotatingFileHandler(cfg["file"], maxBytes=cfg["max_bytes"], backupCount=cfg["backup_count"], encoding="utf-8")):
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            root.addHandler(handler)
        root.setLevel(cfg["level"])
    return root


def _root(settings: Mapping) -> str:
    return f"{settings['paths']['silver_dir'].rstrip('/')}/_staged"


def _folder(settings: Mapping, run_id: str) -> str:
    return f"{_root(settings)}/{staging.folder_name(run_id)}"


# The four tasks of a scheduled run. Each can run in a process of its own: tables pass through the run's staging folder, and what
# else the next ones need through the notes that a task returns. A task that is tried again writes its tables anew.


def _whole(text: str) -> int | None:
    """An id out of its cell as sales are judged, or None."""
    try:
        number = float(text)
        return int(number) if number.is_integer() else None
    except (ValueError, OverflowError):
        return None


def extract_task(spark: SparkSession, settings: Mapping, run_id: str, use_weather_service: bool = False, get: Callable = http_get, quarantine: str | None = None, story: lineage.RunLog | None = None) -> dict:
    """Reads the raw files once, into the staging folder, and profiles them. Without the weather service its file must be there."""
    story = story or lineage.RunLog("scheduled", name=run_id)
    paths = tables.source_paths(settings)
    story.figures["fetch_weather"] = use_weather_service
    if use_weather_service:
        with story.stage("extract_weather"):
            tables.write_table(fetch_weather(spark, settings, get), paths["weather_daily"], "csv", single=True)
    elif not files.exists(spark, paths["weather_daily"]):
        raise FileNotFoundError(f"{paths['weather_daily']} is needed when the weather service is not used")
    with story.stage("extract"):
        raw, counts = tables.stage_sources(spark, paths, f"{_folder(settings, run_id)}/raw", quarantine)
        story.figures["rows"] = {"extracted": counts}
    with story.stage("profile"):
        found = profile_all({name: df.drop(cleaning.ORDINAL) for name, df in raw.items()})["sales"]
        hot = hot_values({c: found["top"].get(c, ()) for c in ("customer_id", "product_id")}, found["rows"])
        story.figures["hot"] = {c: [n for n in map(_whole, values) if n is not None] for c, values in hot.items()}
    return story.notes()


def transform_task(spark: SparkSession, settings: Mapping, run_id: str, notes: Mapping | None = None, hooks: Hooks | None = None, single: bool = False, story: lineage.RunLog | None = None) -> dict:
    """Cleans the staged rows, publishes silver and then holds it against the gate, so a run that fails there can be looked into.
    Each table is computed once: sales are judged into the staging folder."""
    hooks, story = hooks or Hooks(), story or lineage.RunLog("scheduled", name=run_id)
    story.take(notes or {})
    folder = _folder(settings, run_id)

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/clean/{name}")
        return spark.read.parquet(f"{folder}/clean/{name}")

    with story.stage("transform"):
        raw = staging.staged(spark, f"{folder}/raw")
        cleaned, rejected = transform(raw, settings, hooks, keep, story.figures.get("hot"))
        observed = hooks.save(cleaned, rejected, settings, single)
        # what follows reads the saved tables: a lost executor costs a read
        cleaned = tables.read_silver(spark, settings)
        rejected = tables.read_rejected(spark, tables.published(spark, settings, "silver")["rejected_sales"], rejected.schema)
        if observed:
            extracted = story.figures.get("rows", {}).get("extracted") or {n: df.count() for n, df in raw.items()}
            story.balance(extracted, {n: observed[n]["rows"] for n in cleaned}, {"sales": observed["rejected"]["rows"]})
        else:  # by a saver of the caller's own
            story.count(lineage.accounts(raw, cleaned, {"sales": rejected}))
        for name, n in story.figures["rows"]["cleaned"].items():
            log.info("cleaned %s: %s rows, %s columns", name, n, len(cleaned[name].columns))
    with story.stage("quality"):
        known = {"counts": observed} if observed and hooks.checks is quality_report else {}
        story.figures["quality"] = hooks.checks(cleaned, rejected, Thresholds(**settings["quality"]), **known)
    return story.notes()


def load_task(spark: SparkSession, settings: Mapping, run_id: str, notes: Mapping | None = None, single: bool = False, database: str | None = None, story: lineage.RunLog | None = None) -> dict:
    """Builds gold from the published silver in the staging folder, checks it there, and publishes what was checked; with a
    `database` the tables' names are turned to it, too."""
    story = story or lineage.RunLog("scheduled", name=run_id)
    story.take(notes or {})
    with story.stage("load"):
        limits, folder = settings["analytics"]["buckets"], _folder(settings, run_id)
        gold = star.build(tables.read_silver(spark, settings), star.Buckets(**limits["rain"], **limits["temperature"]))
        staging.stage({t: gold[t] for t in tables.STAR}, folder, "gold")
        gold = staging.staged(spark, f"{folder}/gold", tables.STAR)
        staging.stage({tables.MART: star.mart_of(gold)}, folder, "gold")
        gold |= staging.staged(spark, f"{folder}/gold", (tables.MART,))
        star.require(gold)
        tables.save_gold(gold, settings, single)
        if database is not None:
            tables.publish_tables(gold, database)
        found = tables.preview(gold[tables.MART])
        story.figures |= {"mart": {k: found[k] for k in ("rows", "columns")}, "mart_preview": {"rows": len(found["preview"]), "columns": found["columns"]}}
    return story.notes()


def cleanup_task(spark: SparkSession, settings: Mapping, run_id: str, extract: Mapping | None, transform: Mapping | None, load: Mapping | None, error: BaseException | None = None, story: lineage.RunLog | None = None, kept: bool = False) -> dict:
    """To be run however the tasks before ended, with the notes of those that did (None for others): marks the artifacts, the
    staged ones before their folder is deleted, and writes the lineage report, which is passed only if transform and load were
    done. Returns the report; its summary is logged."""
    story = story or lineage.RunLog("scheduled", name=run_id)
    for notes in (extract, transform, load):
        story.take(notes or {})
    with story.stage("cleanup"):
        folder = _folder(settings, run_id)
        outputs: dict[str, str] = {}
        for layer in tables.POINTERS:
            with contextlib.suppress(FileNotFoundError):
                outputs |= tables.published(spark, settings, layer)
        staged = {name: f"{folder}/raw/{name}" for name in tables.DATASETS}
        story.marks = lineage.marks(spark, inputs=tables.source_paths(settings), staged_inputs=staged, final_outputs=tables.artifact_paths(settings) | outputs)
        there = files.exists(spark, folder)
        if there and not kept:
            staging.unstage(spark, folder, _root(settings))
        story.figures["extra"] = {"cleanup": {"status": "kept" if kept else "deleted" if there else "not_found", "stage_dir": folder}}
    done = transform is not None and load is not None
    report = story.report(error or (None if done else RuntimeError("transform or load was not done")))
    path = lineage.keep(spark, report, settings["paths"].get("lineage_dir", "logs/lineage"))
    log.info("summary %s", json.dumps(lineage.summary(report) | {"lineage_path": path}, sort_keys=True, default=str))
    return report


def run_pipeline(spark: SparkSession, settings: Mapping | None = None, use_weather_service: bool = False, hooks: Hooks | None = None, get: Callable = http_get, single: bool = False, database: str | None = None, quarantine: str | None = None) -> Outcome:
    """One full refresh: the four tasks in one process. Silver is published before the gate; gold only when it was checked. The
    lineage report is written in any case, and errors are raised again after it. `single`: every output is one file, at its plain
    path, too. `quarantine`: where malformed records go, which otherwise end the run."""
    settings, hooks = settings or get_settings(), hooks or Hooks()
    out, story, fault = Outcome(), lineage.RunLog(), None
    steps: dict[str, dict | None] = dict.fromkeys(("extract", "transform", "load"))
    try:
        steps["extract"] = extract_task(spark, settings, story.run_id, use_weather_service, get, quarantine, story)
        steps["transform"] = transform_task(spark, settings, story.run_id, None, hooks, single, story)
        steps["load"] = load_task(spark, settings, story.run_id, None, single, database, story)
    except Exception as e:
        fault, blocked = e, isinstance(e, QualityGateError)
        if blocked:
            story.figures["quality"] = e.report
        tell(Alert("Pipeline failed", "A run did not finish.", "critical" if blocked else "high", {"run_id": story.run_id, "error": f"{type(e).__name__}: {e}"}))
        raise
    finally:
        if steps["transform"]:
            out.cleaned = tables.read_silver(spark, settings)
            rejected = tables.published(spark, settings, "silver")["rejected_sales"]
            out.rejected = tables.read_rejected(spark, rejected, T.StructType([T.StructField(c, T.StringType()) for c in (*cleaning.SALES_COLUMNS, "reject_reasons")]))
        if steps["load"]:  # gold that is exported as CSV alone stays readable in the staging folder
            exported = tables.read_gold(spark, settings)
            out.gold = exported or staging.staged(spark, f"{_folder(settings, story.run_id)}/gold", (*tables.STAR, tables.MART))
            out.preview = tables.preview(out.gold[tables.MART])
        try:
            out.report = cleanup_task(spark, settings, story.run_id, **steps, error=fault, story=story, kept=bool(out.gold) and not exported)
        except Exception:
            log.exception("the lineage report was not written")
    return out


def main() -> None:
    """`python -m quern.plans.run [settings file]`: one refresh from the files there are, logged to a rotating file."""
    from quern.session import build_session

    settings = get_settings(sys.argv[1] if len(sys.argv) > 1 else None)
    install_log(settings)
    spark = build_session("quern")
    run_pipeline(spark, settings)
    spark.stop()


if __name__ == "__main__":
    main()
