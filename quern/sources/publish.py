"""Publication of several tables as one: folders of versions that never change, and a pointer that is swapped last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from quern.sources import files

VERSIONS, POINTER = "_versions", "_current.json"
#: Versions that are kept: the current one, and the one before for those who still read it.
KEPT = 2


def new_version() -> str:
    """A name that no other version has; names ascend with time."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S%fZ}-{uuid.uuid4().hex[:8]}"


def point(spark: SparkSession, root: str, version: str, artifacts: Mapping[str, str]) -> None:
    """Make `version` the current one of what is published at `root`; versions that no one should read any more go."""
    before = _pointer(spark, root)
    files.swap_text(spark, f"{root}/{POINTER}", json.dumps({"version": version, "before": (before or {}).get("version"), "artifacts": dict(artifacts)}, sort_keys=True, indent=1))
    for folder in sorted({path.partition(f"/{VERSIONS}/")[0] for path in artifacts.values()}):
        forget(spark, f"{folder}/{VERSIONS}", (version, (before or {}).get("version")))


def forget(spark: SparkSession, home: str, kept: tuple[str | None, ...] = ()) -> None:
    """Delete the versions below `home` but those in `kept` or, if none are named, the KEPT latest."""
    fs, at = files.hadoop(spark, home)
    if not fs.exists(at):
        return
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    for name in [n for n in names if n not in kept] if kept else names[:-KEPT]:
        files.delete_folder(spark, f"{home}/{name}")


def _pointer(spark: SparkSession, root: str) -> dict | None:
    text = files.read_text(spark, f"{root}/{POINTER}")
    return json.loads(text) if text else None


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """The artifacts of the current version, by name; FileNotFoundError if nothing was published."""
    found = _pointer(spark, root)
    if found is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    return found["artifacts"]


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file, which takes the target's place when it is whole."""
    fresh = files.beside(target)
    (fs, a), (other, b) = files.hadoop(spark, source), files.hadoop(spark, fresh)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, True, spark._jsparkSession.sessionState().newHadoopConf())
    files.replace(spark, fresh, target)
