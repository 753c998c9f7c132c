"""Staged tables between the steps of a run or scheduled tasks: one folder for each run, below one root, on any file system."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from quern.sources.files import delete_folder
from quern.sources.tables import DATASETS

def folder_name(text: str) -> str:
    """A run id as a folder name: each run of characters other than ASCII letters, digits, `_`, `.` and `-` becomes one `_`."""
    return re.sub("[^A-Za-z0-9_.-]+", "_", text)


def stage(tables: Mapping[str, DataFrame], root: str, run_id: str) -> str:
    """Write the tables of a run as Parquet (ordinals included) and return their folder. A repeated task writes them anew."""
    folder = f"{root.rstrip('/')}/{folder_name(run_id)}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def staged(spark: SparkSession, folder: str, names: tuple[str, ...] = DATASETS) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def unstage(spark: SparkSession, folder: str, root: str) -> None:
    """Delete a run's folder. ValueError unless it lies strictly below the root, so a wrong setting deletes nothing."""
    inner, outer = (PurePosixPath(p.split("://")[-1].removeprefix("file:")) for p in (folder, root))
    if ".." in inner.parts or inner == outer or not inner.is_relative_to(outer):
        raise ValueError(f"{folder} is not below {root}")
    delete_folder(spark, folder)
