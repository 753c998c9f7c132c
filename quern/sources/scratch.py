"""Tables written for the length of a query, to be computed once: in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

_LOCAL: dict[str, str] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written and read back: its lineage ends there, and a lost executor costs a read. Only where the master is local and the
    setting unset is the folder a local one."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="quern-tables-"))
    path = f"{root.rstrip('/')}/quern-tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_together(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """stored() of tables that don't need each other, their jobs side by side: one of few tasks leaves no executor idle."""
    write = inheritable_thread_target(next(iter(tables.values())).sparkSession)(lambda name: stored(tables[name], name))
    with ThreadPoolExecutor(len(tables)) as pool:
        return dict(zip(tables, pool.map(write, tables), strict=True))
