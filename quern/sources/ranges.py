"""SHA-256 of files of any size: a hash tree over byte ranges of one size, read by the partitions of a Python data source."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range. It is part of what a digest means, so it does not follow the number of tasks.
RANGE = 64 << 20
#: Digests under one node of the tree, and ranges that one task reads.
FAN, TASK_RANGES = 1024, 8
_PIECE = 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


@dataclass
class Stretch(InputPartition):
    path: str
    first: int
    ranges: int
    length: int


class RangeReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], length: int):
        self.files, self.length = files, length

    def partitions(self) -> list[Stretch]:
        out = []
        for path, size in self.files:
            ranges = max(1, -(-size // self.length))
            out += [Stretch(path, i, min(TASK_RANGES, ranges - i), self.length) for i in range(0, ranges, TASK_RANGES)]
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        fs, path = _open(part.path)
        with fs.open_input_file(path) as f:
            for i in range(part.first, part.first + part.ranges):
                f.seek(i * part.length)
                left, state = part.length, hashlib.sha256()
                while left and (data := f.read(min(left, _PIECE))):
                    state.update(data)
                    left -= len(data)
                yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([i], pa.int64()), pa.array([state.hexdigest()])], names=["path", "at", "digest"])


class ByteRanges(DataSource):
    """Options: files (JSON: [path, bytes] each) and length."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, at long, digest string"

    def reader(self, schema) -> RangeReader:
        return RangeReader([tuple(x) for x in json.loads(self.options["files"])], int(self.options["length"]))


def digests(spark: SparkSession, files: Sequence[tuple[str, int]], length: int = RANGE) -> DataFrame:
    """(path, digest) of files (path, bytes): of a file of one range the SHA-256 of its bytes, of others that of the hex digests of its
    ranges, in their order, FAN at a time, and again of those until one is left. Equal bytes have equal digests whatever tasks there
    are; no group has more than FAN rows, and tasks hold one piece of a range."""
    spark.dataSource.register(ByteRanges)
    found = spark.read.format("byte_ranges").options(files=json.dumps([list(f) for f in files]), length=str(length)).load()
    most = max([1, *(-(-size // length) for _, size in files)])
    while most > 1:
        nodes = found.groupBy("path", F.expr(f"at div {FAN}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("under"))
        joined = F.sha2(F.array_join(F.transform("under", lambda x: x["digest"]), "").cast("binary"), 256)
        found = nodes.select("path", "at", F.when(F.size("under") == 1, F.element_at("under", 1)["digest"]).otherwise(joined).alias("digest"))
        most = -(-most // FAN)
    return found.select("path", "digest")
