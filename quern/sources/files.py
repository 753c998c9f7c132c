"""Files on any file system that Spark reads and writes, from the driver: listings, small texts, deletion and replacement."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    fs, p = hadoop(spark, path)
    return fs.exists(p)


@dataclass(frozen=True)
class DataFile:
    path: str
    size: int
    modified: int


def data_files(spark: SparkSession, path: str) -> list[DataFile] | None:
    """The file itself, or a folder's data files (no markers) in the order of their paths; None if there is nothing."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return None
    found, listing = [], fs.listFiles(p, True)
    while listing.hasNext():
        f = listing.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append(DataFile(f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found, key=lambda f: f.path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, on any file system that Spark writes."""
    fs, p = hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if it isn't there."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file onto another, in one step where the file system can: readers see the old one or the new one."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs, there = hadoop(spark, target)
    if fs.exists(there) and fs.getFileStatus(there).isDirectory():  # of an earlier run that wrote folders
        fs.delete(there, True)
    fs.mkdirs(there.getParent())
    overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(hadoop(spark, source)[1], there, overwrite)


def beside(path: str) -> str:
    """A new hidden name next to a path."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}-{uuid.uuid4().hex}"


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """write_text() in one step: readers see the old text or the new one."""
    fresh = beside(path)
    write_text(spark, fresh, text)
    replace(spark, fresh, path)
