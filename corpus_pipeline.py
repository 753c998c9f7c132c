"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and sharding of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.decontamination import remove_leaks
from quern.llm.language import UNDETERMINED, identify, learnable, train
from quern.llm.mixing import mix_sources
from quern.llm.neardup import keep_one_of_each
from quern.llm.sharding import shard_documents
from quern.llm.storage import materialise

#: The columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with `lang` as predicted. Those without text (null or empty) or without a letter
    go; rows that repeat and equal texts are treated alike; without labelled rows no language is known and all go. Columns
    other than those of documents are dropped. An empty table gives an empty result."""
    model = train(docs.filter(learnable()).select("lang", "text"))
    found = identify(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id (nulls last, then by a digest of the text), of each class of equal or
    near-equal texts. Null and empty texts are one class; rows that repeat leave one; other columns are dropped."""
    return keep_one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A document goes by its own text: one that shares its doc_id (or a null one) with
    it stays. Null and empty texts hold nothing; rows that repeat stay or go together; other columns are dropped."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by the square root of their bytes over one epoch: documents repeat or go as their Poisson counts say, which a
    hash of the doc_id gives (rows alike in it repeat alike). A null source is one of its own; null texts count one byte."""
    return mix_sources(docs, epochs=1.0, seed=42).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty contiguous shards of near-equal bytes in a global pseudo-random order, each row with its text, shard and slot.
    The order is that of a hash of document and copy, so neither copies nor sources lie together, and is the same on every
    run. Nulls in any column are hashed as such, a null text has size 16; other columns stay, with those added last."""
    alike = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(*COLUMNS)]  # copies agree in all columns
    ranked = docs.withColumn("copy", F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(1))))
    mixed = ranked.withColumn("mixed", F.xxhash64(F.lit("shards|42"), *alike, "copy")).drop("copy")
    return shard_documents(mixed, shards=40, key="mixed").drop("mixed")


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Language ID and near-duplicate removal have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
