"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontamination import find_leaks
from quern.llm.fingerprints import fingerprint_documents
from quern.llm.hnsw import neighbours
from quern.llm.language import held_out, identify, learnable, train
from quern.llm.merkle import lowered, proofs
from quern.llm.mixing import mix_sources
from quern.llm.prefixtrie import steps_of, trie, turns_of
from quern.llm.pseudolikelihood import score_documents
from quern.llm.sharding import shard_documents
from quern.llm.simhash import cluster
from quern.llm.tokencounts import count_tokens
from quern.llm.tokenfiles import encode_and_read
from quern.llm.warc import archive_and_read


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records with revisits, written and read back."""
    return archive_and_read(_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents over a vocabulary of 32,000 pieces."""
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.filter(learnable()).select("lang", "text"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the square root of their bytes over one epoch: the copies of each document, with their text, in shuffled order."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"), epochs=1.0, seed=42)
    return mixed.select("doc_id", "copy", "source", "rate", "shuffle_key", "text")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids in Simple-8b files, read back."""
    import public_tokenizers

    return encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)


def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty contiguous shards of near-equal bytes."""
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.crc32("text").alias("text_crc32"), "text")
    # the operator needs the text only for its size, so a digest of it stands in the laid-out table
    sized = docs.select("doc_id", "text_crc32", F.octet_length("text").alias("n_bytes"))
    placed = shard_documents(sized, shards=40, key="doc_id", text=None, n_bytes="n_bytes", tie="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the likenesses."""
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-log-likelihood of all documents under a network trained on all of them."""
    return score_documents(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document for each benchmark item that it holds."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("distance")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of those within two bits."""
    found = cluster(_table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, with proofs, and folds after lower-casing the texts of a third of them."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = proofs(_table(spark, sf_dir, "documents"), changed={"text": lowered(F.col("text"))}, where=third)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each begun anew with up to five turns of the first of its hundred."""
    conv = F.col("conv")
    heads = F.crc32(conv.cast("string").cast("binary")) % 6
    return trie(steps_of(turns_of(_table(spark, sf_dir, "conversations")), base=conv - conv % 100, heads=heads, most=5))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100, among all others."""
    return neighbours(_table(spark, sf_dir, "embeddings"), asked=F.col("id") % 100 == 0, k=10)


QUERIES = {f.__name__: f for f in (op1_warc_pages, op2_token_counts, op3_language_id, op4_mix_sources, op5_token_files, op6_shard_documents, op7_fingerprints, op8_lm_scores, op9_decontamination, op10_simhash_components, op11_merkle_manifest, op12_prefix_trie, op13_nearest_neighbours)}
