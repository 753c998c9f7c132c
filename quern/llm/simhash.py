"""SimHash near-duplicates by pivot distance tables.

The reference fingerprints (pivots) are zero, the 32 masks of two neighbouring bits, and pseudo-random ones. A
fingerprint's table holds its Hamming distances to all of them. By the triangle inequality two fingerprints within a
radius differ by at most the radius in each coordinate. The coordinates of masks less that of zero count the set bits of a
pair of bits, so two fingerprints within r bits agree in all coordinates of all but r groups of masks: pairs that share
the coordinates of some choice of groups are candidates, those with a larger coordinate difference anywhere are discarded,
and the rest are verified by their own Hamming distance. No pair within the radius is lost."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.graph import components
from quern.llm.storage import bound_batches, materialise

RADIUS = 2
#: Groups of masks for the candidate search: of these, all but RADIUS have to agree.
GROUPS = 4
#: Pseudo-random reference fingerprints, which only discard candidates.
RANDOM_PIVOTS = 15
#: Pairs within a bucket are compared up to so many members; larger buckets are linked by common neighbours, as exactly.
BUCKET = 64
#: Hashes whose bits are summed at once.
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(3 << 2 * i) for i in range(32)]
PIVOTS = [0, *MASKS, *(_signed(xxhash.xxh64_intdigest(str(i), 7)) for i in range(RANDOM_PIVOTS))]


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `size` words, joined by spaces, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.array([xxhash.xxh64_intdigest(x, seed) for x in runs], np.uint64)


def ascii_words(text: str) -> list[bytes]:
    """Runs without ASCII white space, A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class MajorityBits:
    """Fingerprints of documents given one after another: bit sums of all of them in few array operations."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.out: list[int] = []

    def add(self, hashes: np.ndarray) -> None:
        if len(hashes) > _CHUNK:
            self._flush()
            counts = np.zeros(64, np.int64)
            for i in range(0, len(hashes), _CHUNK):
                counts += _bits(hashes[i : i + _CHUNK]).sum(axis=0, dtype=np.int64)
            self.out.append(_pack(counts[None, :], np.array([len(hashes)]))[0])
            return
        self.parts.append(hashes)
        self.held += len(hashes)
        if self.held > _CHUNK:
            self._flush()

    def _flush(self) -> None:
        lengths = np.array([len(x) for x in self.parts], np.int64)
        found = np.zeros((len(lengths), 64), np.int64)
        full = np.flatnonzero(lengths)
        if len(full):
            starts = (np.cumsum(lengths) - lengths)[full]
            found[full] = np.add.reduceat(_bits(np.concatenate(self.parts)), starts, axis=0, dtype=np.int32)
        self.out += _pack(found, lengths)
        self.parts, self.held = [], 0

    def take(self) -> list[int]:
        self._flush()
        out, self.out = self.out, []
        return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _pack(counts: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Signed 64-bit fingerprints: a bit is 1 if set in over half the hashes."""
    return np.packbits(2 * counts > lengths[:, None], axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel().tolist()


def _fingerprints(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            majority = MajorityBits()
            for text in batch.column(1).to_pylist():
                majority.add(shingle_hashes(ascii_words(text or ""), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority.take(), pa.int64())], names=["key", "fp"])

    return rows


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp): the 64-bit SimHash of each whole text's word shingles (repeats included). A text without words has zero."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(size), f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def distance_tables(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (unsigned) to all reference fingerprints."""
    return np.bitwise_count(prints[:, None] ^ np.array(PIVOTS, np.int64).view(np.uint64)).astype(np.int64)


def search_keys(prints: np.ndarray, salts: np.ndarray, radius: int, groups: int) -> np.ndarray:
    """For each fingerprint and each choice of `groups - radius` groups of masks, a hash of the salt and of the chosen
    coordinates less that of zero. Equal coordinates give equal keys; that others may, too, costs a comparison."""
    tables = distance_tables(prints)
    coordinates = (tables[:, 1 : 1 + len(MASKS)] - tables[:, :1] + 3).astype(np.uint64)
    weights = np.array([xxhash.xxh64_intdigest(str(i), 9) | 1 for i in range(len(MASKS) + 2)], np.uint64)
    weighted = coordinates * weights[: len(MASKS)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(np.array_split(np.arange(len(MASKS)), groups), groups - radius)):
        key = weighted[:, np.concatenate(chosen)].sum(axis=1) + salts.astype(np.uint64) * weights[-1] + np.uint64((n + 1) * int(weights[-2]) % (1 << 64))
        key ^= key >> np.uint64(31)
        keys.append(key * np.uint64(0x9E3779B97F4A7C15))
    return np.stack(keys, axis=1)


def _keyed(radius: int, groups: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, prints = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            keys = search_keys(prints.view(np.uint64), salts, radius, groups)
            n = keys.shape[1]
            arrays = [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(salts, n)), pa.array(np.repeat(prints, n))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "t", "fp"])

    return rows


def links_within(prints: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """Links (t, u, v) that connect the distinct fingerprints (t, fp) exactly as all pairs of one `t` within `radius` bits do.

    Buckets of up to BUCKET members give all their pairs that the tables leave and the distance confirms. Members of larger
    buckets are linked by common neighbours: two of them are within 2 bits if and only if some value is within one bit of
    both, and all that share such a value (65 at most) are within 2 bits of each other, so a link of each to the least of
    them loses no connection. Rows stay proportional to the fingerprints however dense a group is. `radius` is 1 or 2."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    keyed = prints.select(F.col("t").cast("int").alias("t"), "fp").mapInArrow(_keyed(radius, groups), "key long, t int, fp long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(keyed.join(sizes, "key"), "buckets")
    small = shared.filter(F.col("n") <= BUCKET).select("key", "t", "fp")
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.select("a.t", F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    gaps = F.transform(F.lit(PIVOTS), lambda p: F.abs(F.bit_count(F.col("u").bitwiseXOR(p)) - F.bit_count(F.col("v").bitwiseXOR(p))))
    near = pairs.filter(F.array_max(gaps) <= radius).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    dense = shared.filter(F.col("n") > BUCKET).select("t", "fp").distinct()
    flips = F.lit([0, *[_signed(1 << i) for i in range(64)]])
    around = dense.select("t", "fp", F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("mid"))
    cliques = around.groupBy("t", "mid").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)  # 65 at most
    if radius == 1:  # two values within one bit share each of themselves, so a member links to those around it
        cliques = cliques.filter(F.array_contains("members", F.col("mid")))
    star = cliques.select("t", (F.array_min("members") if radius == 2 else F.col("mid")).alias("u"), F.explode("members").alias("v")).filter("u != v")
    star = star.select("t", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return near.union(star).distinct()


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) for each row: fingerprints link at `radius` or fewer differing bits, and component_id is the
    smallest key reachable (null keys are passed over; it is null where a component has no other). Equal fingerprints always
    link, those of texts without words (zero) included. Rows that repeat each give a row; an empty table gives an empty
    result; columns other than key and text are not read.

    Equal fingerprints are first combined to one row, so groups of exact copies cost nothing further."""
    prints = materialise(fingerprints(docs, key, text, size), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    links = links_within(distinct.select(F.lit(0).alias("t"), "fp"), radius)
    roots = components(links.select("u", "v"))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.filter("fp != root").groupBy("root").agg(F.min("least").alias("other"))
    whole = least.join(distinct.withColumnRenamed("fp", "root"), "root").select("root", F.least("other", "least").alias("component_id"))
    found = materialise(grouped.join(whole, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return prints.join(found, "fp").select(F.col("key").alias(key), "fp", "component_id")
