"""Benchmark decontamination by SimHash of item-sized windows. DataFrame operations only.

A window that can be similar enough holds many shingles of its item, in whatever order, so windows that hold too few are not
fingerprinted: first by the positions that a scan samples, then by all positions of the documents that are left. A
multi-index over five blocks of the fingerprints finds all pairs within the radius; the exact similarity of the weighted
shingles then decides."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import free_names, materialise

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of single words (with multiplicity) of windows at the similarity above differ by some eight bits, with a
#: standard deviation of three: the radius is beyond three deviations of that (a test measures what it loses).
RADIUS = 19
BLOCKS = 5
_EDGES = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
#: Benchmark shingles are broadcast up to so many rows (some 50 MB); beyond it the scan joins them by a shuffle.
MAX_BROADCAST_SHINGLES = 1_000_000
_MAX_STRIDE = 8
#: Documents are scanned in pieces of so many words at least, a multiple of every stride, so rows stay small in long documents.
_PIECE, _GRID = 1024, math.lcm(*range(1, _MAX_STRIDE + 1))


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; an empty array for a null text or one without any."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(F.length(plain), F.lit(0)) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """All runs of `size` words; the whole sequence if it is shorter."""
    last = F.greatest(F.size(words) - F.lit(size), F.lit(0)) + F.lit(1)
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, size), " ")))


def least_matches(n: int, similarity: float) -> int:
    """Of n shingles of a window, at least so many are an item's if their weighted similarity reaches `similarity`."""
    return math.ceil(2 * n * similarity / (1 + similarity) - 1e-9)


def safe_stride(lengths: range, similarity: float) -> int:
    """The largest step at which sampled positions meet a matching shingle in every similar window of those lengths."""
    for step in range(_MAX_STRIDE, 1, -1):
        if all(n // step > n - least_matches(n, similarity) for n in lengths):
            return step
    return 1


def simhash_of(words: Column, wide: bool = False) -> Column:
    """The 64-bit SimHash of an array of words: a bit is 1 if set in over half the words' hashes. Four counters of sixteen bits
    share each sum; `wide`, for arrays of more than 65,535 words, two of 32."""
    width = 32 if wide else 16
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    lanes, mask = sum(1 << i for i in range(0, 64, width)), (1 << width) - 1
    sums = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(
        hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(lanes))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.struct(F.lit(0).cast("long").alias("fp"), sums.alias("sums"), F.size(words).alias("n")), lambda a, b: F.struct(
        F.when(F.call_function("shiftrightunsigned", F.element_at(a["sums"], (b % width) + 1), width * F.floor(b / width).cast("int")).bitwiseAND(F.lit(mask)) * 2 > a["n"],
               a["fp"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a["fp"]).alias("fp"), a["sums"].alias("sums"), a["n"].alias("n")), lambda a: a["fp"])


def _block(fp: Column, i: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, F.lit(_EDGES[i])).bitwiseAND(F.lit((1 << _EDGES[i + 1] - _EDGES[i]) - 1))


def _blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(fp, i).alias("bits")) for i in range(BLOCKS)])


def _flips(radius: int) -> list[int]:
    """All block masks of at most radius // BLOCKS set bits: two fingerprints within the radius differ by no more in some block."""
    return [sum(1 << i for i in c) for k in range(radius // BLOCKS + 1) for c in itertools.combinations(range(math.ceil(64 / BLOCKS)), k)]


def _hash_at(p: Column, size: int) -> Column:
    """The hash of the shingle of `size` words at position `p` of a piece that starts at `base`."""
    return F.xxhash64(F.lit(size), *[F.get(F.col("words"), p - F.col("base") + i) for i in range(size)])


def _pieces(docs: DataFrame, key: str, text: str, longest: int) -> tuple[DataFrame, int]:
    """(key, n, base, words, mark) for each piece of a document, and the piece's length: windows that start at the positions
    from `base` on are its own, and its words reach far enough for any of them. Equal marks are equal words."""
    reach = _GRID * math.ceil(max(_PIECE, 4 * longest) / _GRID)
    rows = docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words")).withColumn("n", F.size("words"))
    bases = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(reach))
    cut = rows.select("key", "n", F.explode(F.transform(bases, lambda base: F.struct(base.alias("base"), F.slice("words", base + 1, reach + longest).alias("words")))).alias("piece"))
    return cut.select("key", "n", "piece.base", "piece.words").withColumn("mark", F.xxhash64("words")), reach


def _stretch(lo: Column, hi: Column, step: int = 1) -> Column:
    """lo, lo + step, ... up to hi; empty if hi is less."""
    return F.when(hi >= lo, F.sequence(lo, F.greatest(lo, hi), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _sampled(last: Column, step: int, size: int) -> Column:
    """Each step-th position of a piece up to `last`, with the hash of the shingle there."""
    return F.transform(_stretch(F.col("base"), last, step), lambda p: F.struct(p.alias("p"), _hash_at(p, size).alias("h")))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater multiplicities of the shingles in two arrays."""
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))))
    return shared / (F.size(a) + F.size(b) - shared)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, item, start_word, n_words, similarity, distance): for each document and benchmark item the most similar
    item-sized window (ties: the first) whose five-word shingles, with multiplicity, reach `similarity`, in whatever order
    they stand. Words are runs of letters and digits in lower case; an item or document of fewer than five words has one
    shingle, a document shorter than an item one window. Null or empty texts and items match nothing; rows that repeat count
    once; an empty table gives an empty result. Other columns are not read.

    One scan hashes every s-th position's shingle, where s is the largest step at which no similar window can pass unseen,
    and meets the benchmark's shingles in a broadcast join, beyond MAX_BROADCAST_SHINGLES in a shuffle of the hashes alone.
    Where a window's length holds as many of an item's shingles as it must at least, the texts of those documents are read
    again and all positions are looked at. Long texts are scanned in overlapping pieces, so a row never carries more. What is left
    is held against whole items, so the work for an item grows with the square of its length. The similarity of shingles alone
    decides; the search by fingerprints can only lose pairs beyond its radius, of windows edited up to the threshold at most one
    in three hundred (a test)."""
    items = benchmark.select(F.col(item).alias("item"), words_of(F.col(item_text)).alias("item_words")).filter(F.size("item_words") > 0).distinct()
    items = items.withColumns({"item_n": F.size("item_words"), "item_shingles": shingles_of(F.col("item_words")), "iid": F.monotonically_increasing_id(), "size": F.least(F.size("item_words"), F.lit(SHINGLE))})
    items = materialise(items, "benchmark")
    bounds = items.agg(F.max("item_n").alias("hi"), F.collect_set("size").alias("sizes"), F.min(F.when(F.col("item_n") >= SHINGLE, F.col("item_n"))).alias("lo_full"), F.sum("item_n").alias("total")).first()
    sizes, longest = sorted(bounds["sizes"] or []) or [SHINGLE], bounds["hi"] or SHINGLE
    wide, steps = longest >= 1 << 16, dict.fromkeys(sizes, 1)
    if bounds["lo_full"]:
        least, most = bounds["lo_full"] - SHINGLE + 1, longest - SHINGLE + 1
        steps[SHINGLE] = safe_stride(range(max(1, math.ceil(similarity * least)), most + 1), similarity)
    items = items.withColumn("item_fp", simhash_of(F.col("item_words"), wide))
    pieces, reach = _pieces(docs, key, text, longest)
    scans = [_sampled(F.least(F.col("base") + F.lit(reach + longest - size), F.col("n") - size), steps[size], size) for size in sizes]
    anchors = pieces.withColumn("anchors", F.concat(*scans)).select("key", "n", "base", "mark", F.explode("anchors").alias("anchor")).select("key", "n", "base", "mark", "anchor.p", "anchor.h")
    hashes = F.transform(_stretch(F.lit(0), F.col("item_n") - F.col("size")), lambda p: F.coalesce(*[
        F.when(F.col("size") == size, F.xxhash64(F.lit(size), *[F.get(F.col("item_words"), p + i) for i in range(size)])) for size in sizes]))
    items = materialise(items.withColumn("item_hashes", hashes), "benchmark")
    index = items.select("iid", "item_n", "size", F.explode("item_hashes").alias("h")).distinct()
    hits = anchors.join(F.broadcast(index) if (bounds["total"] or 0) <= MAX_BROADCAST_SHINGLES else index, "h")

    # shingles in a window and in its item, and how many of the window's are the item's at least
    own, its = F.least("n", "item_n") - F.col("size") + 1, F.col("item_n") - F.col("size") + 1
    must = F.ceil(F.lit(similarity / (1 + similarity)) * (own + its) - 1e-9).cast("int")
    step = F.when(F.col("size") == SHINGLE, steps.get(SHINGLE, 1)).otherwise(1)
    groups = hits.groupBy("key", "base", "mark", "iid", "item_n", "size", "n").agg(F.sort_array(F.collect_set("p")).alias("ps"))  # a piece's positions at most
    groups = groups.withColumns({"own": own, "must": F.greatest(F.lit(1), F.floor(own / step).cast("int") - (own - must))})

    def gathered(i: Column) -> Column:
        return F.get(F.col("ps"), i + F.col("must") - 1) - F.get(F.col("ps"), i) < F.col("own")

    near = groups.filter((F.col("own") > 0) & F.exists(_stretch(F.lit(0), F.size("ps") - F.col("must")), gathered))
    near = materialise(near.select("key", "base", "mark", "iid", (F.array_min("ps") - F.col("own")).alias("from"), (F.array_max("ps") + F.col("own")).alias("to")), "leak-candidates")

    again = docs.join(near.select(F.col("key").alias("near_key")).distinct(), F.col(key).eqNullSafe(F.col("near_key")), "left_semi")
    pieces, _ = _pieces(again, key, text, longest)
    met = near.select(F.col("key").alias("met_key"), F.col("base").alias("met_base"), F.col("mark").alias("met_mark"), "iid", "from", "to")
    looked = pieces.join(met, pieces["key"].eqNullSafe(met["met_key"]) & (pieces["base"] == met["met_base"]) & (pieces["mark"] == met["met_mark"])).join(items.select("iid", "item_n", "size", "item_hashes"), "iid")
    held = F.filter(_stretch(F.greatest("base", "from"), F.least(F.col("to"), F.col("n") - F.col("size"))), lambda p: F.array_contains("item_hashes", F.coalesce(*[F.when(F.col("size") == size, _hash_at(p, size)) for size in sizes])))
    looked = looked.select("key", "n", "base", "words", "item_n", held.alias("ps"), own.alias("own"), must.alias("must"), F.least(F.col("base") + reach - 1, F.greatest(F.col("n") - F.col("item_n"), F.lit(0))).alias("last"))
    starts = F.transform(F.filter(_stretch(F.lit(0), F.size("ps") - F.col("must")), gathered), lambda i: _stretch(
        F.greatest("base", F.get(F.col("ps"), i + F.col("must") - 1) - F.col("own") + 1), F.least("last", F.get(F.col("ps"), i))))
    windows = looked.select("key", "words", "base", "item_n", F.explode(F.array_distinct(F.flatten(starts))).alias("start"))
    windows = windows.select("key", "item_n", "start", F.expr("slice(words, start - base + 1, item_n)").alias("window")).distinct()
    windows = materialise(windows.withColumn("fp", simhash_of(F.col("window"), wide)), "windows")

    cells = items.withColumn("cell", F.explode(_blocks(F.col("item_fp"))))
    cells = cells.select("iid", "item_n", "item_fp", "cell.block", F.explode(F.transform(F.lit(_flips(radius)), lambda m: F.col("cell.bits").bitwiseXOR(m.cast("long")))).alias("bits"))
    probes = windows.withColumn("cell", F.explode(_blocks(F.col("fp")))).select("key", "item_n", "start", "window", "fp", "cell.block", "cell.bits")
    # the index has thousands of rows for each item, so it is never broadcast
    near = probes.join(cells.hint("shuffle_hash"), ["item_n", "block", "bits"])
    gap = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair that meets in several blocks is taken at the first of them
    first = F.lit(BLOCKS)
    for i in reversed(range(BLOCKS)):
        first = F.when(F.bit_count(_block(gap, i)) <= radius // BLOCKS, i).otherwise(first)
    near = near.filter((F.bit_count(gap) <= radius) & (F.col("block") == first)).select("key", "start", "window", "iid", F.bit_count(gap).cast("int").alias("distance"))
    # both shingle arrays are written out: each is made once, however often the similarity looks at it
    pairs = near.join(items.select("iid", "item", "item_shingles"), "iid").withColumn("shingles", shingles_of(F.col("window"))).withColumn("n_words", F.size("window"))
    pairs = materialise(pairs.select("key", "item", "start", "n_words", "distance", "shingles", "item_shingles"), "leak-pairs")
    scored = pairs.withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles"))).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("key", "item").agg(F.min(F.struct(
        (-F.col("similarity")).alias("order"), "start", "n_words", "similarity", "distance")).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), F.col("best.start").alias("start_word"), "best.n_words", "best.similarity", "best.distance")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` in whose text find_leaks() finds nothing, with all columns as they are. Rows are judged by key and
    text together, so one that shares its key (or a null key) with a row that goes stays; rows that repeat stay or go alike."""
    row, _ = free_names(docs.columns, "row", "leak_row")
    marked = docs.withColumn(row, F.md5(F.concat_ws("|", F.col(key).isNull().cast("string"), F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))))
    leaks = find_leaks(marked, benchmark, key=row, text=text, **options).select(F.col(row).alias("leak_row")).distinct()
    return marked.join(leaks, marked[row] == leaks["leak_row"], "left_anti").drop(row)
