"""Near-duplicate removal: documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash by pivot distance tables (simhash.py), which finds copies with scattered edits, and then
from min-wise keys, whose recall depends on the similarity alone: the chance that two sets have the same least element
under a random order is their similarity, wherever in the texts they differ. Each of TABLES keys of a document is a hash of
its least shingles under KEY orders of its own; documents that share a key are candidates. The sets of shingles themselves
decide on every link. Each document is compared with the most central one of its most crowded key, and then, where documents
are not connected, with all that share a key: as rows where few do, within tasks where many do, so pairs of a crowd never
become rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.graph import components
from quern.llm.simhash import MajorityBits, links_within, shingle_hashes
from quern.llm.storage import bound_batches, discard, free_names, materialise

SHINGLE = 5
SIMILARITY = 0.8
#: Search keys, and orders to a key: a pair at the threshold shares a key with a chance of 1 - (1 - 0.8**5)**24 = 99.993 %.
TABLES, KEY = 24, 5
#: Differing bits of SimHash fingerprints up to which texts are candidates.
RADIUS = 2
#: Texts under a key up to which all pairs that are not connected are compared as rows.
BUCKET = 32
#: In a larger crowd, texts outside its largest connected part, and all of its texts, that meet in one task.
LEFT, RIGHT = 1024, 1024
#: Bits that tell the texts whose sets of shingles are wanted: 4 MB at any size.
WANTED = 1 << 25
#: The share of the TABLES * KEY orders under which two texts have the same least shingle estimates their similarity, with a
#: standard deviation of 0.037 at the threshold. Pairs more than this below it, five deviations, are discarded unseen.
DOUBT = 0.18
#: Shingles whose least are taken at once.
_RUN = 1 << 12
#: Sketches kept by a task for texts that repeat.
_KEPT = 2048


def _plain() -> bytes:
    """ASCII letters in lower case, digits and all bytes of longer characters; the rest becomes a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


_PLAIN = _plain()


def plain_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


@functools.cache
def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), seed) for i in range(n)], np.uint64)


def shingle_set(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of a text's shingles, and their upper halves: 32 bits tell the shingles of two texts apart
    but for one in four thousand million divided by their number."""
    whole = np.unique(shingle_hashes(words, SHINGLE))
    return whole, (whole >> np.uint64(32)).astype(np.uint32)


def least_shingles(short: np.ndarray) -> np.ndarray:
    """The least element of a set of 32-bit hashes under each of TABLES * KEY orders."""
    orders = (_constants(TABLES * KEY, 5) | np.uint64(1)).astype(np.uint32)[:, None]
    least = np.full(TABLES * KEY, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), _RUN):
        least = np.minimum(least, (short[None, i : i + _RUN] * orders).min(axis=1))
    return least


def search_keys(least: np.ndarray) -> list[int]:
    """TABLES keys as signed integers: hashes of KEY least elements each."""
    return [xxhash.xxh64_intdigest(k.tobytes(), t) - (1 << 63) for t, k in enumerate(least.reshape(TABLES, KEY))]


def sketches(texts: list[str]) -> list[tuple[int, list[int], list[int], int, np.ndarray]]:
    """(words, search keys, a byte of each least element in whole machine words, SimHash, shingle set) of each text."""
    words, majority, found = [plain_words(t) for t in texts], MajorityBits(), []
    for ws in words:
        whole, short = shingle_set(ws)
        majority.add(whole)
        least = least_shingles(short)
        found.append((len(ws), search_keys(least), least.astype(np.uint8).view("<i8").tolist(), np.unique(short).view(np.int32)))
    return [(n, keys, sample, fp, own) for (n, keys, sample, own), fp in zip(found, majority.take(), strict=True)]


_SKETCH = "digest string, n_words int, search array<long>, sample array<long>, fp long, shingles array<int>"


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's set of shingles is given once in a task while the task remembers the text, so copies carry none."""
    kept: dict[str, tuple] = {}
    for batch in batches:
        digests = batch.column(1).to_pylist()
        fresh = {d: t for d, t in zip(digests, batch.column(2).to_pylist(), strict=True) if d not in kept}
        if len(kept) + len(fresh) > _KEPT:
            kept = {d: kept[d] for d in digests if d in kept}
        made = dict(zip(fresh, sketches(list(fresh.values())), strict=True))
        kept |= {d: s[:4] for d, s in made.items()}
        sets = [made.pop(d)[4] if d in made else None for d in digests]
        n, search, sample, fp = zip(*(kept[d] for d in digests), strict=True) if digests else ((), (), (), ())
        arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(search, pa.list_(pa.int64())), pa.array(sample, pa.list_(pa.int64())),
                  pa.array(fp, pa.int64()), pa.array(sets, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "digest", "n_words", "search", "sample", "fp", "shingles"])


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def estimated_similarity(a: Column, b: Column) -> Column:
    """The share of equal bytes in two samples."""

    def differing(x: Column) -> Column:
        for n in (4, 2, 1):  # the lowest bit of each byte becomes the OR of its eight
            x = x.bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(n)))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x.cast("int"))
    return 1 - unlike / F.lit(float(TABLES * KEY))


def sets_of(wanted: DataFrame, sketched: DataFrame) -> DataFrame:
    """(digest, search, sample, shingles) of the texts in `wanted` (digest, repeats allowed). Sets are most of what is sketched, and few are
    wanted: a bitmap of the wanted digests' hashes, of a fixed size, is broadcast and keeps nearly all others out of the
    shuffle (it lets some pass where many are wanted). The join decides; a semi join would be moved below the bitmap."""
    wanted = materialise(wanted.select("digest").distinct(), "wanted")
    place = F.pmod(F.xxhash64("digest"), F.lit(WANTED)) + 1
    numbered = lambda df: df.withColumns({"part": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})
    bits = numbered(wanted).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))  # WANTED bits in rows of 4096 bytes
    columns = ["search", "sample", "shingles"]
    met = numbered(sketched.filter(F.col("shingles").isNotNull()).select("digest", *columns)).join(F.broadcast(bits), "part")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = met.filter(F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(1) == 1).select("digest", *columns)
    found = materialise(met.join(wanted, "digest").groupBy("digest").agg(*[F.any_value(c).alias(c) for c in columns]), "shingles")
    discard(wanted)
    return found


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b: digests, repeats allowed) that are alike, as links (u, v): sets of shingles with at least that
    Jaccard similarity."""
    judged = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in "ab":
        judged = judged.join(sets.select(F.col("digest").alias(x), F.col("sample").alias(f"p{x}")), x)
    met = judged.filter(estimated_similarity(F.col("pa"), F.col("pb")) >= similarity - DOUBT).select("a", "b")
    for x in "ab":
        met = met.join(sets.select(F.col("digest").alias(x), F.col("shingles").alias(f"s{x}")), x)
    met = met.withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    near = met.filter(F.col("shared") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("shared")) - F.lit(1e-9))
    return materialise(near.select(F.col("a").alias("u"), F.col("b").alias("v")), "alike")


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """Candidates (a, b): texts of equal fingerprints, and one text of each of two fingerprints that the pivot tables link."""
    worded = texts.filter("n_words > 0")
    least = materialise(worded.groupBy("fp").agg(F.min("digest").alias("b")), "fingerprints")
    links = links_within(least.select(F.lit(0).alias("t"), "fp"), RADIUS)
    linked = links.join(least.select(F.col("fp").alias("u"), F.col("b").alias("a")), "u").join(least.select(F.col("fp").alias("v"), "b"), "v")
    equal = worded.select("fp", F.col("digest").alias("a")).join(least, "fp").filter("a != b")
    return linked.select("a", "b").union(equal.select("a", "b"))


def _unconnected(members: DataFrame) -> DataFrame:
    """The rows (k, digest, root, place) of keys whose texts are not all connected, with the number of texts under the key."""
    some = members.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    return members.select("k", "digest", "root", "place").join(some.select("k", "n"), "k")


def _pairs_under_keys(few: DataFrame) -> DataFrame:
    one, other = (few.select("k", F.col("digest").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    return one.join(other, "k").filter("a < b and ra != rb").select("a", "b")


def _met(similarity: float):
    def links(table: pa.Table) -> pa.Table:
        """Of a block's rows of two sides, alike pairs across, one for each two parts that are not connected yet. Pairs that
        share an earlier key are left to that, and samples that tell two texts apart spare their sets."""
        minor, left, right = (table[c].to_numpy(zero_copy_only=False) for c in ("minor", "left", "right"))
        digests = table["digest"].to_numpy(zero_copy_only=False)
        order, part = (np.unique(x, return_inverse=True)[1] for x in (digests, table["root"].to_numpy(zero_copy_only=False)))
        place = table["place"][0].as_py()
        search, sample = (np.array(table[c].combine_chunks().flatten()).reshape(len(digests), -1) for c in ("search", "sample"))
        own, sets, out = sample.view(np.uint8).reshape(len(digests), -1), table["shingles"].combine_chunks(), []
        sizes = np.array(sets.value_lengths(), np.int64)
        kinds, shingles = np.unique(np.array(sets.flatten()), return_inverse=True)
        begin, mark = np.cumsum(sizes) - sizes, np.zeros(len(kinds), np.int8)
        others = np.flatnonzero(right)
        for a in np.flatnonzero(left):
            b = others[(part[others] != part[a]) & (~minor[others] | (order[others] > order[a]))]  # two minor ones meet twice
            b = b[np.minimum(sizes[b], sizes[a]) >= similarity * np.maximum(sizes[b], sizes[a]) - 1e-9]
            b = b[~(search[b, :place] == search[a, :place]).any(axis=1)]
            b = b[(own[b] == own[a]).mean(axis=1) >= similarity - DOUBT]
            if not len(b):
                continue
            mine = shingles[begin[a] : begin[a] + sizes[a]]
            mark[mine] = 1
            ends = np.cumsum(sizes[b])
            at = np.arange(ends[-1]) + np.repeat(begin[b] - (ends - sizes[b]), sizes[b])
            shared = np.add.reduceat(mark[shingles[at]], ends - sizes[b], dtype=np.int64)
            mark[mine] = 0
            b = b[shared >= similarity * (sizes[a] + sizes[b] - shared) - 1e-9]
            for x in b:
                if part[x] != part[a]:
                    out.append((digests[a], digests[x]))
                    part[part == part[x]] = part[a]
        return pa.table({"u": [x for x, _ in out], "v": [x for _, x in out]}, schema=pa.schema([("u", pa.string()), ("v", pa.string())]))

    return links


def _in_blocks(crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that connect, under keys (k, digest, root, n, place: the key's table) of many texts that are not all
    connected, what all alike pairs would. Texts outside the key's largest connected part are held against all of its texts, in
    blocks of both that meet in tasks, by their sets of shingles; of the keys that a pair shares it is judged under the first.
    Rows are the key's texts once for every LEFT of those outside, and those outside for every RIGHT of the key's; what leaves a
    block is fewer links than it has texts."""
    most = F.max(F.struct("c", "root")).alias("most")
    crowds = crowded.groupBy("k", "n", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("k", "n").agg(most)
    crowds = crowds.select("k", F.col("most.root").alias("major"), F.ceil((F.col("n") - F.col("most.c")) / LEFT).cast("int").alias("lefts"), F.ceil(F.col("n") / RIGHT).cast("int").alias("rights"))
    rows = crowded.join(crowds, "k").withColumn("minor", F.col("root") != F.col("major"))
    draw = F.xxhash64("digest")
    i, j = F.pmod(draw, F.col("lefts")).cast("int"), F.pmod(draw, F.col("rights")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    right = F.transform(every("lefts"), lambda x: cell(x, j, F.col("minor") & (x == i), F.lit(True)))
    left = F.transform(F.filter(every("rights"), lambda x: F.col("minor") & (x != j)), lambda x: cell(i, x, F.lit(True), F.lit(False)))
    met = rows.withColumn("met", F.explode(F.concat(right, left))).join(sets, "digest")
    met = met.select("k", "met.i", "met.j", "met.left", "met.right", "minor", "place", "digest", "root", "search", "sample", "shingles")
    return materialise(met.groupBy("k", "i", "j").applyInArrow(_met(similarity), "u string, v string"), "crowds")


def _by_keys(left: DataFrame) -> DataFrame:
    """Candidates (a, b): all pairs of texts that are not connected under a key (k, digest, root, n) of up to BUCKET texts."""
    return materialise(_pairs_under_keys(left.filter(F.col("n") <= BUCKET)).distinct(), "pairs")


def _by_centres(members: DataFrame) -> DataFrame:
    """Candidates (a, b): each text and, under its most crowded key (k, digest, n), the most central text, that with the most
    companions under all its keys. Copies that were edited each by itself are closest to the text that was not."""
    crowd = members.groupBy("digest").agg(F.sum("n").alias("crowd"))
    central = F.max(F.struct("crowd", F.xxhash64("digest"), F.col("digest").alias("b"))).alias("central")
    centres = members.join(crowd, "digest").groupBy("k").agg(central).select("k", "central.b")
    most = members.join(centres, "k").groupBy("digest").agg(F.max(F.struct("n", "k", "b")).alias("most"))
    return most.select(F.col("digest").alias("a"), "most.b").filter("a != b")


def _connected(texts: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the texts that links of alike pairs connect."""
    keyed = texts.filter("n_words > 0").select("digest", F.posexplode("search").alias("place", "k"))
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(keyed.join(shared, "k").select("k", "digest", "n", "place"), "members")
    printed = materialise(_by_fingerprint(texts), "printed")
    sets = sets_of(members.select("digest").union(printed.select(F.explode(F.array("a", "b")))), sketched)
    first = _alike(printed.union(_by_centres(members)), sets, similarity)
    roots = components(first)
    rooted = members.join(roots, members["digest"] == roots["node"], "left").select("k", "digest", F.coalesce("root", "digest").alias("root"), "place")
    left = materialise(_unconnected(rooted), "left")
    tried = _by_keys(left)
    links = first.union(_alike(tried, sets, similarity)).union(_in_blocks(left.filter(F.col("n") > BUCKET), sets, similarity))
    discard(members, printed, sets, left, tried)
    return components(links)


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, digest, class_key, class_digest) for each row: the digest of its text, and the row that stands for its class:
    that with the smallest key (nulls last), then digest. Texts that are equal are one class (null: empty); so are texts
    that links connect. Texts without words link to equal ones only; shorter texts than five words have one shingle.

    Equal texts are combined first. Texts with close SimHash fingerprints are compared, and each text with the most central one
    of its most crowded search key; those alike are linked. All pairs that share a key and are then not connected are compared:
    as rows under keys of few texts, within tasks in the crowds of others. Pairs of a crowd cost time there and no rows: those
    are the crowd's texts once for every LEFT or RIGHT of them. Tables of steps that have ended are deleted."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    sketched = materialise(rows.mapInArrow(_sketch_rows, f"key {kind}, {_SKETCH}"), "sketches")
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key")).alias("first")
    texts = materialise(sketched.groupBy("digest").agg(first, *[F.any_value(c).alias(c) for c in ("n_words", "search", "sample", "fp")]), "texts")
    roots = _connected(texts, sketched, similarity)
    grouped = texts.select("digest", "first").join(roots, texts["digest"] == roots["node"], "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))
    keeper = F.min(F.struct("first.last", "first.key", "digest")).alias("keeper")
    stands = grouped.groupBy("root").agg(keeper)
    classes = materialise(grouped.join(stands, "root").select("digest", F.col("keeper.key").alias("class_key"), F.col("keeper.digest").alias("class_digest")), "classes")
    found = materialise(sketched.select("key", "digest").join(classes, "digest").select(F.col("key").alias(key), "digest", "class_key", "class_digest"), "near-duplicates")
    discard(sketched, texts, classes)
    return found


def _named(key: Column) -> Column:
    """A key as a string that is never null: null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stand for their classes of near-duplicates, one of each; all columns as they are. Rows that
    repeat leave one; an empty table gives an empty result."""
    classes = near_duplicate_classes(docs, key, text, similarity)
    kept = classes.filter(F.col(key).eqNullSafe(F.col("class_key")) & (F.col("digest") == F.col("class_digest"))).select(F.col(key).alias("kept_key"), F.col("digest").alias("kept_digest")).distinct()
    digest, place, own = free_names(docs.columns, "digest", "place", "own")
    marked = docs.withColumns({digest: text_digest(F.col(text)), own: _named(F.col(key))})
    kept = kept.select(_named(F.col("kept_key")).alias(own), F.col("kept_digest").alias(digest))
    left = marked.join(kept, [own, digest], "left_semi")  # the window takes the rows as the join has dealt them, so texts are shuffled once
    first = F.row_number().over(Window.partitionBy(own, digest).orderBy(F.lit(1)))
    return left.withColumn(place, first).filter(F.col(place) == 1).drop(place, digest, own)
