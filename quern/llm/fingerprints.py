"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A sketch has cells (count, xor of digests, xor of checks). Subtracting the sketches of two versions leaves the digests of
the paragraphs in which they differ, which peeling recovers; where it fails, larger sketches of both are tried."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import bound_batches, pair_bounds, pair_index, shuffle_partitions

#: Cells of a published fingerprint, in four rows. Of random differences of 5, 10 and 15 paragraphs it alone recovers all but
#: 0.1, 0.5 and 1.2 % (measured over 20,000 draws each); for the others, and for larger ones, larger sketches are built.
CELLS = 40
_ROWS = 4
_MASK = (1 << 64) - 1
#: Odd multipliers: the upper half of a product gives a digest's cell in a row of a wide sketch, and its check.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_CHECK = 0xA0761D6478BD642F
#: A paragraph ends at a line end, or within a line after a sentence's end, so a text of one line has several, too.
_PARAGRAPH = re.compile(r"\n+|(?<=[.!?]) +")


def paragraph_digests(text: str) -> list[int]:
    """A 64-bit digest of each paragraph and its number among equal ones, so repeated paragraphs count as often."""
    seen: dict[str, int] = {}
    out = []
    for part in _PARAGRAPH.split(text):
        if part:
            n = seen[part] = seen.get(part, -1) + 1
            out.append(xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), n))
    return out


def _places(d: int, row: int) -> tuple[int, int, int, int]:
    """A digest's cell in each row of so many cells, by its four quarters."""
    return (d & 65535) % row, row + (d >> 16 & 65535) % row, 2 * row + (d >> 32 & 65535) % row, 3 * row + (d >> 48) % row


class Sketch:
    """An invertible Bloom lookup sketch of a set of 64-bit digests."""

    __slots__ = ("checks", "counts", "size", "sums")

    def __init__(self, size: int, digests: list[int] = ()):  # type: ignore[assignment]
        self.size = size
        self.counts, self.sums, self.checks = [0] * size, [0] * size, [0] * size
        row = size // _ROWS
        counts, sums, checks = self.counts, self.sums, self.checks
        for d in digests:
            c = (d * _CHECK & _MASK) >> 32
            for i in ((d & 65535) % row, row + (d >> 16 & 65535) % row, 2 * row + (d >> 32 & 65535) % row, 3 * row + (d >> 48) % row):
                counts[i] += 1
                sums[i] ^= d
                checks[i] ^= c

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(self.size)
        out.counts = [a - b for a, b in zip(self.counts, other.counts, strict=True)]
        out.sums = [a ^ b for a, b in zip(self.sums, other.sums, strict=True)]
        out.checks = [a ^ b for a, b in zip(self.checks, other.checks, strict=True)]
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """The digests only in the first and only in the second of two subtracted sketches; None where it fails."""
        counts, sums, checks, row = self.counts, self.sums, self.checks, self.size // _ROWS
        first: list[int] = []
        second: list[int] = []
        todo = [i for i, n in enumerate(counts) if n in (1, -1)]
        while todo:
            i = todo.pop()
            n, d = counts[i], sums[i]
            if n not in (1, -1) or checks[i] != (c := (d * _CHECK & _MASK) >> 32):
                continue
            places = _places(d, row)
            if i not in places:
                continue
            (first if n == 1 else second).append(d)
            for j in places:
                counts[j] -= n
                sums[j] ^= d
                checks[j] ^= c
                if counts[j] in (1, -1):
                    todo.append(j)
        return None if any(counts) or any(sums) else (first, second)

    def dump(self) -> bytes:
        return b"".join(struct.pack("<iQI", *x) for x in zip(self.counts, self.sums, self.checks, strict=True))


def publish(sketch: Sketch, n: int) -> str:
    """The published form: the number of paragraphs and the cells, in base64."""
    return base64.b64encode(struct.pack("<I", n) + sketch.dump()).decode()


def fingerprint(text: str, cells: int = CELLS) -> str:
    """The published fingerprint of a text."""
    digests = paragraph_digests(text)
    return publish(Sketch(cells, digests), len(digests))


def _peel_wide(size: int, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
    """Build, subtract and peel as Sketch does, with array operations: all pure cells of a round at once."""
    row = np.uint64(size // _ROWS)

    def parts(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.concatenate([np.uint64(j) * row + ((d * np.uint64(m)) >> np.uint64(32)) % row for j, m in enumerate(_MIX)])
        return places.astype(np.int64), (d * np.uint64(_CHECK)) >> np.uint64(32)

    counts, sums, checks = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)

    def put(d: np.ndarray, sign: np.ndarray) -> None:
        places, check = parts(d)
        np.add.at(counts, places, np.tile(sign, _ROWS))
        np.bitwise_xor.at(sums, places, np.tile(d, _ROWS))
        np.bitwise_xor.at(checks, places, np.tile(check, _ROWS))

    both = np.array(a + b, dtype=np.uint64)
    put(both, np.repeat([1, -1], [len(a), len(b)]))
    first, second = [], []
    while len(pure := np.flatnonzero(np.abs(counts) == 1)):
        d, n = sums[pure], counts[pure]
        places, check = parts(d)
        here = (places.reshape(_ROWS, -1) == pure).any(axis=0) & (check == checks[pure])
        d, at = np.unique(d[here], return_index=True)
        if not len(d):
            break
        n = n[here][at]
        first += d[n == 1].tolist()
        second += d[n == -1].tolist()
        put(d, -n)
    return None if counts.any() or sums.any() else (first, second)


#: From so many paragraphs on, a retry uses array operations.
_WIDE = 150


def difference(a: list[int], b: list[int], small: Sketch | None = None, other: Sketch | None = None) -> tuple[list[int], list[int]]:
    """The digests only in `a` and only in `b`: the published sketches (built where not given) are subtracted and peeled; on
    failure, sketches large enough for two unlike texts, then of twice the cells each time. Beyond 64 cells for each paragraph,
    which only digests that collide at every size can need, their plain sets decide."""
    found = (small or Sketch(CELLS, a)).minus(other or Sketch(CELLS, b)).peel()
    rows = len(a) + len(b)
    size = _ROWS * (rows // 2 + 8)
    while found is None:
        if size > 64 * (rows + CELLS):  # digests that collide in all rows at any size
            return sorted({*a} - {*b}), sorted({*b} - {*a})
        found = _peel_wide(size, a, b) if rows > _WIDE else Sketch(size, a).minus(Sketch(size, b)).peel()
        size *= 2
    return found


def likeness(a: list[int], b: list[int], small: Sketch | None = None, other: Sketch | None = None) -> float:
    """Shared paragraphs over all, from the recovered difference; 1.0 for two texts without paragraphs."""
    if not a and not b:
        return 1.0
    only_a, only_b = difference(a, b, small, other)
    return (len(a) - len(only_a)) / (len(a) + len(only_b))


def edit(text: str, following: str) -> str:
    """`text` with its last floor(n / 2) code points replaced by the first as many (or all) of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Bits of the order of rows that share a key which tell repeated rows apart; the others are of a hash of the text.
_TIE_BITS = 24
_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(cells: int, key_name: str):
    arrow = pa.schema([(key_name, pa.int64()), *_ARROW])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, text, extra) in order, extra ones last: those of the following partition, of which the first counts."""
        held: tuple | None = None
        done: list[tuple] = []
        over = False
        for batch in batches:
            for key, text, extra in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if over:
                    continue
                text = text or ""
                digests = paragraph_digests(text)
                sketch = Sketch(cells, digests)
                if held is not None:
                    old_key, old, old_digests, old_sketch = held
                    edited = edit(old, text)
                    edited_digests = paragraph_digests(edited)
                    edited_sketch = Sketch(cells, edited_digests)
                    done.append((
                        old_key, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), publish(old_sketch, len(old_digests)),
                        publish(edited_sketch, len(edited_digests)), likeness(old_digests, edited_digests, old_sketch, edited_sketch),
                        likeness(old_digests, digests, old_sketch, sketch),
                    ))
                held, over = (key, text, digests, sketch), extra
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
                done = []

    return rows


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """For each row: its fingerprint, that of its edited text (its last half replaced by the start of the next row's text),
    and the likeness of its fingerprint to the edited text's and to the next row's.

    The next row is that with the next `key` (nulls first; ties by a hash of the text); the first row follows the last, so
    a single row follows itself. A null text counts as empty. Equal texts have equal fingerprints; rows that repeat each
    give a row. An empty table gives an empty result. Other columns are not read.

    One shuffle of (key, text) by ranges of the key and, within a key, of a hash, so that rows that share a key, or repeat, are
    spread. The first row of a range, which a pass over keys and hashes finds, also goes to the range before it as an extra row;
    tasks stream their rows and hold two texts and one batch."""
    spark = docs.sparkSession
    bound_batches(spark)
    own = F.col(text).cast("string")
    low = F.lit((1 << _TIE_BITS) - 1)
    tie = F.xxhash64(own).bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(low))
    rows = docs.select(F.col(key).cast("long").alias("key"), own.alias("text"), tie.alias("tie"))
    bounds = pair_bounds(rows, "key", "tie", shuffle_partitions(spark))
    rows = rows.withColumn("at", pair_index(F.col("key"), F.col("tie"), bounds) if bounds else F.lit(0))
    first = F.min(F.struct(F.col("key").isNotNull().alias("known"), "key", "tie"))
    leads = {r["at"]: r["first"] for r in rows.groupBy("at").agg(first.alias("first")).collect()}  # as many as ranges
    if not leads:
        return spark.createDataFrame([], f"`{key}` long, {_OUT}")
    parts, filled = len(bounds) + 1, sorted(leads)
    before = {at: filled[i - 1] for i, at in enumerate(filled)}  # the range before the first is the last

    def of_range(values: list, kind: str) -> Column:
        return F.element_at(F.lit(values).cast(f"array<{kind}>") if any(v is not None for v in values) else F.lit([0] * parts), F.col("at") + 1)

    known = [(leads[at]["known"], leads[at]["key"], leads[at]["tie"]) if at in leads else (False, None, None) for at in range(parts)]
    is_lead = (F.col("key").isNotNull() == of_range([k[0] for k in known], "boolean")) & (F.coalesce("key", F.lit(0)) == of_range([k[1] or 0 for k in known], "long")) & (F.col("tie") == of_range([k[2] or 0 for k in known], "long"))
    itself = F.struct(F.col("at").alias("part"), F.lit(False).alias("extra"))
    over = F.struct(of_range([before.get(at, 0) for at in range(parts)], "int").alias("part"), F.lit(True).alias("extra"))
    dealt = rows.withColumn("place", F.explode(F.when(is_lead, F.array(itself, over)).otherwise(F.array(itself)))).select("key", "text", "tie", "place.part", "place.extra")
    laid = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("extra", F.col("key").asc_nulls_first(), "tie")
    return laid.select("key", "text", "extra").mapInArrow(_compare(cells, key), f"`{key}` long, {_OUT}")
