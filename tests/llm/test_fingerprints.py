import base64
import functools
import hashlib
import operator
import random
import struct

import pytest
import xxhash
from compare import TINY, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import fingerprints as fp

DIGESTS = st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=300)


@settings(max_examples=60, deadline=None)
@given(DIGESTS, DIGESTS, DIGESTS)
def test_difference_is_exact(shared, only_a, only_b):
    a, b = list(dict.fromkeys(shared + only_a)), list(dict.fromkeys(shared + only_b))
    first, second = fp.difference(a, b)
    assert {*first} == {*a} - {*b} and {*second} == {*b} - {*a}


def test_the_published_sketch_alone_recovers_small_differences():
    """The rates that CELLS states, over many draws; none is recovered wrongly."""
    draw = random.Random(7)
    for size, most in ((5, 0.004), (10, 0.012), (15, 0.03)):
        lost = 0
        for _ in range(1500):
            ours, theirs = [draw.getrandbits(64) for _ in range(size // 2)], [draw.getrandbits(64) for _ in range(size - size // 2)]
            shared = [draw.getrandbits(64) for _ in range(3)]
            found = fp.Sketch(fp.CELLS, shared + ours).minus(fp.Sketch(fp.CELLS, theirs + shared)).peel()
            lost += found is None
            assert found is None or (sorted(found[0]), sorted(found[1])) == (sorted(ours), sorted(theirs))
        assert lost <= most * 1500


def test_a_fingerprint_is_sums_over_its_paragraphs():
    text = "One. Two! Two!\nThree? Four\nOne."
    seen, digests = {}, []
    for part in ("One.", "Two!", "Two!", "Three?", "Four", "One."):
        seen[part] = seen.get(part, -1) + 1
        digests.append(xxhash.xxh64(part.encode(), seed=seen[part]).intdigest())
    raw = base64.b64decode(fp.fingerprint(text))
    assert struct.unpack_from("<I", raw) == (6,) and len(raw) == 4 + 16 * fp.CELLS
    cells = [struct.unpack_from("<iQI", raw, 4 + 16 * i) for i in range(fp.CELLS)]
    for row in range(4):  # each row holds every digest once
        own = cells[row * 10 : row * 10 + 10]
        assert sum(c[0] for c in own) == 6 and functools.reduce(operator.xor, (c[1] for c in own)) == functools.reduce(operator.xor, digests)
    assert {d for c, d, _ in cells if c == 1} <= {*digests}


def test_repeated_paragraphs_count():
    assert len(set(fp.paragraph_digests("a\nb\na\na"))) == 4
    assert fp.likeness(fp.paragraph_digests("a\na\nb"), fp.paragraph_digests("a\nb")) == 2 / 3
    assert fp.likeness([], []) == 1.0 and fp.likeness([1], []) == 0.0


def test_colliding_digests_end():
    assert fp.difference([5, 5], [5]) is not None


def brute(rows):
    """The contract, row by row, with sets of paragraph digests."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]

        def like(x, y):
            a, b = set(fp.paragraph_digests(x)), set(fp.paragraph_digests(y))
            return len(a & b) / len(a | b) if a | b else 1.0

        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(text), fp.fingerprint(edited), like(text, edited), like(text, following)))
    return out


def test_query_against_brute_force(spark):
    from quern.llm.queries import op7_fingerprints

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    found = sorted(map(tuple, op7_fingerprints(spark, TINY).collect()))
    assert [r[:5] for r in found] == [r[:5] for r in brute(rows)]
    assert all(a == pytest.approx(b) for x, y in zip(found, brute(rows), strict=True) for a, b in zip(x[5:], y[5:], strict=True))


def test_query_against_sql(spark):
    """What SQL can express of the contract."""
    from quern.llm.queries import op7_fingerprints

    sql = """SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(left(coalesce(text, ''), length(coalesce(text, '')) - length(coalesce(text, '')) // 2)
      || left(coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id), ''), (length(coalesce(text, '')) // 2)::INT)) AS edited_sha256 FROM documents"""
    assert sorted(map(tuple, op7_fingerprints(spark, TINY).select("doc_id", "n_chars", "edited_sha256").collect())) == sorted(duck(TINY).execute(sql).fetchall())


def test_rows_that_share_a_key_are_spread(spark, docs):
    table = docs(*[(i, f"text {i}. More.") for i in range(40)], *[(17, f"hot {i}. Text.") for i in range(60)], *[(None, f"null {i}.") for i in range(40)], *[(5, "the same. row.")] * 60)
    found = fp.fingerprint_documents(table.repartition(4), key="doc_id")
    assert found.count() == 200
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 3 and max(sizes) < 120
    named = fp.fingerprint_documents(docs((1, "a"), (2, "b")).withColumnRenamed("doc_id", "id"), key="id")
    assert named.columns[0] == "id"


def test_odd_rows(spark, odd, docs):
    found = fp.fingerprint_documents(odd.withColumns({"key": F.lit(1), "extra": F.lit("clash")})).collect()
    assert len(found) == odd.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] and by_id[5]["near_next"] == 1.0 and by_id[1]["n_chars"] == 0
    alone = fp.fingerprint_documents(docs((1, "a. b. c. d."))).first()
    assert alone["near_next"] == 1.0 and fp.fingerprint_documents(odd.limit(0)).count() == 0
