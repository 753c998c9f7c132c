"""The prefix trie against a plain trie of the same conversations."""

import hashlib
import random
import zlib

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from quern.llm import oracles, prefixtrie, queries
from quern.llm.prefixtrie import conversation_trie, steps_of, trie, turns_of

COLUMNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Turns of each conversation, begun anew as the query does."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        kids = sum(len(n) == len(node) + 1 for n in below)
        leaves = sum(not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below) for n in below)
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(node))))
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def query(df):
    conv = F.col("conv")
    return trie(steps_of(turns_of(df), base=conv - conv % 100, heads=F.crc32(conv.cast("string").cast("binary")) % 6, most=5))


@pytest.fixture
def some():
    """Conversations of few words, so that many share their first turns: some absent bases, turnless ones and a long one."""
    draw = random.Random(3)
    rows = []
    for c in [*range(40), *range(105, 130), *range(200, 215), 7_000_000_301, 7_000_000_300]:
        for t in range(draw.choice([1, 1, 2, 3, 6, 9]) if c != 9 else 70):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["hi", "ok ü", "go on"])))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_rebuilt_conversations(spark, some, monkeypatch, small):
    if small:  # blocks of few turns and ids, as of conversations and copies of very many
        monkeypatch.setattr(prefixtrie, "BLOCK", 2)
        monkeypatch.setattr(prefixtrie, "ID_BITS", 1)
        monkeypatch.setattr(prefixtrie, "SALTS", 2)
    want = rebuilt(some)
    assert any(not x for x in want.values()) and max(map(len, want.values())) > 60
    assert found(query(spark.createDataFrame(some, COLUMNS))) == brute(want)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (2, 0, "", ""), (None, 0, "user", "lost"), (3, 5, "user", "é" * 30_000), (4, 5, "user", "é" * 30_000), (100, None, "a", "b"), (-5, 0, "x", "y")]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"conv": F.lit("clash"), "depth": F.lit(1), "xa": F.lit(2), "pos": F.lit(3), "n": F.lit(4), "row": F.lit(5)})
    plain = {}
    for c, _, role, text in rows:
        if c is not None:
            plain.setdefault(c, []).append((role or "", text or ""))
    assert found(conversation_trie(df)) == brute(plain)
    tied = [(1, 0, "user", x) for x in "abc"]
    assert found(conversation_trie(spark.createDataFrame(tied, COLUMNS))) == found(conversation_trie(spark.createDataFrame(tied[::-1], COLUMNS)))
    assert conversation_trie(df.limit(0)).count() == 0


def test_the_query(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(queries.op12_prefix_trie(spark, sf), duck(sf), oracles.ORACLES["op12_prefix_trie"]) == ""
