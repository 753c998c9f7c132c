"""Neighbours found through the graphs against all distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hnsw
from quern.llm.hnsw import neighbours

COLUMNS = "vec_id long, embedding array<float>"


def exact(ids, vectors, own, query, k):
    gaps = np.sqrt(((vectors.astype(np.float64) - query.astype(np.float64)) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, gaps)) if ids[i] != own]
    return [(int(ids[i]), float(gaps[i])) for i in order[:k]]


def recall(ids, vectors, every, k=10):
    index, hits = hnsw.build(ids, vectors), 0
    asked = ids % every == 0
    found = {}
    for row, i, gap in hnsw.nearest(index, ids[asked], vectors[asked], k):
        found.setdefault(row, []).append((i, gap))
    for row, (own, query) in enumerate(zip(ids[asked], vectors[asked], strict=True)):
        want = exact(ids, vectors, own, query, k)
        # equal distances to one another are as good
        hits += sum(gap <= want[-1][1] * (1 + 1e-9) for _, gap in found[row])
        assert len(found[row]) == len(want) and own not in {i for i, _ in found[row]}
    return hits / (k * asked.sum())


@pytest.mark.parametrize("kind", ["scattered", "clustered", "near copies", "line"])
def test_recall_in_one_shard(kind):
    draw = np.random.default_rng(5)
    n = 3000
    vectors = draw.normal(size=(n, 24))
    if kind == "clustered":
        vectors = draw.normal(size=(30, 24))[draw.integers(0, 30, n)] * 5 + 0.3 * vectors
    if kind == "near copies":
        vectors[: n // 2] = vectors[0] + 1e-4 * draw.normal(size=(n // 2, 24))
    if kind == "line":
        vectors = np.arange(n)[:, None] * np.ones((1, 24)) / n
    assert recall(np.arange(n), vectors.astype(np.float32), 20) >= 0.95


def test_every_node_is_reached_and_levels_thin_out():
    draw = np.random.default_rng(1)
    vectors = np.concatenate([draw.normal(size=(900, 8)), 50 + draw.normal(size=(900, 8)) * 1e-3, [[500.0] * 8]])
    index = hnsw.build(np.arange(len(vectors)), vectors)
    ground = index["links"][: index["sizes"][0] * index["widths"][0]].reshape(index["sizes"][0], -1)
    assert hnsw._reached(ground).all() and len(index["links"]) == sum(s * w for s, w in zip(index["sizes"], index["widths"], strict=True))
    assert index["sizes"] == sorted(index["sizes"], reverse=True) and len(index["sizes"]) > 1


def test_whole_table_over_several_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32)
    found = {}
    for r in neighbours(df, asked=F.col("id") % 100 == 0, shard_rows=400).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {*found} == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for own, got in found.items():
        assert [r for r, _, _ in sorted(got)] == list(range(1, 11)) and [(s, i) for _, i, s in sorted(got)] == sorted((s, i) for _, i, s in got)
        want = dict(exact(ids, vectors, own, vectors[ids == own][0], 10))
        hits += sum(i in want for _, i, _ in got)
        assert all(math.isclose(s, want[i], rel_tol=1e-12) for _, i, s in got if i in want)
    assert hits >= 0.95 * 10 * len(found)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.5]), (100, [-1.0, 3e38]), (7, [1e-30, -1e-30]), (200, [1.0, 2.0, 3.0]), (201, [1.0, 2.0, 4.0]), (300, [5.0])]
    bad = [(4, None), (5, []), (6, [0.0, -0.0]), (8, [None, 1.0]), (9, [nan, 1.0]), (10, [1.0, inf]), (None, [1.0, 1.0]), (500, [0.0, 0.0])]
    df = spark.createDataFrame(good + bad, COLUMNS).withColumns({"id": F.lit("clash"), "vector": F.lit(1), "dim": F.lit(2), "shard": F.lit(3), "rank": F.lit(4)})
    got = sorted(map(tuple, neighbours(df, asked=F.col("id") % 100 == 0, k=3).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 3), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2), (200, 1, 201)]
    assert got[0][3] == 0.0 and got[2][3] == 0.5 and got[-1][3] == 1.0 and all(math.isfinite(s) for *_, s in got)
    doubles = spark.createDataFrame([(i, [float(i), 0.1]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in sorted(neighbours(doubles, k=2).filter("query_id = 0").collect(), key=lambda r: r["rank"])] == [1, 2]
    assert neighbours(df.limit(0)).count() == 0


def test_many_copies_of_one_vector(spark):
    rows = [(i, [0.5, 0.25, 1.0]) for i in range(600)] + [(600 + i, [float(i), 1.0, 2.0]) for i in range(100)]
    got = neighbours(spark.createDataFrame(rows, COLUMNS), asked=F.col("id") % 100 == 0, shard_rows=150).collect()
    for q in (0, 300, 500):
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, 0.0) for i in range(11) if i != q][:10]
