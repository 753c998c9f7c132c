"""Approximate nearest neighbours by hierarchical navigable small-world graphs (Malkov and Yashunin, 2018), one for each shard.

A shard's graph is flat arrays: nodes are numbered by descending level, so those of a level are the first, and a level's
neighbours are a matrix with a row for each of them. A node links to diverse near ones of those numbered before it, and they
back to it. As a shard is bounded, the near ones are found in blocks of exact distances instead of by a search for each node."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.storage import few_rows, materialise

#: Rows of a shard, on average.
SHARD_ROWS = 8192
#: Queries that are searched together, on average.
QUERY_ROWS = 2048
#: Links that a new node makes on a level; on the ground level nodes hold up to twice as many and some spare ones.
LINKS = 16
SPARE = 4
#: Near ones among which a new node chooses its links, and nodes that a search holds.
BREADTH, BEAM = 48, 128
#: Nodes that a search looks around at a time.
_STEP = 4
_ROWS = 256


def levels_of(ids: np.ndarray) -> np.ndarray:
    """Each node's level by a hash of its id: geometric, a node in LINKS reaches the next."""
    draws = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 13) for i in ids], np.float64)
    return np.minimum(np.floor(-np.log((draws + 1) / 2**64) / math.log(LINKS)), 20).astype(np.int64)


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all others."""
    out = rows @ others.T
    out *= -2
    out += (rows * rows).sum(1)[:, None]
    out += (others * others).sum(1)[None, :]
    return out


def _diverse(near: np.ndarray, gaps: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates (node numbers by ascending distance, -1 for none), those closer to the row's node than to any
    one taken before, up to `most`; then the nearest of the others. As -1 padded rows."""
    n, width = near.shape
    points = vectors[near]
    between = np.matmul(points, points.transpose(0, 2, 1))
    square = np.einsum("nkd,nkd->nk", points, points)
    between = square[:, :, None] + square[:, None, :] - 2 * between
    taken, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    for k in range(width):
        clash = (taken & (between[:, k, :] < gaps[:, k, None])).any(axis=1)
        take = ~clash & (near[:, k] >= 0) & (count < most)
        taken[:, k] = take
        count += take
    order = np.argsort(np.where(near < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
    out = np.full((n, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, axis=1)
    return out


def _level_links(vectors: np.ndarray, width: int) -> np.ndarray:
    """The neighbour matrix of one level: each node's links to those before it and theirs back, pruned to `width`."""
    n = len(vectors)
    forward = np.full((n, LINKS), -1, np.int32)
    for start in range(0, n, _ROWS):
        stop = min(n, start + _ROWS)
        gaps = _distances(vectors[start:stop], vectors[:stop])
        gaps[np.arange(stop)[None, :] >= np.arange(start, stop)[:, None]] = np.inf
        near = np.argpartition(gaps, BREADTH - 1, axis=1)[:, :BREADTH] if stop > BREADTH else np.broadcast_to(np.arange(stop), gaps.shape)
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(gaps, near, axis=1), axis=1, kind="stable"), axis=1)
        own = np.take_along_axis(gaps, near, axis=1)
        forward[start:stop] = _diverse(np.where(np.isfinite(own), near, -1), own, vectors, LINKS)
    a, b = np.repeat(np.arange(n, dtype=np.int32), LINKS), forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    gaps = ((vectors[ends] - vectors[others]) ** 2).sum(axis=1)
    order = np.lexsort((others, gaps, ends))
    ends, others, gaps = ends[order], others[order], gaps[order]
    place = np.arange(len(ends)) - np.searchsorted(ends, ends)
    links = np.full((n, width), -1, np.int32)
    counts = np.bincount(ends, minlength=n)
    few = counts[ends] <= width
    links[ends[few], place[few]] = others[few]
    crowded = np.flatnonzero(counts > width)
    for start in range(0, len(crowded), _ROWS):
        some = crowded[start : start + _ROWS]
        rows = np.full(n, -1)
        rows[some] = np.arange(len(some))
        held = (rows[ends] >= 0) & (place < 4 * width)
        near, far = np.full((len(some), 4 * width), -1, np.int32), np.full((len(some), 4 * width), np.inf)
        near[rows[ends[held]], place[held]], far[rows[ends[held]], place[held]] = others[held], gaps[held]
        links[some] = _diverse(near, far, vectors, width)
    return links


def _reached(links: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(links), bool)
    front = np.array([0])
    while len(front):
        seen[front] = True
        front = np.unique(links[front])
        front = front[(front >= 0)]
        front = front[~seen[front]]
    return seen


def _mend(links: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The ground level with SPARE more columns, in which nodes that no way from the first reaches are linked from the nearest
    that one does and that has room."""
    links = np.concatenate([links, np.full((len(links), SPARE), -1, np.int32)], axis=1)
    while len(lost := np.flatnonzero(~(seen := _reached(links)))):
        room = np.flatnonzero(seen & (links[:, -1] < 0))
        if not len(room):
            break
        node = lost[0]
        by = room[np.argmin(((vectors[room] - vectors[node]) ** 2).sum(axis=1))]
        links[by, np.flatnonzero(links[by] < 0)[0]] = node
    return links


def build(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """The index of a shard's rows as flat arrays: `vectors`, one for each distinct vector; `ids` by vector, ascending, and
    `firsts`, where each vector's begin; `sizes` and `widths` of the levels from the ground up, and their `links`."""
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, of := of.ravel()))
    ids, of = ids[order], of[order]
    firsts = np.searchsorted(of, np.arange(len(distinct)))
    level = levels_of(ids[firsts])
    rank = np.lexsort((ids[firsts], -level))
    counts = np.diff(np.append(firsts, len(ids)))
    ids = np.concatenate([ids[firsts[r] : firsts[r] + counts[r]] for r in rank])
    firsts = np.concatenate([[0], np.cumsum(counts[rank])[:-1]])
    distinct, level = distinct[rank], level[rank]
    scaled = _scaled(distinct, _scale(distinct))
    sizes = [int((level >= x).sum()) for x in range(int(level[0]) + 1)]
    matrices = [_level_links(scaled[:size], LINKS if x else 2 * LINKS) for x, size in enumerate(sizes)]
    matrices[0] = _mend(matrices[0], scaled)
    return {"vectors": distinct, "ids": ids, "firsts": firsts, "sizes": sizes, "widths": [m.shape[1] for m in matrices], "links": np.concatenate([m.ravel() for m in matrices])}


def _scale(vectors: np.ndarray) -> float:
    return float(np.abs(vectors).max()) or 1.0


def _scaled(vectors: np.ndarray, by: float) -> np.ndarray:
    """What the graph is built and walked on: of a size that its squares can hold, and precise enough for copies that differ in
    their last digits."""
    return np.clip(vectors.astype(np.float64) / by, -1e100, 1e100)


def search(index: dict, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """For each query the vectors (numbers; -1 for none) that a walk down the levels holds at its end, and their Euclidean
    distances, in double precision, ascending."""
    by = _scale(index["vectors"])
    vectors, scaled, links, at = _scaled(index["vectors"], by), _scaled(queries, by), [], 0
    for size, width in zip(index["sizes"], index["widths"], strict=True):
        links.append(index["links"][at : at + size * width].reshape(size, width))
        at += size * width
    found = [_walk(links, vectors, scaled[i : i + _ROWS], beam) for i in range(0, len(queries), _ROWS)]
    nodes = np.concatenate(found) if found else np.zeros((0, beam), np.int32)
    gaps = np.full(nodes.shape, np.inf)
    for i in range(0, len(nodes), _ROWS):
        some = nodes[i : i + _ROWS]
        apart = index["vectors"][some].astype(np.float64).transpose(2, 0, 1) - queries[i : i + _ROWS].astype(np.float64).T[:, :, None]
        gaps[i : i + _ROWS] = np.where(some < 0, np.inf, np.sqrt((apart * apart).sum(axis=0)))  # dimensions one after another
    order = np.argsort(gaps, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(gaps, order, axis=1)


def _walk(links: list[np.ndarray], vectors: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    q, rows = len(queries), np.arange(len(queries))
    here, gap = np.zeros(q, np.int64), ((queries - vectors[0]) ** 2).sum(axis=1)
    for level in links[:0:-1]:
        moving = np.ones(q, bool)
        while moving.any():
            some = np.flatnonzero(moving)
            near = level[here[some]]
            gaps = np.where(near < 0, np.inf, ((vectors[near] - queries[some, None]) ** 2).sum(axis=2))
            best = gaps.argmin(axis=1)
            least = gaps[np.arange(len(some)), best]
            better = least < gap[some]
            here[some[better]], gap[some[better]] = near[np.arange(len(some)), best][better], least[better]
            moving[some[~better]] = False
    ground = links[0]
    held, gaps, done = np.full((q, beam), -1, np.int64), np.full((q, beam), np.inf), np.ones((q, beam), bool)
    held[:, 0], gaps[:, 0], done[:, 0] = here, gap, False
    seen = np.zeros((q, len(ground)), bool)
    seen[rows, here] = True
    while len(some := np.flatnonzero((~done).any(axis=1))):
        waiting = np.where(done[some], np.inf, gaps[some])
        pick = np.argpartition(waiting, _STEP - 1, axis=1)[:, :_STEP] if beam > _STEP else np.argsort(waiting, axis=1)
        real = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
        done[some[:, None], pick] = True
        near = np.where(real[:, :, None], ground[np.take_along_axis(held[some], pick, axis=1)], -1).reshape(len(some), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[some[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[np.repeat(some, fresh.sum(axis=1)), near[fresh]] = True
        at, place = np.nonzero(fresh)
        new = np.full(near.shape, np.inf)
        new[at, place] = ((vectors[near[at, place]] - queries[some[at]]) ** 2).sum(axis=1)
        every = np.concatenate([gaps[some], new], axis=1)
        keep = np.argpartition(every, beam - 1, axis=1)[:, :beam]
        gaps[some] = np.take_along_axis(every, keep, axis=1)
        held[some] = np.take_along_axis(np.concatenate([held[some], near], axis=1), keep, axis=1)
        done[some] = np.take_along_axis(np.concatenate([done[some], ~fresh], axis=1), keep, axis=1)
    return np.where(np.isfinite(gaps), held, -1)


def nearest(index: dict, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(row of the query, id, distance) of the `k` nearest ids of the shard for each query but those equal to its `own` id. Equal
    vectors come with all their ids, ties by the smaller one."""
    nodes, gaps = search(index, queries)
    ids, firsts, lasts = index["ids"], index["firsts"], np.append(index["firsts"][1:], len(index["ids"]))
    for row, (some, far) in enumerate(zip(nodes, gaps, strict=True)):
        got: list[tuple[float, int]] = []
        for node, gap in zip(some.tolist(), far.tolist(), strict=True):
            if node < 0 or len(got) >= k and gap > got[k - 1][0]:
                break
            got += [(gap, i) for i in ids[firsts[node] : min(lasts[node], firsts[node] + k + 1)].tolist() if i != own[row]]
            got.sort()
        yield from ((row, i, gap) for gap, i in got[:k])


_INDEX = "shard int, dim int, vectors binary, ids binary, firsts binary, sizes array<int>, widths array<int>, links binary"


def _packed(dtype: str):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        index = build(group["id"].to_numpy(np.int64), np.stack(group["vector"].to_list()).astype(dtype))
        flat = {k: [index[k].astype(t).tobytes()] for k, t in (("vectors", dtype), ("ids", "i8"), ("firsts", "i8"), ("links", "i4"))}
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "dim": [group["dim"].iloc[0]], "sizes": [index["sizes"]], "widths": [index["widths"]]} | flat)[["shard", "dim", "vectors", "ids", "firsts", "sizes", "widths", "links"]]

    return of


def _queries(dtype: str):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        flat = np.stack(group["vector"].to_list()).astype(dtype).tobytes()
        return pd.DataFrame({"block": [group["block"].iloc[0]], "dim": [group["dim"].iloc[0]], "own": [group["id"].to_numpy("i8").tobytes()], "asked": [flat]})

    return of


def _searched(dtype: str, k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                value = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                raw = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                dim = value("dim")
                index = {"vectors": raw("vectors", dtype).reshape(-1, dim), "ids": raw("ids", "i8"), "firsts": raw("firsts", "i8"), "sizes": value("sizes"), "widths": value("widths"), "links": raw("links", "i4")}
                own = raw("own", "i8")
                found = [*nearest(index, own, raw("asked", dtype).reshape(-1, dim), k)]
                rows, ids, gaps = zip(*found, strict=True) if found else ((), (), ())
                arrays = [pa.array(own[list(rows)], pa.int64()), pa.array([value("block")] * len(rows), pa.int32()), pa.array([dim] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array(ids, pa.int64()), pa.array(gaps, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "block", "dim", "row", "vec_id", "score"])

    return of


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector, dim) of the rows that take part: a key, and a vector that is neither null, empty nor zero and holds no null or
    non-finite component. Rows alike in both count once."""
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).filter(F.col("id").isNotNull() & v.isNotNull() & good)
    return rows.dropDuplicates(["id", "vector"]).withColumn("dim", F.size("vector"))


def neighbours(vectors: DataFrame, asked: Column | None = None, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` where `asked` (of `id`; all if None) holds, the `k` nearest found
    of the other rows by Euclidean distance, in double precision, from rank 1; ties to the smaller id.

    Rows take part as usable() says, each query among vectors of its own length; rows with a query's own id are not its
    neighbours; where an id has several vectors, each is a query, and its rows are told apart by their scores alone. An empty
    table gives an empty result. The search is approximate: see BREADTH and BEAM.

    Rows are dealt to shards of about `shard_rows` by a hash, so copies of one vector are spread, and within a shard equal vectors
    are one node. Graphs are stored as one row for each shard. Queries are packed in blocks, each block meets each shard's graph
    once, and the k nearest of each shard are merged. The work is queries times shards: larger shards make it less, up to what a
    task's memory holds (some 500 bytes a row of 64 single-precision components)."""
    spark = vectors.sparkSession
    dtype = "f4" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "f8"
    rows = materialise(usable(vectors, key, vector), "vectors")
    asked = F.lit(True) if asked is None else asked
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // QUERY_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))
    index = materialise(dealt.groupBy("shard", "dim").applyInPandas(_packed(dtype), _INDEX), "graphs")
    packed = rows.filter(asked).withColumn("block", F.pmod(F.xxhash64("vector", "id"), F.lit(blocks)).cast("int"))
    packed = packed.groupBy("block", "dim").applyInPandas(_queries(dtype), "block int, dim int, own binary, asked binary")
    met = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, ["shard", "dim"])
    with few_rows(spark):  # a row is a graph and a block of queries
        found = materialise(met.mapInArrow(_searched(dtype, k), "query_id long, block int, dim int, row int, vec_id long, score double"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id", "block", "dim", "row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
