import hashlib
import math

from pyspark.sql import functions as F

from quern.llm import mixing
from quern.llm.sharding import shard_documents


def brute_count(rate, key, seed):
    parts = max(1, math.ceil(rate / mixing.MAX_PART))
    total = 0
    for j in range(1, parts + 1):
        u = (int(hashlib.md5(f"poisson|{seed}|{key}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-rate / parts)
        k = 0
        while c < u:
            k += 1
            p *= rate / parts / k
            c += p
        total += k
    return total


def test_counts_invert_the_distribution(spark, docs):
    table = docs(*[(i, "x" * 9, "en", "big" if i % 10 else "small") for i in range(400)])
    found = mixing.mix_sources(table, {"big": 1.0, "small": 3.0}, epochs=10.0, seed=5)
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(table, {"big": 1.0, "small": 3.0}, 10.0, "source", "text").collect()}
    assert math.isclose(rates["small"], 0.75 * 10 * 400 / 40) and rates["small"] > mixing.MAX_PART
    got = {r["doc_id"]: r["n"] for r in found.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {i: brute_count(rates["big" if i % 10 else "small"], i, 5) for i in range(400)}
    assert got == {i: n for i, n in want.items() if n}
    mass = {r["source"]: r["n"] for r in found.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(mass["small"] / (mass["small"] + mass["big"]) - 0.75) < 0.03
    keys = [r["shuffle_key"] for r in found.collect()]
    assert len(set(keys)) == len(keys)


def test_weights_by_default(spark, docs):
    table = docs(*[(i, "x" * 99, "en", "a") for i in range(16)], (100, "y" * 99, "en", "b"))
    found = {r["source"]: (r["mass"], r["rate"]) for r in mixing.source_rates(table, None, 1.0, "source", "text").collect()}
    assert found["a"] == (1600, 40 / 50 * 1700 / 1600) and found["b"] == (100, 10 / 50 * 1700 / 100)


def test_the_shuffled_join_gives_the_same(spark, docs, monkeypatch):
    table = docs(*[(i, f"text {i}", "en", f"s{i % 7}" if i % 5 else None) for i in range(100)])
    usual = sorted(map(tuple, mixing.mix_sources(table).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_sources(table).collect())) == usual


def test_mixing_odd_rows(spark, odd):
    table = odd.withColumns({"copy": F.lit("clash"), "salt": F.lit(1), "mean": F.lit(2), "item": F.lit(3)})
    found = mixing.mix_sources(table, epochs=3.0)
    assert found.columns[-3:] == ["rate", "copy", "shuffle_key"] and {"salt", "mean", "item"} <= {*found.columns}
    rows = found.collect()
    fours = [r for r in rows if r["doc_id"] == 4]
    assert len(fours) % 2 == 0 and any(r["source"] is None for r in rows)
    assert mixing.mix_sources(odd, {"none": 1.0}).count() == 0 and mixing.mix_sources(odd.limit(0)).count() == 0


def test_shards_are_contiguous_and_balanced(spark, docs):
    table = docs(*[(i, "x" * (i * 37 % 500)) for i in range(2000)])
    rows = sorted(shard_documents(table, 40).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    sizes = {}
    for r in rows:
        assert r["size"] == len(r["text"]) + 16
        sizes.setdefault(r["shard"], []).append(r)
    assert len(sizes) == 40
    for own in sizes.values():
        assert [r["slot"] for r in own] == list(range(len(own)))
    totals = [sum(r["size"] for r in own) for own in sizes.values()]
    assert max(totals) - min(totals) <= 2 * 516


def test_sharding_odd_rows(spark, odd):
    found = shard_documents(odd.withColumns({"shard": F.lit("clash"), "rid": F.lit(1), "digest": F.lit(2)}), 4)
    rows = found.collect()
    assert len(rows) == odd.count() and {"rid", "digest"} <= {*found.columns}
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert {r["size"] for r in rows if r["text"] is None} == {16}
    empty = shard_documents(odd.limit(0), 4)
    assert empty.count() == 0 and {"size", "shard", "slot"} <= {*empty.columns}


def test_one_key_with_all_rows(spark, docs):
    rows = shard_documents(docs(*[(1, "same")] * 100), 10).collect()
    assert sorted(r["shard"] for r in rows) == [i // 10 for i in range(100)]
