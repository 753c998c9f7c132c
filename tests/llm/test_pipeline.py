from collections import Counter

from compare import TINY
from pyspark.sql import functions as F
from test_decontamination import shingles as leak_shingles
from test_decontamination import words_of
from test_simhash import shingles

import corpus_pipeline as cp
from quern.llm.storage import materialise


def test_stages_in_order():
    assert [f.__name__ for _, f in cp.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    states = [docs]
    for name, stage in cp.STAGES:
        states.append(materialise(stage(spark, states[-1], TINY), f"test-{name.replace(' ', '-')}"))
        if stage is not cp.sharding:
            assert states[-1].columns == cp.COLUMNS
    ids = [[r["doc_id"] for r in s.select("doc_id").collect()] for s in states]
    assert set(ids[1]) == {i for i in ids[0] if any(c.isalpha() for c in text[i])}
    # every text that went has a kept one like it, and no two kept ones are alike
    kept, marks = ids[2], {i: shingles(text[i]) for i in ids[1]}
    like = lambda a, b: len(marks[a] & marks[b]) / max(1, len(marks[a] | marks[b]))
    assert len(kept) == len(set(kept))
    for i in set(ids[1]) - set(kept):
        assert max(like(i, j) for j in ids[1] if j != i) >= 0.7
    assert max(like(a, b) for a in kept for b in kept if a < b) < 0.8
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    known = Counter(x for w in items for x in set(leak_shingles(w)))
    gone = set(kept) - set(ids[3])
    held = {i: sum(x in known for x in leak_shingles(words_of(text[i]))) for i in kept}
    assert all(held[i] > 5 for i in gone) and all(held[i] < 12 for i in ids[3])
    assert set(ids[4]) <= set(ids[3]) and len(ids[4]) > 0.7 * len(ids[3])
    assert sorted(ids[5]) == sorted(ids[4])


def test_run_gives_the_same_rows(spark):
    a = cp.run(spark, TINY)
    assert {"shard", "slot", "size", *cp.COLUMNS} == {*a.columns}
    assert sorted((r["doc_id"], r["shard"]) for r in a.collect()) == sorted((r["doc_id"], r["shard"]) for r in cp.run(spark, TINY).collect())


def test_stages_take_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd, odd.limit(0)):
        state, ids, some = table, {}, table is odd
        for name, stage in cp.STAGES:
            state = materialise(stage(spark, state, str(tmp_path)), f"odd-{name.replace(' ', '-')}")
            ids[stage.__name__] = sorted((r["doc_id"] for r in state.collect()), key=str)
        assert ids["language"] == ([10, 4, 4, 5, 6, 7, 8, None] if some else [])
        assert ids["near_duplicates"] == ids["decontamination"] == ([10, 4, 5, 7, 8, None] if some else [])
        assert {*ids["mixing"]} <= {*ids["decontamination"]} and ids["sharding"] == ids["mixing"] and bool(ids["mixing"]) == some


def test_stages_drop_clashing_columns(spark, odd, tmp_path):
    spark.createDataFrame([(1, "null key text here now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("key", "digest", "row", "shard", "slot", "size", "copy", "rate", "mixed", "lang_pred", "score", "place", "leak_row", "n", "words")
    wide = odd.withColumns({c: F.lit("clash") for c in names})
    kept = {"language": {None, 4, 5, 6, 7, 8, 10}, "near_duplicates": {None, 1, 3, 4, 5, 7, 8, 9, 10}, "decontamination": {None, *range(1, 11)}}
    for _, stage in cp.STAGES:
        found = materialise(stage(spark, wide, str(tmp_path)), "clash")
        if stage is cp.sharding:
            assert found.count() == wide.count() and {"shard", "slot", "size"} <= {*found.columns} and {r["size"] for r in found.filter("text IS NULL").collect()} == {16}
        else:
            assert found.columns == cp.COLUMNS
            if stage.__name__ in kept:
                assert {r["doc_id"] for r in found.collect()} == kept[stage.__name__]
    left = cp.decontamination(spark, wide, str(tmp_path)).filter("doc_id IS NULL").collect()
    assert [r["text"] for r in left] == [None]  # the row that holds the item goes, the other with a null doc_id stays


def test_shards_are_in_mixed_order(spark, docs):
    table = docs(*[(i // 4, f"text of document {i // 4} with some words", "en", f"src{i // 400}") for i in range(1200)])
    rows = sorted((r["shard"], r["slot"], r["doc_id"], r["source"]) for r in cp.sharding(spark, table, TINY).collect())
    assert sorted(r[2] for r in rows) == [i // 4 for i in range(1200)]
    beside = sum(a[2] == b[2] for a, b in zip(rows, rows[1:], strict=False))
    sources = sum(a[3] == b[3] for a, b in zip(rows, rows[1:], strict=False))
    assert beside < 30 and sources < 600
    again = sorted((r["shard"], r["slot"], r["doc_id"], r["source"]) for r in cp.sharding(spark, table.repartition(3), TINY).collect())
    assert rows == again
