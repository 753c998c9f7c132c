import random
import re

import numpy as np
import pytest
import xxhash
from compare import TINY
from pyspark.sql import functions as F

from quern.llm import graph, neardup, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_classes(rows):
    """component_id by comparing every pair; rows without a key take part without naming a class."""
    prints = [brute_print(t) for _, t in rows]
    sets = Sets(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                sets.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[sets.find(i)] = min(key, least.get(sets.find(i), key))
    return sorted(((k, f"{p:016x}", least.get(sets.find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def test_query_against_brute_force(spark):
    from quern.llm.queries import op10_simhash_components

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    assert sorted(map(tuple, op10_simhash_components(spark, TINY).collect()), key=repr) == brute_classes(rows)


def test_odd_rows(spark, odd):
    found = simhash.cluster(odd.withColumns({"key": F.lit(1), "fp": F.lit("clash"), "component_id": F.lit(2)}))
    got = sorted(((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in found.collect()), key=repr)
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.cluster(odd.limit(0)).count() == 0


def test_spark_agrees_on_the_hash(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert value % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize(("bucket", "radius"), [(64, 2), (4, 2), (4, 1)])
def test_dense_groups_lose_no_connection(spark, monkeypatch, bucket, radius):
    draw = random.Random(radius)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    centre, prints = draw.getrandbits(64), set()
    while len(prints) < 200:
        x = centre
        for _ in range(draw.randint(0, 6)):
            x ^= 1 << draw.randrange(64)
        prints.add(x)
    prints |= {draw.getrandbits(64) for _ in range(100)}
    links = simhash.links_within(spark.createDataFrame([(0, simhash._signed(p)) for p in prints], "t int, fp long"), radius).collect()
    assert all((a.u % 2**64 ^ a.v % 2**64).bit_count() <= 2 and (radius == 2 or (a.u % 2**64 ^ a.v % 2**64).bit_count() == 1) for a in links)
    found, wanted = Sets(prints), Sets(prints)
    for a in links:
        found.join(a.u % 2**64, a.v % 2**64)
    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= radius:
                wanted.join(a, b)
    assert {p: found.find(p) for p in prints} == {p: wanted.find(p) for p in prints}


def test_coordinates_bound_distances():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    gaps = np.abs(simhash.distance_tables(a) - simhash.distance_tables(b)).max(axis=1)
    assert (gaps <= np.bitwise_count(a ^ b)).all()
    salts = np.zeros(500, np.int64)
    assert (simhash.search_keys(a, salts, 2, 4) == simhash.search_keys(b, salts, 2, 4)).any(axis=1).all()


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randrange(100, 400), draw.randrange(100, 400)) for _ in range(200)] + [(5, 5), (3, 2), (2, 3)]
    sets = Sets(range(500))
    for a, b in edges:
        sets.join(a, b)
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: sets.find(n) for n in {x for a, b in edges if a != b for x in (a, b)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    words = neardup.plain_words(text or "")
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(spark, docs, words):
    base = {i: words(200, i) for i in range(12)}
    table = [(100 + i, " ".join(w)) for i, w in base.items()]
    for i, w in base.items():
        close = list(w)
        close[40] = "changed"
        far = [x if j % 5 else "other" for j, x in enumerate(w)]
        table += [(i, " ".join(close)), (200 + i, " ".join(far)), (300 + i, " ".join(w).upper() + " !"), (400 + i, " ".join(w))]
    found = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicate_classes(docs(*table)).collect()}
    for i in base:
        assert found[100 + i] == found[i] == found[300 + i] == found[400 + i] == i and found[200 + i] == 200 + i
    kept = {r["doc_id"] for r in neardup.keep_one_of_each(docs(*table)).collect()}
    assert kept == {*range(12), *range(200, 212)}


def test_dense_near_copies_form_one_class(spark, docs, words):
    base, table = words(300, 1), []
    for i in range(150):
        own = list(base)
        for j in random.Random(i).sample(range(300), 2):
            own[j] = f"edit{i}x{j}"
        table.append((i, " ".join(own)))
    assert {r["class_key"] for r in neardup.near_duplicate_classes(docs(*table)).collect()} == {0}


def test_similarity_is_estimated_well(spark, words):
    base, rows = words(600, 3), []
    for share in (0.0, 0.02, 0.05, 0.5):
        other = [x if random.Random(j).random() > share else f"new{j}" for j, x in enumerate(base)]
        a, b = neardup.sketches([" ".join(base), " ".join(other)])
        x, y = shingles(" ".join(base)), shingles(" ".join(other))
        assert (len(a[4]), len(b[4]), len(np.intersect1d(a[4], b[4]))) == (len(x), len(y), len(x & y))
        rows.append((a[2], b[2], len(x & y) / len(x | y)))
    table = spark.createDataFrame(rows, "a array<long>, b array<long>, real double")
    assert all(abs(r["found"] - r["real"]) < 0.12 for r in table.select("real", neardup.estimated_similarity(F.col("a"), F.col("b")).alias("found")).collect())


def test_keeping_one_of_odd_rows(spark, odd):
    found = neardup.keep_one_of_each(odd.withColumns({"digest": F.lit("own"), "place": F.lit(1)}))
    rows = found.collect()
    assert [r["doc_id"] for r in rows].count(4) == 1 and {r["doc_id"] for r in rows} >= {1, 3, 4, 5, 7, 8, 9, 10} and 6 not in {r["doc_id"] for r in rows}
    assert found.columns[-2:] == ["digest", "place"] and all(r["digest"] == "own" for r in rows)
    assert neardup.keep_one_of_each(odd.limit(0)).count() == 0


def test_copies_that_differ_by_a_block_are_found(spark, docs, words):
    table, wanted = [], {}
    for i in range(60):
        base = words(150, i, 5000)
        for kind, other in enumerate((base + words(30, 900 + i, 5000), base[:125], base[:137] + words(13, 700 + i, 5000))):
            a = 10 * i + 1000 * kind
            own = [f"{w}{kind}" for w in base]
            table += [(a, " ".join(own)), (a + 1, " ".join(f"{w}{kind}" for w in other))]
            x, y = shingles(table[-2][1]), shingles(table[-1][1])
            assert len(x & y) / len(x | y) >= 0.8
            wanted |= {a: a, a + 1: a}
    assert {r["doc_id"]: r["class_key"] for r in neardup.near_duplicate_classes(docs(*table)).collect()} == wanted


def test_near_pair_among_unlike_texts_of_one_vocabulary(spark, docs, words):
    base, table = [f"w{i}" for i in range(120)], []
    for i in range(150):
        table.append((i, " ".join(random.Random(i).sample(base, 120))))
    swapped = table[70][1].split()
    swapped[50], swapped[51] = swapped[51], swapped[50]
    table.append((500, " ".join(swapped)))
    found = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicate_classes(docs(*table)).collect()}
    assert found == {i: i for i in range(150)} | {500: 70}


def _brute_classes(texts):
    """The least id of each text's component by all pairs of shingle sets."""
    sets, ids = Sets(texts), sorted(texts)
    marks = {i: shingles(t) for i, t in texts.items()}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            x, y = marks[i], marks[j]
            if texts[i] == texts[j] or x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                sets.join(i, j)
    return {i: sets.find(i) for i in ids}


def test_pair_recall_in_a_dense_group(spark, docs, words):
    # a third of the table is copies of one text, each edited by itself to a similarity around the threshold and above
    base, table = words(160, 1, 5000), {}
    for i in range(400):
        draw, own = random.Random(i), list(base)
        for j in draw.sample(range(160), draw.choice([1, 2, 3, 4])):
            own[j] = f"edit{i}x{j}"
        table[i] = " ".join(own)
    table |= {1000 + i: " ".join(words(160, 50 + i, 5000)) for i in range(400)}
    found = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicate_classes(docs(*table.items())).collect()}
    wanted = _brute_classes(table)
    together = [(i, j) for i in table for j in table if i < j and wanted[i] == wanted[j]]
    assert sum(found[i] == found[j] for i, j in together) >= 0.99 * len(together) and len(together) > 50_000
    assert all(wanted[i] == wanted[found[i]] for i in found)


def test_pairs_among_texts_with_a_passage_in_common(spark, docs, words, monkeypatch):
    # unlike texts share most of their shingles' least; pairs hidden among them are found, and rows stay linear
    tried = []
    own = neardup._by_keys
    monkeypatch.setattr(neardup, "_by_keys", lambda *given: tried.append(own(*given)) or tried[-1])
    counted = neardup.discard
    monkeypatch.setattr(neardup, "discard", lambda *tables: counted(*[t for t in tables if t not in tried]))
    rows, table = {}, {}
    for n in (600, 1800):
        passage = words(110, 7, 5000)
        table = {i: " ".join(words(50, 100 + i, 5000) + passage) for i in range(n)}
        for i in range(40):
            near = table[i].split()
            for j in random.Random(i).sample(range(50), 3):
                near[j] = f"edit{i}x{j}"
            table[10_000 + i] = " ".join(near)
        found = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicate_classes(docs(*table.items())).collect()}
        likeness = {i: len(shingles(table[i]) & shingles(table[10_000 + i])) / len(shingles(table[i]) | shingles(table[10_000 + i])) for i in range(40)}
        wanted = [i for i in range(40) if likeness[i] >= 0.8]
        assert len(wanted) > 30 and sum(found[i] == found[10_000 + i] for i in wanted) >= 0.95 * len(wanted)
        assert all(found[i] == i for i in range(40, n))
        rows[n] = tried[-1].count()
    assert rows[1800] < 5 * rows[600]


@pytest.mark.parametrize(("bucket", "left", "right"), [(4, 8, 16), (32, 64, 512)])
def test_crowds_of_unlike_texts_that_share_keys_lose_no_pair(spark, docs, words, monkeypatch, bucket, left, right):
    """Texts edited each by itself from one that is not there: pairs are below the threshold but for hidden ones, all in one crowd."""
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    monkeypatch.setattr(neardup, "LEFT", left)
    monkeypatch.setattr(neardup, "RIGHT", right)
    base, table = words(300, 3, 5000), {}
    for i in range(240):
        own = list(base)
        for j in random.Random(i).sample(range(300), 7):
            own[j] = f"edit{i}x{j}"
        table[i] = " ".join(own)
        if i % 8 == 0:
            for j in random.Random(-i - 1).sample(range(300), 5):
                own[j] = f"again{i}x{j}"
            table[1000 + i] = " ".join(own)
    found = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicate_classes(docs(*table.items())).collect()}
    wanted = _brute_classes(table)
    assert 100 < len(set(wanted.values())) < len(table) and found == wanted


def test_pairs_of_a_crowd_do_not_become_rows(spark, docs, words, monkeypatch):
    made, own = [], neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, label: made.append(own(df, label)) or made[-1])
    monkeypatch.setattr(neardup, "discard", lambda *tables: None)
    base, table = words(300, 3, 5000), {}
    for i in range(400):  # unlike, but alike enough to share keys and to look alike in samples
        edited = list(base)
        for j in random.Random(i).sample(range(300), 7):
            edited[j] = f"edit{i}x{j}"
        table[i] = " ".join(edited)
    found = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicate_classes(docs(*table.items())).collect()}
    assert found == _brute_classes(table)
    assert all(t.count() <= neardup.TABLES * len(table) for t in made)


@pytest.mark.parametrize("bits", [8, 1 << 25])
def test_only_sets_that_are_wanted_are_given(spark, monkeypatch, bits):
    monkeypatch.setattr(neardup, "WANTED", bits)  # few bits let all pass to the join
    rows = [(f"d{i}", [i], [i], [i, i + 1] if i % 7 else None) for i in range(2000)]
    sketched = spark.createDataFrame(rows + rows[:300], "digest string, search array<long>, sample array<long>, shingles array<int>")
    wanted = spark.createDataFrame([(f"d{i}",) for i in (*range(0, 2000, 3), 3, 5000)], "digest string")
    found = sorted((r["digest"], r["shingles"]) for r in neardup.sets_of(wanted, sketched).collect())
    assert found == sorted((f"d{i}", [i, i + 1]) for i in range(0, 2000, 3) if i % 7)


def test_classes_of_a_whole_table_against_brute_force(spark):
    from compare import TINY

    table = spark.read.parquet(f"{TINY}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    found = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicate_classes(table).collect()}
    assert found == _brute_classes(texts)


def test_finished_steps_leave_no_files(spark, docs, words, tmp_path, monkeypatch):
    from quern.llm import storage

    monkeypatch.setattr(storage, "scratch_root", lambda spark: str(tmp_path))
    table = docs(*[(i, " ".join(words(60, i // 2))) for i in range(20)])
    assert {r["class_key"] for r in neardup.near_duplicate_classes(table).collect()} == set(range(0, 20, 2))
    left = {x.name.rsplit("-", 1)[0] for x in (tmp_path / "quern").iterdir()}
    assert not left & {"sketches", "texts", "pairs", "judged", "shingles", "members", "sizes"} and "near-duplicates" in left
