"""The manifest against plain loops over the same rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm.merkle import lowered, manifest, proofs


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    cells = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if lower and cells[4] is not None:
        cells[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in cells[4])
    return h("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def climb(hashes):
    """The levels of a tree, leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def runs(levels, place):
    for level in levels[:-1]:
        yield level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
        place //= 8


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf_of(r) for r in groups[g]]) for g in names}
    crown = climb([trees[g][-1][0] for g in names])
    root, out = crown[-1][0], []
    for g in names:
        for i, r in enumerate(groups[g]):
            way = [*runs(trees[g], i), *runs(crown, names.index(g))]
            siblings = "".join("".join(run[:k] + run[k + 1 :]) for run, k in way)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            top = leaf_of(r, tampered)
            for run, k in way:
                top = h("".join([*run[:k], top, *run[k + 1 :]]))
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], root, h(siblings), top, top == root))
    return sorted(out, key=str)


def found(df):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = proofs(df, changed={"text": lowered(F.col("text"))}, where=third)
    return sorted((tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("n", [1, 9, 75])
def test_trees_of_many_sizes(spark, docs, n):
    table = docs(*[(i, f"Text NUMBER {i} Ü", "en" if i < n - 1 or n < 3 else "de") for i in range(n)])
    assert found(table) == brute(table.collect())


def test_odd_rows(spark, odd, docs):
    table = odd.union(docs(*[(i, "Same", None) for i in range(20, 37)])).union(docs((40, "x", "zz"), (41, "y", "Zz"), (42, "z", "é"), (43, "", "")))
    clashing = table.withColumns({"tree": F.lit(1), "hash": F.lit("x"), "place": F.lit(0), "path": F.lit(0), "key": F.lit(5), "n": F.lit(9)})
    assert found(clashing) == found(table) == brute(table.collect())


def test_many_groups(spark, docs):
    table = docs(*[(i, "t", f"l{i % 70}") for i in range(150)])
    assert found(table) == brute(table.collect())


def test_an_empty_table_has_no_root(spark, odd):
    rows, root = manifest(odd.limit(0))
    assert rows.count() == 0 and root is None and found(odd.limit(0)) == []
