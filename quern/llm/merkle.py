"""Merkle dataset manifest with parent-preimage paths.

Rows are leaves; each run of eight nodes has a parent, whose preimage, the concatenated hashes of its children, is stored. A
row's path is the preimages of its ancestors and its slot in each: with its own 64 characters excised they are the siblings of
a proof; with another hash spliced in, level by level, they fold to the root that this hash would give."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import discard, materialise, numbered

#: Children of a node.
RUN = 8
#: Characters of a hash.
WIDTH = 64


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def framed(*values: Column) -> Column:
    """Values as one text from which they can be read again: `-` for null, else UTF-8 byte count, `:`, value."""

    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.concat(*map(one, values))


def lowered(text: Column) -> Column:
    """A to Z in lower case; all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(preimage: Column, slot: Column) -> Column:
    """A preimage without the hash in `slot` (from 0): its siblings."""
    return F.concat(F.substring(preimage, F.lit(1), slot * WIDTH), F.substring(preimage, (slot + 1) * WIDTH + 1, F.lit(RUN * WIDTH)))


def spliced(preimage: Column, slot: Column, other: Column) -> Column:
    """A preimage with `other` in `slot` (from 0)."""
    return F.concat(F.substring(preimage, F.lit(1), slot * WIDTH), other, F.substring(preimage, (slot + 1) * WIDTH + 1, F.lit(RUN * WIDTH)))


def proof_of(path: Column) -> Column:
    """The siblings along a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: without(p["preimage"], p["slot"])), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that `leaf` gives along a path."""
    return F.aggregate(path, leaf, lambda h, p: digest(spliced(p["preimage"], p["slot"], h)))


_PATH = "array<struct<preimage:string,slot:int>>"


def _up(place: str) -> Column:
    return F.expr(f"{place} div {RUN}")


def _step(preimage: str, place: str) -> Column:
    return F.array(F.struct(F.col(preimage).alias("preimage"), (F.col(place) % RUN).cast("int").alias("slot")))


def _parents(nodes: DataFrame) -> DataFrame:
    """The parents (tree, place, n, preimage, hash) of nodes (tree, place, n, hash), where a tree has n > 1 nodes on the level: a
    group has RUN rows at most, which are combined in part before the shuffle."""
    kids = F.sort_array(F.collect_list(F.struct("place", "hash")))
    runs = nodes.filter("n > 1").groupBy("tree", _up("place").alias("at")).agg(F.max("n").alias("m"), kids.alias("kids"))
    joined = runs.select("tree", F.col("at").alias("place"), F.expr(f"(m + {RUN - 1}) div {RUN}").alias("n"), F.array_join(F.transform("kids", lambda x: x["hash"]), "").alias("preimage"))
    return joined.withColumn("hash", digest(F.col("preimage")))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The tables of the levels above `nodes` up to their roots, each an eighth of the one below."""
    most, found = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1:
        nodes = materialise(_parents(nodes), f"nodes-{len(found) + 1}")
        found.append(nodes)
        most = -(-most // RUN)
    return found


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of what remains of each tree."""
    out = nodes.filter("n = 1").select("tree", "hash")
    for level in levels:
        out = out.unionByName(level.filter("n = 1").select("tree", "hash"))
    return out


def _joined(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """`nodes` with `path`, the preimages and slots up to the root, and `subroot`. What lies beyond a tree's own root is that of
    `above` (tree, path, subroot). Paths go down level by level, so that a preimage is joined to an eighth of the nodes below
    it at a time; a key has RUN rows at most, and trees are joined at their roots alone."""
    tree, over = above.select(F.col("tree").alias("of"), "path", "subroot"), None
    for i, level in reversed([*enumerate([nodes, *levels])]):
        found = level.filter("n = 1").join(tree, F.col("tree").eqNullSafe(F.col("of")), "left").drop("of")
        if over is not None:
            parents = over.select(F.col("tree").alias("of"), F.col("place").alias("at"), F.col("preimage").alias("next"), F.col("path").alias("rest"), "subroot")
            under = level.filter("n > 1").join(parents, F.col("tree").eqNullSafe(F.col("of")) & (_up("place") == F.col("at")))
            found = found.unionByName(under.withColumn("path", F.concat(_step("next", "place"), "rest")).drop("of", "at", "next", "rest"))
        over = materialise(found, f"paths-{i}") if i else found
    return over


#: Columns of a leaf, in their order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", columns: Sequence[str] = COLUMNS, changed: Mapping[str, Column] | None = None, where: Column | None = None) -> tuple[DataFrame, str | None]:
    """The manifest of `docs` and its root: (key, leaf, subroot, path, other_leaf) of each row.

    A leaf is the hash of the row's `columns`, framed by their byte counts. In each `group` leaves ascend by `key` (nulls first,
    ties by leaf); while several nodes remain, each RUN of them (the last run: fewer, even one) becomes the hash of their
    hashes. What remains is the group's subroot; subroots, by group (null first, bytewise), likewise give the root. `path` is
    the preimages and slots from the leaf to the root, empty for a single row. Where `where` holds, other_leaf is the leaf with
    the columns in `changed` replaced; else null.

    Nulls in any column are framed as such; a null group is a group of its own; rows that repeat are leaves of their own, one
    after another. An empty table gives an empty result and no root. Columns that are not named are not read.

    Texts are read once and only hashes shuffled. Leaves are numbered over ranges of (group, key, leaf), so a group with a third
    of all rows is spread; runs have RUN rows at most. The driver learns the number of levels and the root."""
    other = digest(framed(*[(changed or {}).get(c, F.col(c)) for c in columns]))
    slim = materialise(docs.select(
        F.col(key).alias("key"), F.col(group).cast("string").alias("tree"), digest(framed(*map(F.col, columns))).alias("hash"),
        F.when(F.lit(False) if where is None else where, other).alias("other_leaf"), F.monotonically_increasing_id().alias("row"),
    ), "leaves")
    leaves = numbered(slim, ["tree"], ["key", "hash", "row"], "place", "n", "leaves").drop("row")
    discard(slim)
    levels = _levels(leaves)
    crown = numbered(_tops(leaves, levels).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "hash"), ["tree"], ["group"], "place", "n", "subroots")
    higher = _levels(crown)
    root = _tops(crown, higher).first()
    start = leaves.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    above = _joined(crown, higher, start).select(F.col("group").alias("tree"), "path", F.col("hash").alias("subroot"))
    found = _joined(leaves, levels, materialise(above, "subroot-paths"))
    return found.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "path", "other_leaf"), root["hash"] if root else None


def proofs(docs: DataFrame, **how) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row's manifest(): the hash of its siblings, the root
    that its path folds to from other_leaf (or from the leaf where that is null), and whether that is the root."""
    found, root = manifest(docs, **how)
    out = found.withColumns({"root": F.lit(root).cast("string"), "proof_sha256": digest(proof_of(F.col("path"))), "folded_root": folded(F.col("path"), F.coalesce("other_leaf", "leaf"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "other_leaf")
