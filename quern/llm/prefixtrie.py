"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it. The member with the smallest
id owns the node. As deeper nodes have fewer members, what a conversation owns of its own path is a suffix of it, and of the
tokens that its members' turns hold below a node, those on turns which their conversation doesn't own are what sharing saves.
So windows mark owned nodes, and one group-by of prefixes sums what lies below them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.storage import bound_batches, discard, materialise, numbered

#: Turns of a conversation that one window handles; longer conversations are cut, and totals of their blocks carried over.
BLOCK = 4096
#: Children of one parent are dealt to so many tasks.
SALTS = 32
#: Ids that end at one node are joined in blocks of 2 ** ID_BITS ids.
ID_BITS = 12
#: What tells a node apart: its depth and 128 bits of its turns.
NODE = ("depth", "xa", "xb")


def turns_of(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, a, b, chars, pos, n): each turn's 128-bit digest of role and text (null: empty), the code points of its text, its
    place in its conversation from 0, ordered by `turn` (null first; ties by the digest), and the conversation's turns. Rows
    that repeat are turns of their own; rows without a key belong to no conversation. Written to the shared folder."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    slim = conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), *said).alias("a"), F.xxhash64(F.lit(2), *said).alias("b"),
        F.char_length(said[1]).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"),
    )
    slim = materialise(slim, "turns")
    found = numbered(slim, ["conv"], ["turn", "a", "b", "row"], "pos", "n", "turns")
    discard(slim)
    return found


def steps_of(turns: DataFrame, base: Column | None = None, heads: Column | None = None, most: int = 0) -> DataFrame:
    """(conv, depth, ends, a, b, chars): the steps of each conversation's path, with the root at depth 0.

    With `base` and `heads` (of `conv`) each conversation is rebuilt: the first `heads` turns (`most` at most) of conversation
    `base` (all if it has fewer, none if it is absent), then its own after its first `heads`."""
    base, heads = (F.col("conv"), F.lit(0)) if base is None else (base, heads)
    convs = turns.groupBy("conv").agg(F.max("n").alias("n")).withColumns({"base": base, "heads": heads.cast("long")})
    lengths = convs.select(F.col("conv").alias("of"), F.col("n").alias("given"))
    convs = convs.join(lengths, F.col("base") == F.col("of"), "left").withColumn("taken", F.least("heads", F.coalesce("given", F.lit(0))))
    convs = materialise(convs.select("conv", "n", "base", "heads", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).alias("length")), "conversations")
    steps = convs.select("conv", F.lit(0).cast("long").alias("depth"), "length", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("chars"))
    # a long conversation's turns meet it in blocks
    blocks = convs.select("conv", "heads", "taken", "length", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {BLOCK}"))).alias("block"))
    own = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, ["conv", "block"]).filter("pos >= heads")
    steps = steps.unionByName(own.select("conv", (F.col("pos") - F.col("heads") + F.col("taken") + 1).alias("depth"), "length", "a", "b", "chars"))
    if most:
        first = turns.filter(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "a", "b", "chars")
        shared = convs.filter("taken > 0").select("conv", "base", "taken", "length").join(first, "base").filter("pos < taken")
        steps = steps.unionByName(shared.select("conv", (F.col("pos") + 1).alias("depth"), "length", "a", "b", "chars"))
    return steps.select("conv", "depth", (F.col("depth") == F.col("length")).alias("ends"), "a", "b", "chars")


def _running(df: DataFrame, total, back: bool = False, **values: str) -> DataFrame:
    """`df` with running totals by depth (from the deepest if `back`) within each conversation: within blocks, plus what the blocks
    before add up to. `total` is F.sum or F.bit_xor."""
    add = (lambda x, y: x + y) if total is F.sum else (lambda x, y: x.bitwiseXOR(y))
    cut = df.withColumn("block", F.expr(f"depth div {BLOCK}"))
    order = (lambda c: F.desc(c)) if back else (lambda c: F.asc(c))
    inner = Window.partitionBy("conv", "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("conv", "block").agg(*[total(v).alias(k) for k, v in values.items()])
    before = before.select("conv", "block", *[F.coalesce(total(k).over(outer), F.lit(0)).alias(f"before_{k}") for k in values])
    within = cut.withColumns({k: total(v).over(inner) for k, v in values.items()})
    return within.join(before, ["conv", "block"]).withColumns({k: add(F.col(k), F.col(f"before_{k}")) for k in values}).select(*df.columns, *values)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's segments, which come in order: only the state of one digest is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for *key, segment in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(segment.encode())
            else:
                state.update(b"," + segment.encode())
        if done:
            yield _digest_batch(done)
    if node is not None:
        yield _digest_batch([(*node, state.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    *node, digests = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in node), pa.array(digests, pa.string())], names=[*NODE, "ends_sha256"])


def _ends(path: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: their ids, ascending, with commas between. Ids are sorted and
    joined in blocks first, and a node's blocks streamed through one digest."""
    bound_batches(path.sparkSession)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    parts = path.filter("ends").groupBy(*NODE, F.shiftright("conv", ID_BITS).alias("part")).agg(ids.alias("ids"))
    laid = parts.repartition(*NODE).sortWithinPartitions(*NODE, "part")
    return laid.select(*NODE, "ids").mapInArrow(_digests, "depth long, xa long, xb long, ends_sha256 string")


def trie(steps: DataFrame) -> DataFrame:
    """One row for each node of the trie of `steps` (as steps_of() gives them): conv_id (its smallest member), depth, parent_conv_id
    (that of its parent; null for the root), n_convs (members), n_children, n_leaves (childless nodes in its subtree, itself
    included), saved_tokens (summed over its subtree, itself included: members less one, times the code points of the node's
    last text) and ends_sha256 (of the comma-joined ids of members that end there, ascending; of nothing if none does).

    Nodes are compared by 128 bits of all their turns, which change with a turn's depth, so prefixes are running XORs. No group
    meets in one task: prefixes are counted in part before the shuffle, a window's first row is chosen in each task first,
    long conversations are cut into blocks, and the many children of one parent find it through salts. An empty table gives an
    empty result."""
    keyed = steps.withColumns({"ha": F.xxhash64("depth", "a"), "hb": F.xxhash64("depth", "b")})
    path = _running(keyed, F.bit_xor, xa="ha", xb="hb")
    path = materialise(path.select("conv", *NODE, "ends", "chars", F.col("xa").bitwiseXOR(F.col("ha")).alias("pa"), F.col("xb").bitwiseXOR(F.col("hb")).alias("pb")), "paths")

    first = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv"))
    owned = path.withColumn("place", first).filter("place = 1").select("conv", *NODE, "pa", "pb", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).alias("salt"))
    owned = materialise(owned, "owned")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("xa"), F.col("pb").alias("xb")]
    dealt = owned.filter("depth > 0").groupBy(*parent, "salt").agg(F.count(F.lit(1)).alias("n"))
    children = dealt.groupBy(*NODE).agg(F.sum("n").alias("n_children"), F.collect_set("salt").alias("salts"))  # SALTS at most
    nodes = materialise(owned.join(children, [*NODE], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    marks = nodes.select("conv", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"))
    marked = path.join(marks, ["conv", "depth"], "left").withColumn("shared", F.when(F.col("leaf").isNull(), F.col("chars")).otherwise(F.lit(0)))
    below = _running(marked.select("conv", *NODE, "shared", F.coalesce("leaf", F.lit(0)).alias("leaf")), F.sum, back=True, saved="shared", leaves="leaf")
    sums = below.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    over = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("xa").alias("pa"), F.col("xb").alias("pb"), F.explode("salts").alias("salt"), F.col("conv").alias("parent_conv_id"))
    placed = nodes.join(over, ["depth", "pa", "pb", "salt"], "left").select(*NODE, "n_children", "parent_conv_id")
    found = sums.join(placed, [*NODE]).join(_ends(path), [*NODE], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """trie() of conversations as they are."""
    return trie(steps_of(turns_of(conversations, **columns)))
