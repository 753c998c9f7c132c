"""Document scores by masked pseudo-likelihood under a bidirectional window network trained in numpy.

Every word is predicted from the two words on either side of it: a position's context vector is the tanh of the sum of its
neighbours' embeddings, each scaled by weights of its offset, and a Huffman tree over the vocabulary gives the masked word's
probability as a product of decisions, one at each node on the way to the word (a hierarchical softmax). The vocabulary is
counted over all documents. Words outside it are in classes by their endings, which are leaves of the tree, too; a word of
a class has besides its probability within the class, counted over all documents, so the words known grow with the corpus.

The network is trained on all positions of all documents, each masked in its turn. Documents are dealt by a hash to trainers of a fixed number of
words and put in the hash's order, so results don't depend on how the table is laid out. All trainers of a round begin with
the same weights; of what they make, each row of weights is averaged by how often it was used, in levels of bounded fan-in."""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.simhash import ascii_words
from quern.llm.storage import bound_batches, discard, few_rows, materialise, open_fs, scratch_path

#: Size of the vocabulary: the boundary, classes of other words by their endings, and the most frequent words.
VOCABULARY, CLASSES = 16_384, 1_023
#: Words of a class that occur so often have a probability of their own within it; the rest of the class share theirs evenly.
#: From two on, all words have their own. Only where more than MOST_COUNTED words (16 bytes each in a worker) occur so often,
#: the count is doubled until no more do.
MIN_COUNT, MOST_COUNTED = 2, 1 << 24
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
RATE = 0.15
#: Nodes next to the root that training takes as one matrix: most decisions are at these. One less than a power of two.
TOP = 127
#: Words of a trainer.
TRAINER = 2_000_000
_BATCH = 1024
_SCORED = 4096
#: Distinct words that a task holds while it counts, and words that a worker keeps.
MAX_HELD = 400_000
#: Trainers whose weights are averaged in one group.
FAN_IN = 16


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(ascii_words(text or ""))
            if len(counts) > MAX_HELD:
                yield flush()
    if counts:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts."""
    return texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def at_least(counted: DataFrame, counts: list[int]) -> list[int]:
    """How many of the words counted occur so often, for each of `counts`."""
    return list(counted.agg(*[F.count(F.when(F.col("n") >= c, 1)) for c in counts]).first())


def count_vocabulary(counted: DataFrame, size: int = VOCABULARY, classes: int = CLASSES) -> dict[bytes, int]:
    """The most frequent of the words counted (ties by their bytes), as many as the vocabulary has room for, and their counts.
    Words rarer than a power of two that enough words reach are left out first, so no task sends its own most frequent ones."""
    room, powers = size - 1 - classes, [1 << i for i in range(60)]
    least = max([c for c, n in zip(powers, at_least(counted, powers), strict=True) if n >= room], default=1)
    frequent = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(room)
    return {bytes(r["word"]): r["n"] for r in frequent.collect()}


def word_class(word: bytes, classes: int = CLASSES) -> int:
    return 1 + zlib.crc32(word[-3:]) % classes


def count_classes(counted: DataFrame, vocabulary: dict[bytes, int], path: str) -> dict[int, tuple[int, int, int]]:
    """Writes (h, n), hash and count of each word outside `vocabulary` with MIN_COUNT or more, to `path`. Returns, for each
    class, all its words' occurrences, those of words that are rarer, and how many such words there are."""
    ending = F.when(F.length("word") > 3, F.expr("substring(word, length(word) - 2, 3)")).otherwise(F.col("word"))
    tail = counted.join(F.broadcast(counted.sparkSession.createDataFrame([(w,) for w in vocabulary], "word binary")), "word", "left_anti")
    tail = tail.withColumn("class", (F.crc32(ending) % CLASSES + 1).cast("int"))
    steps = [MIN_COUNT << i for i in range(50)]
    least = next(c for c, n in zip(steps, at_least(counted, steps), strict=True) if n <= MOST_COUNTED)
    tail.filter(F.col("n") >= least).select(F.xxhash64("word").alias("h"), "n").write.parquet(path)
    rare = F.col("n") < least
    sums = tail.groupBy("class").agg(F.sum("n").alias("n"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("r"), F.count(F.when(rare, 1)).alias("k"))
    return {r["class"]: (r["n"], r["r"], r["k"]) for r in sums.collect()}  # CLASSES at most


class Words(dict):
    """A number for each word met, and by that number its id in the vocabulary (0 is the boundary, a word outside it has the id
    of its class) and its log-probability within its class (0 in the vocabulary). The counts of other words are read from the
    shared folder as two sorted arrays, 16 bytes for each word."""

    def __init__(self, vocabulary: dict[bytes, int], sums: dict[int, tuple[int, int, int]], path: str | None = None):
        super().__init__()
        self.own, self.sums = {w: 1 + CLASSES + i for i, w in enumerate(vocabulary)}, np.ones((3, 1 + CLASSES), np.int64)
        for c, three in sums.items():
            self.sums[:, c] = three
        self.hashes = self.counts = np.zeros(0, np.int64)
        if path is not None:
            fs, root = open_fs(path)
            table = pq.read_table(root, filesystem=fs)
            order = np.argsort(table["h"].to_numpy(), kind="stable")
            self.hashes, self.counts = table["h"].to_numpy()[order], table["n"].to_numpy()[order]
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.ids, self.within = np.zeros(1 << 16, np.int32), np.zeros(1 << 16)

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.fresh.append(word)
        return found

    def _learn(self) -> None:
        while len(self) > len(self.ids):
            self.ids, self.within = np.concatenate([self.ids, self.ids]), np.concatenate([self.within, self.within])
        start = len(self) - len(self.fresh)
        ids = np.fromiter(map(self.own.get, self.fresh, itertools.repeat(0)), np.int32, len(self.fresh))
        self.within[start : len(self)] = 0.0
        outside = np.flatnonzero(ids == 0)
        if len(outside):
            words = [self.fresh[i] for i in outside.tolist()]
            ids[outside] = classes = np.fromiter(map(word_class, words), np.int32, len(words))
            total, rare, kinds = self.sums.take(classes, axis=1)
            counts = self._counted(words)
            self.within[start + outside] = np.log(np.where(counts > 0, counts, np.maximum(rare, 1) / np.maximum(kinds, 1)) / total)
        self.ids[start : len(self)] = ids
        self.fresh = []

    def _counted(self, words: list[bytes]) -> np.ndarray:
        """The words' counts, 0 for one without its own."""
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts' words one after another, each text's number of words, and the sum of its words' log-probabilities
        within their classes."""
        if len(self) > MAX_HELD:
            self._empty()
        split = [ascii_words(t or "") for t in texts]
        lengths = np.array([len(words) for words in split], np.int64)
        numbers = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(lengths.sum()))
        self._learn()
        return self.ids.take(numbers), lengths, np.bincount(np.repeat(np.arange(len(lengths)), lengths), self.within.take(numbers), len(lengths)).astype(np.float64)


def _short(most: int) -> type:
    """Tables of small numbers stay in a processor's cache."""
    return np.int16 if most < 1 << 15 else np.int32


class Levels:
    """Ways of the tree, or their beginnings, level by level: of ids put in the order of their numbers of nodes, most first, those
    that have a node of some level are a beginning of them. So work on a level needs no look-up of an id's own row."""

    def __init__(self, tree: Tree, starts: np.ndarray, lengths: np.ndarray):
        self.lengths, self.most = lengths.astype(np.int16), int(lengths.max())
        nodes, signs, place, begin = tree._parts(starts, lengths)
        level = np.arange(len(place)) - begin[place]
        self.signed = np.zeros((len(lengths), self.most), _short(len(nodes) and int(nodes.max()) + 1))
        self.signed[place, level] = (nodes + 1) * signs

    def order(self, ids: np.ndarray) -> np.ndarray:
        return np.argsort(self.most - self.lengths.take(ids), kind="stable")

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Nodes and signs on the ways of ids in that order, level by level, and for each level how many ids have it and where it is."""
        many = len(ids) - np.cumsum(np.bincount(self.lengths.take(ids), minlength=self.most + 1))[: self.most]
        ends = np.cumsum(many).tolist()
        levels = [(n, slice(end - n, end)) for n, end in zip(many.tolist(), ends, strict=True) if n]
        first = ids.astype(np.int64) * self.most
        at = np.concatenate([first[:n] + k for k, (n, _) in enumerate(levels)]) if levels else first[:0]
        signed = self.signed.ravel().take(at)
        return np.abs(signed) - 1, np.sign(signed).astype(np.float32), levels


class Tree:
    """The way from the root of a Huffman tree to each id: node numbers and signs, one after another."""

    def __init__(self, weights: np.ndarray):
        """`weights` by id; ids without weight are no leaves, nor is id 0, the boundary."""
        used = np.flatnonzero(weights[1:]) + 1
        if len(used) < 2:  # a tree has two leaves at least
            used = np.unique(np.concatenate([used, [1, 2]]))
        n = len(used)
        heap = [(max(1, int(w)), i) for i, w in enumerate(weights[used].tolist())]
        heapq.heapify(heap)
        parent, sign = np.zeros(2 * n - 1, np.int64), np.ones(2 * n - 1, np.int64)
        for new in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            sign[j] = -1
            heapq.heappush(heap, (a + b, new))
        at, steps = np.arange(n), []  # from the leaves up, all at once
        root = 2 * n - 2
        while (at != root).any():
            steps.append((np.where(at != root, parent[at] - n, -1), np.where(at != root, sign[at], 0)))
            at = np.where(at != root, parent[at], root)
        nodes, signs = (np.stack([s[k] for s in steps], axis=1) for k in (0, 1))
        self.lengths, self.starts = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
        self.lengths[used] = (signs != 0).sum(axis=1)
        self.starts[used] = np.cumsum(self.lengths[used]) - self.lengths[used]
        self.nodes, self.signs = nodes[signs != 0].astype(np.int32), signs[signs != 0].astype(np.float32)
        self.cut = max(0, n - 1 - TOP)  # numbers grow towards the root, so a way's nodes below the cut come first
        deep = np.zeros(len(weights), np.int64)
        deep[used] = ((signs != 0) & (nodes < self.cut)).sum(axis=1)
        self.whole, self.below = Levels(self, self.starts, self.lengths), Levels(self, self.starts, deep)
        # nodes from the cut on, numbered from it and 1, times their signs, as a table; a shorter way is filled up with 0
        found, signs, place, begin = self._parts(self.starts + deep, self.lengths - deep)
        self.tops = np.zeros((len(weights), int((self.lengths - deep).max())), np.int16)
        self.tops[place, np.arange(len(place)) - begin[place]] = (found - self.cut + 1) * signs

    def _parts(self, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        begin = np.cumsum(lengths) - lengths
        place = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(place)) + (starts - begin).take(place)
        return self.nodes.take(at), self.signs.take(at), place, begin

    def way(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and signs on the way to each id, the place of that id, and where each way begins."""
        return self._parts(self.starts[ids], self.lengths[ids])


def _begins(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


#: Rows that occur so often are summed as runs, others in turns: first all first ones, then all second ones, and so on.
_TURNS = 48


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in `rows` and the sums of their `values`."""
    order = np.argsort(rows.astype(np.int16) if VOCABULARY <= 1 << 15 else rows, kind="stable")  # short numbers sort by counting
    ordered = rows.take(order)
    begin = _begins(ordered)
    counts = np.full(len(begin), len(rows))
    counts[:-1] = begin[1:]
    counts -= begin
    if counts.max() > _TURNS:
        return ordered.take(begin), np.add.reduceat(_pairs(values.take(order, axis=0)), begin, axis=0).view(np.float32)
    frequent = np.argsort(_TURNS - counts.astype(np.int16), kind="stable")
    begin = begin.take(frequent)
    many = len(begin) - np.cumsum(np.bincount(counts))  # so many occur more than 0, 1, 2... times
    sums = values.take(order.take(begin), axis=0)
    for k, n in enumerate(many[1:-1].tolist(), 1):
        sums[:n] += values.take(order.take(begin[:n] + k), axis=0)
    return ordered.take(begin), sums


def _pairs(x: np.ndarray) -> np.ndarray:
    """Pairs of a row's numbers as complex ones, of which a sum takes half the steps."""
    return x.view(np.complex64) if x.shape[1] % 2 == 0 else x


def _rows(x: np.ndarray) -> np.ndarray:
    """A table's rows as single values, which are stored faster than rows."""
    return x.view(f"V{x.shape[1] * x.itemsize}").ravel()


def _with_constant(x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1] = x
    return out


def _losses(x: np.ndarray) -> np.ndarray:
    """log(1 + exp(-x)), exact for small values, too (as log1p, in fewer steps): what is lost by adding 1 is added to the logarithm."""
    small = np.exp(np.minimum(-x, 80))
    whole = 1 + small
    return np.log(whole) + (small - (whole - 1)) / whole


def _slopes(signs: np.ndarray, logits: np.ndarray) -> np.ndarray:
    """Derivatives of the losses of signs * logits by the logits."""
    return -signs / (1 + np.exp(np.minimum(signs * logits, 80)))


class Network:
    """Embeddings, their scales for each offset, and weights of the tree's nodes (the last column goes with a constant)."""

    def __init__(self, tree: Tree, size: int = VOCABULARY, width: int = WIDTH, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.tree = tree
        self.embed = draw.normal(0, 0.5, (size, width)).astype(np.float32)
        self.scale = draw.normal(0.7, 0.3, (len(OFFSETS), width)).astype(np.float32)
        self.out = np.zeros((size, width + 1), np.float32)
        self.used = [np.zeros(len(x), np.float64) for x in self.arrays()]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.embed, self.scale, self.out

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def load(self, vector: np.ndarray) -> Network:
        for x, part in zip(self.arrays(), np.split(vector, np.cumsum([x.size for x in self.arrays()])[:-1]), strict=True):
            x[:] = part.reshape(x.shape)
        return self

    def contexts(self, stretch: np.ndarray) -> tuple[np.ndarray, list[slice], np.ndarray]:
        """Embeddings of a stretch of ids, a column each; where the neighbours of its inner positions are, for each offset; the
        context vectors of those, a row each. The stretch is looked up once, and neighbours are that stretch, shifted."""
        reach = max(OFFSETS)
        n = len(stretch) - 2 * reach
        seen, around = np.ascontiguousarray(self.embed.take(stretch, axis=0).T), [slice(reach + o, reach + o + n) for o in OFFSETS]
        total = seen[:, around[0]] * self.scale[0][:, None]
        for k, w in enumerate(around[1:], 1):
            total += seen[:, w] * self.scale[k][:, None]
        return seen, around, np.ascontiguousarray(np.tanh(total, out=total).T)

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the word at each position (ascending), given its neighbours. No number depends on what else is scored
        with it."""
        reach, out = max(OFFSETS), np.empty(len(at), np.float64)
        for i in range(0, len(at), _SCORED):
            part = at[i : i + _SCORED]
            order = self.tree.whole.order(ids.take(part))
            h = _with_constant(self.contexts(ids[part[0] - reach : part[-1] + reach + 1])[2].take((part - part[0]).take(order), axis=0))
            nodes, signs, levels = self.tree.whole.of(ids.take(part.take(order)))
            logits, sums = np.empty(len(nodes), np.float32), np.zeros(len(part))
            for n, where in levels:
                np.einsum("ij,ij->i", h[:n], self.out.take(nodes[where], axis=0), out=logits[where])
            losses = _losses(signs * logits)
            for n, where in levels:
                sums[:n] -= losses[where]
            out[i + order] = sums
        return out

    def step(self, ids: np.ndarray, at: np.ndarray, memory: list[np.ndarray]) -> None:
        """One Adagrad step on the positions `at`, which ascend."""
        tree, reach = self.tree, max(OFFSETS)
        stretch, at = ids[at[0] - reach : at[-1] + reach + 1], at - at[0]
        words = stretch[reach:-reach].take(at)
        order = tree.below.order(words)
        at, words = at.take(order), words.take(order)
        seen, around, found = self.contexts(stretch)
        own = found.take(at, axis=0)
        h = _with_constant(own)
        # decisions near the root: a matrix of positions and nodes, whose first column takes what fills shorter ways
        top = self.out[tree.cut : tree.cut + TOP]
        crown = np.zeros((TOP + 1, h.shape[1]), np.float32)
        crown[1 : 1 + len(top)] = top
        signed = tree.tops.take(words, axis=0)
        cell = (np.abs(signed) + np.arange(0, len(at) * len(crown), len(crown))[:, None]).ravel()
        slopes = np.zeros(len(at) * len(crown), np.float32)
        slopes[cell] = _slopes(np.sign(signed).astype(np.float32).ravel(), (h @ crown.T).ravel().take(cell))
        slopes = slopes.reshape(len(at), len(crown))
        back = slopes @ crown
        self._move(2, slice(tree.cut, tree.cut + len(top)), (slopes.T @ h)[1 : 1 + len(top)], memory)
        # those below
        nodes, signs, levels = tree.below.of(words)
        if levels:
            weights, logits = self.out.take(nodes, axis=0), np.empty(len(nodes), np.float32)
            for m, where in levels:
                np.einsum("ij,ij->i", h[:m], weights[where], out=logits[where])
            slope = _slopes(signs, logits)[:, None]
            weights *= slope
            for m, where in levels:
                back[:m] += weights[where]
                np.multiply(h[:m], slope[where], out=weights[where])
            self._move(2, *_summed(nodes, weights), memory)
        moved = np.zeros_like(found)
        moved[at] = back[:, :-1] * (1 - own * own)
        moved = np.ascontiguousarray(moved.T)
        moves, scaled = np.zeros_like(seen), np.empty_like(self.scale)
        for k, w in enumerate(around):
            moves[:, w] += moved * self.scale[k][:, None]
            scaled[k] = np.einsum("ij,ij->i", moved, seen[:, w])
        self._move(0, *_summed(stretch, np.ascontiguousarray(moves.T)), memory)
        self._move(1, slice(None), scaled, memory)

    def _move(self, which: int, rows: np.ndarray | slice, g: np.ndarray, memory: list[np.ndarray]) -> None:
        """Rows (distinct) of one of the arrays against their gradient. One that is zero moves nothing."""
        x, m = self.arrays()[which], memory[which]
        if isinstance(rows, slice):
            m[rows] += g * g
            x[rows] -= RATE * g / np.sqrt(m[rows])
            return
        grown = g * g
        grown += m.take(rows, axis=0)
        _rows(m)[rows] = _rows(grown)
        np.sqrt(grown, out=grown)
        np.divide(g, grown, out=grown)
        grown *= -RATE
        grown += x.take(rows, axis=0)
        _rows(x)[rows] = _rows(grown)

    def count_uses(self, ids: np.ndarray, at: np.ndarray) -> None:
        """Adds to `used` how often steps on the positions `at` use each row."""
        for o in OFFSETS:
            self.used[0] += np.bincount(ids.take(at + o), minlength=len(self.embed))
        self.used[1] += len(at)
        times = np.bincount(ids.take(at), minlength=len(self.tree.lengths))
        nodes, _, place, _ = self.tree.way(np.flatnonzero(times))
        self.used[2] += np.bincount(nodes, times[times > 0].take(place), len(self.out))

    def memory(self) -> list[np.ndarray]:
        return [np.full(x.shape, 0.1, np.float32) for x in self.arrays()]


def _lay(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with two boundaries before, between and after them, and the positions of words."""
    before = 2 * (1 + np.arange(len(lengths)))
    at = np.arange(len(ids)) + np.repeat(before, lengths)
    laid = np.zeros(len(ids) + 2 * len(lengths) + 2, np.int32)
    laid[at] = ids
    return laid, at


def _train(vector: np.ndarray, tree: Tree):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, words, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                net, lengths = Network(tree).load(vector), np.frombuffer(lengths, np.int64)
                ids, at = _lay(np.frombuffer(words, np.int32), lengths)
                memory = net.memory()
                for i in range(0, len(at), _BATCH):
                    net.step(ids, at[i : i + _BATCH], memory)
                if len(at):
                    net.count_uses(ids, at)
                    yield _weights(id_, [np.repeat(u, x.shape[1]) for u, x in zip(net.used, net.arrays(), strict=True)], net.vector())

    return rows


_WEIGHTS = "id long, used binary, vector binary"


def _weights(id_: int, used: list[np.ndarray], vector: np.ndarray) -> pa.RecordBatch:
    counts = np.concatenate(used).astype(np.float32)
    arrays = [pa.array([id_], pa.int64()), pa.array([counts.tobytes()], pa.binary()), pa.array([vector.astype(np.float32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "used", "vector"])


def _merge(table: pa.Table) -> pa.Table:
    """The average of the group's vectors, each number by how often it was used; one that nobody used is the same in all."""
    ids, used, vectors = (table[c].to_pylist() for c in ("id", "used", "vector"))
    total, uses, plain = 0.0, 0.0, None
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        n, vector = np.frombuffer(used[i], np.float32).astype(np.float64), np.frombuffer(vectors[i], np.float32)
        total, uses, plain = total + n * vector, uses + n, vector if plain is None else plain
    vector = np.where(uses > 0, total / np.maximum(uses, 1), plain)
    return pa.Table.from_batches([_weights(ids[0] // FAN_IN, [uses], vector)])


#: The table of the corpus that a worker process works on, by its path: read and sorted once for all its tasks.
_KNOWN: dict[str, Words] = {}


def words_at(path: str, known: tuple) -> Words:
    if path not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[path] = Words(*known, path)
    return _KNOWN[path]


def train(dealt: DataFrame, tree: Tree) -> Network:
    """Train on all trainers' documents (id, words, lengths): every position of each, at every size of the corpus."""
    net, spark = Network(tree), dealt.sparkSession
    start = spark.sparkContext.broadcast(net.vector())  # of a fixed size
    with few_rows(spark):
        parts = materialise(dealt.mapInArrow(lambda b, start=start: _train(start.value, tree)(b), _WEIGHTS), "weights")
        while parts.count() > 1:
            before, parts = parts, materialise(parts.groupBy(F.floor(F.col("id") / FAN_IN)).applyInArrow(_merge, _WEIGHTS), "weights")
            discard(before)
    for r in parts.collect():  # one
        net.load(np.frombuffer(r["vector"], np.float32))
    discard(parts)
    return net


def _dealt(encoded: DataFrame, words: int) -> DataFrame:
    """(id, words, lengths): documents dealt to trainers by their hash and put in its order. A trainer to which more come than
    it takes (rows alike in key and text) is cut into several."""
    n = -(-words // TRAINER) or 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, lengths, total, more = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([part + n * more], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([np.array(lengths, np.int64).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "words", "lengths"])

        for batch in batches:
            for ids in batch.column(0).to_pylist():
                held.append(ids)
                lengths.append(len(ids) // 4)
                total += len(ids) // 4
                if total >= 2 * TRAINER:
                    yield flush()
                    held, lengths, total, more = [], [], 0, more + 1
        if held:
            yield flush()

    dealt = encoded.filter("n_tokens > 0").select("ids", "h").repartitionById(n, F.pmod("h", F.lit(n)).cast("int")).sortWithinPartitions("h").select("ids")
    return materialise(dealt.mapInArrow(rows, "id long, words binary, lengths binary"), "trainers")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, pll, mean_pll) for each row: the summed log-probability (natural) of all its words, each from both
    sides, under a network trained on all rows, and the mean. A null text or one without words has 0, 0.0 and null. Rows that
    repeat each give a row; an empty table gives an empty result; other columns are not read. Scores are the same however the
    table is partitioned or ordered, and equal texts have equal scores.

    Words are runs without white space, A to Z in lower case. A word outside the vocabulary has the probability of its class
    times its own within the class. Texts are read twice (count, encode); ids of words are shuffled once to the trainers, and
    the rest works on ids. Counts of words reach the workers by the shared folder."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    counted = materialise(word_counts(rows.select("text")), "words")
    vocabulary, path = count_vocabulary(counted), scratch_path(spark, "classes")
    sums = count_classes(counted, vocabulary, path)
    total = counted.agg(F.sum("n")).first()[0] or 0
    weights = np.zeros(VOCABULARY, np.int64)
    for c, (n, _, _) in sums.items():
        weights[c] = n
    weights[1 + CLASSES : 1 + CLASSES + len(vocabulary)] = list(vocabulary.values())
    tree = Tree(weights)
    known = spark.sparkContext.broadcast((vocabulary, sums))  # of a fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_at(path, known.value)
        for batch in batches:
            ids, lengths, within = words.of(batch.column(2).to_pylist())
            ends = np.cumsum(lengths)
            cut = [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            arrays = [batch.column(0), batch.column(1), pa.array(cut, pa.binary()), pa.array(lengths), pa.array(within)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "h", "ids", "n_tokens", "within"])

    kind = rows.schema["key"].dataType.simpleString()
    hashed = rows.select("key", F.xxhash64("text", F.col("key").cast("string")).alias("h"), "text")
    encoded = materialise(hashed.mapInArrow(encode, f"key {kind}, h long, ids binary, n_tokens long, within double"), "encoded")
    dealt = _dealt(encoded, total)
    shared = spark.sparkContext.broadcast((train(dealt, tree).vector(), tree))  # of a fixed size
    discard(dealt, counted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, own = shared.value
        net = Network(own).load(vector)
        for batch in batches:
            lengths, within = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ids, at = _lay(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32), lengths)
            sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), net.log_probabilities(ids, at), len(lengths)) + within
            means = pa.array(sums / np.maximum(lengths, 1), mask=lengths == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sums), means], names=["key", "n_tokens", "pll", "mean_pll"])

    scored = encoded.select("key", "ids", "n_tokens", "within").mapInArrow(score, f"key {kind}, n_tokens long, pll double, mean_pll double")
    return scored.withColumnRenamed("key", key)
