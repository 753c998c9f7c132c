import heapq
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import pseudolikelihood as pl


def small_tree(*vocabulary):
    weights = np.ones(pl.VOCABULARY, np.int64)
    weights[1 + pl.CLASSES : 1 + pl.CLASSES + len(vocabulary)] = 1000
    return pl.Tree(weights), pl.Words(dict.fromkeys(vocabulary, 1000), {})


def laid(words, *texts):
    ids, lengths, _ = words.of(list(texts))
    return pl._lay(ids, lengths)


def drawn(tree):
    net = pl.Network(tree)
    net.out[:] = np.random.default_rng(3).normal(0, 0.3, net.out.shape)
    return net


def naive(net, ids):
    """Log-probabilities one position at a time, each as a walk down the tree."""
    out, padded = [], [0, 0, *ids, 0, 0]
    for t in range(2, len(padded) - 2):
        h = [*np.tanh(sum(net.embed[padded[t + o]].astype(float) * net.scale[k] for k, o in enumerate(pl.OFFSETS))), 1.0]
        start, n = net.tree.starts[padded[t]], net.tree.lengths[padded[t]]
        out.append(sum(-np.log1p(np.exp(-s * (net.out[node].astype(float) @ h))) for node, s in zip(net.tree.nodes[start : start + n], net.tree.signs[start : start + n], strict=True)))
    return out


def test_scores_equal_a_loop():
    tree, words = small_tree(b"the", b"of")
    net, texts = drawn(tree), ["the cat of the house", None, "", "of", "a b c d e f g"]
    found = np.split(net.log_probabilities(*laid(words, *texts)), np.cumsum([5, 0, 0, 1]))
    for text, got in zip(texts, found, strict=True):
        assert got.tolist() == pytest.approx(naive(net, words.of([text])[0].tolist()), abs=1e-5)


def test_scores_of_a_table_equal_a_plain_version(spark, docs, monkeypatch):
    """Everything but the training, from the texts on: counts, vocabulary, classes, tree, and each word from both sides."""
    draw, trained = np.random.default_rng(9), []
    train = pl.train

    def kept(dealt, tree):
        trained.append(train(dealt, tree))
        trained[0].out[:] = draw.normal(0, 0.3, trained[0].out.shape)
        return trained[0]

    monkeypatch.setattr(pl, "train", kept)
    texts = [" ".join(f"W{i}" for i in draw.zipf(1.3, 1500) % 40_000) + " " + " ".join(f"r{k}x{i}" for i in range(1500)) for k in range(12)] + ["w1 W2", "", None, "r1x7 never the Same  the"]
    found = {r["doc_id"]: (r["n_tokens"], r["pll"]) for r in pl.score_documents(docs(*enumerate(texts))).collect()}
    words = [(t or "").lower().encode().split() for t in texts]
    counts = Counter(w for ws in words for w in ws)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    room = pl.VOCABULARY - 1 - pl.CLASSES
    assert len(ranked) > room + 500
    own = {w: 1 + pl.CLASSES + i for i, w in enumerate(ranked[:room])}
    groups = {}
    for w in ranked[room:]:
        groups.setdefault(pl.word_class(w), []).append(w)
    weights = np.zeros(pl.VOCABULARY, np.int64)
    for w, i in own.items():
        weights[i] = counts[w]
    for c, ws in groups.items():
        weights[c] = sum(counts[w] for w in ws)
    assert (pl.Tree(weights).lengths == trained[0].tree.lengths).all()
    for k, ws in enumerate(words):
        ids = [own.get(w) or pl.word_class(w) for w in ws]
        within = sum(np.log(counts[w] / weights[pl.word_class(w)]) for w in ws if w not in own)
        assert found[k] == (len(ws), pytest.approx(sum(naive(trained[0], ids)) + within, rel=1e-5, abs=1e-6))


def test_a_tree_is_huffmans_and_its_probabilities_sum_to_one():
    weights = np.random.default_rng(1).integers(1, 1000, 300)
    tree = pl.Tree(weights)
    heap, cost = sorted(weights[1:].tolist()), 0
    while len(heap) > 1:
        joined = heapq.heappop(heap) + heapq.heappop(heap)
        cost += joined
        heapq.heappush(heap, joined)
    assert (tree.lengths * weights).sum() == cost
    net = pl.Network(tree, size=300)
    net.out[:] = np.random.default_rng(3).normal(0, 0.3, net.out.shape)
    ids = np.array([0, 0, *([7, 9, 0, 11, 13] * 299), 0, 0], np.int32)
    at = np.arange(299) * 5 + 4
    ids[at] = np.arange(1, 300)
    assert np.exp(net.log_probabilities(ids, at)).sum() == pytest.approx(1.0, abs=1e-5)


@pytest.mark.parametrize("used", [(), (5,), (1, 9), (2, 3, 8)])
def test_ids_without_weight_are_no_leaves(used):
    weights = np.zeros(10, np.int64)
    weights[list(used)] = 7
    tree = pl.Tree(weights)
    leaves = np.flatnonzero(tree.lengths).tolist()
    assert {*used} <= {*leaves} and len(leaves) == max(2, len(used) if len(used) != 1 else 3) and 0 not in leaves
    nodes, signs, place, begin = tree.way(np.array(leaves))
    assert len(nodes) == tree.lengths.sum() and nodes.max() < len(leaves) - 1 and (np.abs(signs) == 1).all() and begin[0] == 0


def test_gradient_points_down():
    tree, _ = small_tree()
    ids = np.random.default_rng(0).integers(1, pl.VOCABULARY, 400).astype(np.int32)
    at, net = np.arange(2, 398), drawn(tree)
    before, memory = net.log_probabilities(ids, at).mean(), net.memory()
    for _ in range(10):
        net.step(ids, at, memory)
    assert net.log_probabilities(ids, at).mean() > before + 0.1


def test_steps_equal_numeric_gradients():
    tree, words = small_tree(b"a", b"b", b"c")
    ids, at = laid(words, "a b c a c b zz")
    for which in range(3):
        net = drawn(tree)
        memory = [np.full(x.shape, 1e6, np.float32) for x in net.arrays()]  # so a step is the gradient, scaled
        own = net.arrays()[which]
        node = int(tree.nodes[tree.starts[ids[at[0]]]])
        place = (int(ids[at[0]]), 3) if which == 0 else (1, 3) if which == 1 else (node, 3)
        start = own[place]
        values = []
        for d in (0.01, -0.01):
            own[place] = start + d
            values.append(net.log_probabilities(ids, at).sum())
        own[place] = start
        net.step(ids, at, memory)
        assert (own[place] - start) * 1e3 / pl.RATE == pytest.approx((values[0] - values[1]) / 0.02, rel=0.05, abs=2e-2)


def test_both_sides_matter():
    tree, words = small_tree(b"x", b"y", b"l", b"r")
    scores = drawn(tree).log_probabilities(*laid(words, "l x r", "l x y"))
    assert scores[1] != scores[4]


def test_vocabulary_counts_all_texts(spark, docs):
    table = docs((1, "b b a"), (2, "A b"), (3, None), (4, "c"))
    assert pl.count_vocabulary(pl.word_counts(table.select("text")), size=3 + pl.CLASSES) == {b"b": 3, b"a": 2}


def test_training_helps_and_odd_rows_are_scored(spark, odd, docs):
    plain = docs(*[(i, "the cat sat on the mat and the dog sat on the rug " * 20) for i in range(40)], (99, "mat rug the the the sat dog cat and and on"))
    found = {r["doc_id"]: r for r in pl.score_documents(plain.withColumn("key", F.lit(1))).collect()}
    assert found[0]["mean_pll"] > -1.5 > found[99]["mean_pll"] and found[0]["n_tokens"] == 260
    rows = pl.score_documents(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert all((by_id[i]["n_tokens"], by_id[i]["pll"], by_id[i]["mean_pll"]) == (0, 0.0, None) for i in (1, 2, 3)) and by_id[7]["n_tokens"] == 60_000
    assert pl.score_documents(odd.limit(0)).count() == 0


def test_scores_do_not_depend_on_the_layout(spark, docs, words, monkeypatch):
    monkeypatch.setattr(pl, "TRAINER", 500)  # several trainers, merged in levels
    monkeypatch.setattr(pl, "FAN_IN", 3)
    texts = [" ".join(words(60 + i, i, 80)) for i in range(60)]
    table = docs(*enumerate(texts), *[(100 + i, texts[0]) for i in range(20)], (None, texts[1]))
    found = [sorted(map(tuple, pl.score_documents(t).collect()), key=repr) for t in (table.coalesce(1), table.repartition(4), table.orderBy(F.desc("doc_id")).repartition(16))]
    assert found[0] == found[1] == found[2]
    same = {r[1:] for r in found[0] if r[0] == 0 or r[0] is not None and r[0] >= 100}
    assert len(same) == 1


def test_every_position_is_a_training_target_once(monkeypatch):
    import pyarrow as pa

    tree, words = small_tree(b"a", b"b", b"c")
    ids, lengths, _ = words.of(["a b c zz a", "", "c", "b a " * 1500])
    targets, step = [], pl.Network.step
    monkeypatch.setattr(pl.Network, "step", lambda net, laid, at, memory: targets.extend(at.tolist()) or step(net, laid, at, memory))
    batch = pa.record_batch([pa.array([7]), pa.array([ids.tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary())], names=["id", "words", "lengths"])
    made = list(pl._train(pl.Network(tree).vector(), tree)(iter([batch])))
    assert targets == pl._lay(ids, lengths)[1].tolist() and len(targets) == 3006
    used = np.frombuffer(made[0]["used"][0].as_py(), np.float32)
    assert used[: pl.VOCABULARY * pl.WIDTH : pl.WIDTH].sum() == 4 * 3006  # each looks at its four neighbours


def test_a_step_equals_one_of_single_positions():
    # against sums over positions taken one by one, from the same weights: near the root and below, with gaps between positions
    tree, _ = small_tree(*[b"w%d" % i for i in range(50)])
    ids = np.random.default_rng(4).integers(1, pl.VOCABULARY, 60).astype(np.int32)
    at = np.array([2, 3, 4, 9, 20, 21, 50])
    whole, parts = drawn(tree), [drawn(tree) for _ in at]
    start = whole.vector()
    huge = lambda: [np.full(x.shape, 1e6, np.float32) for x in whole.arrays()]  # so a step is the gradient, scaled
    whole.step(ids, at, huge())
    for net, i in zip(parts, at, strict=True):
        net.step(ids, np.array([i]), huge())
    assert whole.vector() - start == pytest.approx(sum(p.vector() - start for p in parts), abs=2e-6)
    assert all((u == sum(p.used[k] for p in parts)).all() for k, u in enumerate(whole.used))


class Looked(np.ndarray):
    """A table that counts the rows taken from it."""

    rows = 0

    def take(self, at, *args, **named):
        Looked.rows += np.size(at)
        return np.asarray(self).take(at, *args, **named)


def test_scoring_looks_a_text_up_once(monkeypatch):
    # not once for each neighbour of each position
    tree, _ = small_tree()
    net, n = drawn(tree), 3 * pl._SCORED
    ids, at = np.random.default_rng(5).integers(1, pl.VOCABULARY, n + 4).astype(np.int32), np.arange(2, n + 2)
    plain = net.log_probabilities(ids, at)
    monkeypatch.setattr(Looked, "rows", 0)
    net.embed = net.embed.view(Looked)
    assert (net.log_probabilities(ids, at) == plain).all() and n <= Looked.rows <= n + 4 * 3


def test_losses_are_exact_for_sure_words():
    x = np.concatenate([np.linspace(-85, 85, 2001), [-1e4, 0, 1e4]]).astype(np.float32)
    assert pl._losses(x) == pytest.approx(np.log1p(np.exp(np.clip(-x.astype(float), -200, 80))), rel=1e-5, abs=1e-37)


def test_a_score_does_not_depend_on_its_place():
    # bit for bit: the same text anywhere among others, in whole and partly filled blocks
    tree, _ = small_tree(*[b"w%d" % i for i in range(50)])
    net, draw = drawn(tree), np.random.default_rng(6)
    text, found = draw.integers(1, pl.VOCABULARY, 37).astype(np.int32), set()
    for before in (0, 1, 2, 3, 5, 8, 13, 4000, 4090, 9001):
        others = draw.integers(1, pl.VOCABULARY, before + 11).astype(np.int32)
        ids = np.concatenate([others[:before], text, others[before:]])
        found.add(net.log_probabilities(*pl._lay(ids, np.array([before, 37, 11])))[before : before + 37].tobytes())
    assert len(found) == 1


def plain_step(net, ids, at, memory):
    """An Adagrad step with a gathered row for each decision and each neighbour."""
    around, h = [ids[at + o] for o in pl.OFFSETS], np.ones((len(at), pl.WIDTH + 1))
    h[:, :-1] = np.tanh(sum(net.embed[w].astype(float) * s for w, s in zip(around, net.scale, strict=True)))
    nodes, signs, place, _ = net.tree.way(ids[at])
    slope = -signs / (1 + np.exp(signs * (h[place] * net.out[nodes]).sum(axis=1)))
    back = np.zeros_like(h)
    np.add.at(back, place, slope[:, None] * net.out[nodes])
    moved, grads = back[:, :-1] * (1 - h[:, :-1] ** 2), [np.zeros(x.shape) for x in net.arrays()]
    for k, w in enumerate(around):
        np.add.at(grads[0], w, moved * net.scale[k])
        grads[1][k] = (moved * net.embed[w]).sum(axis=0)
    np.add.at(grads[2], nodes, slope[:, None] * h[place])
    for x, m, g in zip(net.arrays(), memory, grads, strict=True):
        m += g * g
        x -= pl.RATE * g / np.sqrt(m)


@pytest.mark.parametrize("kinds", [3, 200, pl.VOCABULARY - 1])
@pytest.mark.parametrize("vocabulary", [0, 5, 3000])
def test_steps_equal_plain_ones(kinds, vocabulary):
    # words that occur in most positions, in some and once, at many depths of the tree; several steps, the last of one position
    draw = np.random.default_rng(kinds + vocabulary)
    weights = np.ones(pl.VOCABULARY, np.int64)
    weights[1 : 1 + vocabulary] = 1_000_000 // np.arange(1, 1 + vocabulary)
    tree = pl.Tree(weights)
    ids = draw.integers(1, kinds + 1, 1205).astype(np.int32)
    at = np.flatnonzero(draw.random(1201) < 0.9) + 2
    nets, memories = [drawn(tree) for _ in range(2)], [pl.Network(tree).memory() for _ in range(2)]
    for part in (at[:500], at[500:-1], at[-1:]):
        nets[0].step(ids, part, memories[0])
        plain_step(nets[1], ids, part, memories[1])
    for a, b in zip(nets[0].arrays() + tuple(memories[0]), nets[1].arrays() + tuple(memories[1]), strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("leaves", [2, 3, 100, 128, 129, 400])
def test_trees_of_any_size_are_trained(leaves):
    weights = np.zeros(pl.VOCABULARY, np.int64)
    weights[1 : 1 + leaves] = np.arange(1, 1 + leaves)
    tree = pl.Tree(weights)
    ids, (fast, plain) = np.random.default_rng(leaves).integers(1, 1 + leaves, 300).astype(np.int32), (drawn(tree), drawn(tree))
    fast.step(ids, np.arange(2, 298), fast.memory())
    plain_step(plain, ids, np.arange(2, 298), plain.memory())
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-4) for a, b in zip(fast.arrays(), plain.arrays(), strict=True))


def test_uses_are_counted():
    tree, words = small_tree(b"a", b"b", b"c")
    (ids, at), net = laid(words, "a b c zz a a", "", "c"), pl.Network(tree)
    net.count_uses(ids, at)
    around, nodes = Counter(int(ids[t + o]) for t in at for o in pl.OFFSETS), Counter(tree.way(ids[at])[0].tolist())
    assert {i: n for i, n in enumerate(net.used[0].tolist()) if n} == around and net.used[1].tolist() == [7.0] * 4
    assert {i: n for i, n in enumerate(net.used[2].tolist()) if n} == nodes


def test_trainers_take_all_words_once(spark, docs, words, monkeypatch):
    monkeypatch.setattr(pl, "TRAINER", 300)
    table = [(i, " ".join(words(50, i))) for i in range(50)] + [(None, "alike in all")] * 900
    encoded = spark.createDataFrame([(int(i is not None) * i if i else 0, np.array([len(t)] * len(t.split()), np.int32).tobytes(), len(t.split())) for i, t in table], "h long, ids binary, n_tokens long")
    rows = pl._dealt(encoded, sum(len(t.split()) for _, t in table)).collect()
    assert len({r["id"] for r in rows}) == len(rows) and max(len(r["words"]) for r in rows) <= 4 * (2 * pl.TRAINER + 50)
    got = Counter(np.concatenate([np.frombuffer(r["words"], np.int32) for r in rows]).tolist())
    assert got == Counter(len(t) for _, t in table for _ in t.split())
    assert sum(np.frombuffer(r["lengths"], np.int64).sum() for r in rows) == sum(got.values())


def test_documents_that_occur_twice_score_higher(spark, docs, words):
    # of documents of words that nothing else holds, those that occur twice are told from those that occur once
    common = [(i, " ".join(words(100, i, 300))) for i in range(60)]
    own = {i: " ".join(f"q{i}z{j}" for j in range(40)) for i in range(500, 520)}
    table = docs(*common, *own.items(), *[(100 + i, own[i]) for i in range(500, 510)])
    found = {r["doc_id"]: r["mean_pll"] for r in pl.score_documents(table).collect()}
    assert min(found[i] for i in range(500, 510)) > max(found[i] for i in range(510, 520))


def test_words_known_grow_with_the_corpus(spark, docs, monkeypatch):
    # beyond the network's vocabulary, a counted word scores above one of its class that occurs once
    common = " ".join(f"w{i}" for i in range(pl.VOCABULARY))
    table = docs(*[(i, f"{common} {common}") for i in range(3)], *[(100 + i, "the realing") for i in range(5)], (200, "the qzxxing"))
    found = {r["doc_id"]: r["pll"] for r in pl.score_documents(table).collect()}
    assert found[100] > found[200] + 1


@pytest.mark.parametrize("most", [pl.MOST_COUNTED, 2])
def test_probabilities_within_a_class_sum_to_one(spark, docs, monkeypatch, most):
    from quern.llm.storage import scratch_path

    monkeypatch.setattr(pl, "MOST_COUNTED", most)
    table = docs(*[(i, "known alpha beta") for i in range(5)], (9, "gamma delta delta ab b"))
    counted, path = pl.word_counts(table.select("text")), scratch_path(spark, "t")
    words = pl.Words({b"known": 5}, pl.count_classes(counted, {b"known": 5}, path), path)
    sums = {}
    for w in [bytes(r["word"]) for r in counted.collect()]:
        ids, lengths, within = words.of([w.decode()])
        sums[int(ids[0])] = sums.get(int(ids[0]), 0) + np.exp(within[0])
    assert list(sums.values()) == pytest.approx([1.0] * len(sums)) and words.of(["known"])[2][0] == 0.0
