"""Hierarchical language identification: families first, then one-versus-one linear support vector machines within one.

Two families are told apart by one machine, more by one for each against the rest, so machines grow with the languages and
not with their square; within a family there is one for each pair. Machines are fitted in tasks, each on a bounded sample."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.storage import bound_batches

#: Families of closely related languages (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic",
}
UNDETERMINED = "und"
#: Labelled rows of each language that the classifiers are fitted on, at most; and against how many other families, drawn by a
#: hash, a row speaks (all, if there are no more).
SAMPLE, AGAINST = 400, 8
#: Features are a trigram's share of a text's trigrams, times this.
FEATURE_SCALE = 100.0
_CLASSES = 64
#: Trigrams are numbered up to 64 cubed and folded to so many features.
_SIZE = 1 << 16
_LETTER = regex.compile(r"\p{L}")
#: Bytes of a text that are turned into features at once.
_CHUNK = 1 << 20


def _byte_classes() -> np.ndarray:
    """A class for each byte: letters without case 1 to 26, other ASCII 0, bytes of longer characters 32 to 63."""
    table = np.zeros(256, dtype=np.uint32)
    for b in range(26):
        table[97 + b] = table[65 + b] = 1 + b
    table[128:] = 32 + np.arange(128) % 32
    return table


_TABLE = _byte_classes()


def trigrams(text: str) -> Iterator[np.ndarray]:
    """The numbers of all byte-class trigrams of the whole text, in chunks; a space stands before and after it."""
    data = b" " + text.encode("utf-8", "surrogatepass") + b" "
    for i in range(0, max(1, len(data) - 2), _CHUNK):
        c = _TABLE[np.frombuffer(data[i : i + _CHUNK + 2], dtype=np.uint8)]
        yield ((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]) * np.uint32(2654435761) >> np.uint32(16)


@dataclass
class Duel:
    """A linear SVM: positive values speak for the first label, others for the second, or against the first if there is none."""

    first: str
    second: str | None
    weights: np.ndarray
    bias: float


@dataclass
class Hierarchy:
    families: dict[str, list[str]] = field(default_factory=dict)
    between: list[Duel] = field(default_factory=list)
    within: dict[str, list[Duel]] = field(default_factory=dict)

    def duels(self) -> list[Duel]:
        return self.between + [d for f in sorted(self.within) for d in self.within[f]]


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, epochs: int = 12, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear SVM (hinge loss, averaged sub-gradient steps in a fixed order) over sparse rows (positions, values)."""
    w, total, bias, bias_total, steps = np.zeros(_SIZE, np.float64), np.zeros(_SIZE, np.float64), 0.0, 0.0, 0
    order = np.random.default_rng(7)
    weight = {s: len(signs) / (2 * max(1, int((signs == s).sum()))) for s in (1, -1)}  # both classes count alike
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            steps += 1
            rate = 1.0 / (1.0 + reg * steps)
            if signs[i] * (w[at] @ x + bias) < 1:
                move = rate * signs[i] * weight[signs[i]]
                w[at] += move * x
                total[at] += move * x * steps
                bias += move * 0.1
                bias_total += move * 0.1 * steps
    w, bias = w - total / (steps + 1), bias - bias_total / (steps + 1)
    usual = float(np.median([abs(w[at] @ x + bias) for at, x in rows])) or 1.0  # so a usual row has a margin of 1
    return (w / usual).astype(np.float32), bias / usual


def machines_of(lang: str, draw: str, families: Mapping[str, list[str]]) -> list[tuple[str, str, str, int]]:
    """The machines that a row of a language helps to fit: kind (`between`, `within`), both labels, and the side it is on."""
    family, names = next(f for f, langs in families.items() if lang in langs), sorted(families)
    out = [("within", *sorted((lang, other)), 1 if lang < other else -1) for other in families[family] if other != lang]
    if len(names) == 2:
        return [*out, ("between", names[0], names[1], 1 if family == names[0] else -1)]
    others = [f for f in names if f != family]
    if len(others) > AGAINST:
        others = sorted({others[xxhash.xxh64_intdigest(f"{draw}|{i}") % len(others)] for i in range(AGAINST)})
    return [*out, *([("between", family, "", 1)] if others else []), *[("between", f, "", -1) for f in others]]


def assembled(families: Mapping[str, list[str]], found: list[tuple[str, str, str, np.ndarray, float]]) -> Hierarchy:
    """The hierarchy of fitted machines (kind, labels, weights, bias)."""
    out = Hierarchy({f: sorted(langs) for f, langs in sorted(families.items())})
    for kind, first, second, weights, bias in sorted(found, key=lambda m: m[:3]):
        if kind == "between":
            out.between.append(Duel(first, second or None, weights, bias))
        else:
            out.within.setdefault(next(f for f, langs in families.items() if first in langs), []).append(Duel(first, second, weights, bias))
    return out


def decide(labels: list[str], duels: list[Duel], values: Mapping[tuple[str, str | None], float]) -> tuple[str, float]:
    """The label with the most won duels (ties: the larger sum of margins, then the first name) and the mean probability of
    its duels, of which a margin of 1 counts 0.95. A machine against the rest is a duel that nobody wins by losing it."""
    if len(labels) == 1 or not duels:
        return min(labels), 1.0 if len(labels) == 1 else 1.0 / len(labels)
    wins, sums, own = dict.fromkeys(labels, 0), dict.fromkeys(labels, 0.0), {x: [] for x in labels}
    for d in duels:
        v = values[d.first, d.second]
        for label, side in ((d.first, v), (d.second, -v)):
            if label is not None:
                wins[label] += side > 0
                sums[label] += side
                own[label].append(side)
    best = max(sorted(labels), key=lambda x: (wins[x], sums[x]))
    return best, float(np.mean([1 / (1 + np.exp(-3 * np.clip(v, -20, 20))) for v in own[best]])) if own[best] else 0.5


def predict(model: Hierarchy, text: str | None, weights: np.ndarray) -> tuple[str, float]:
    """Language and score of a whole text. `weights` are the duels' weight vectors as columns."""
    if text is None or not model.families or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    duels = model.duels()
    sums, n = np.zeros(len(duels)), 0
    for ids in trigrams(text):
        if len(ids):
            sums += weights[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
    values = {(d.first, d.second): FEATURE_SCALE * s / max(1, n) + d.bias for d, s in zip(duels, sums, strict=True)}
    family, sure = decide(list(model.families), model.between, values)
    langs = model.families[family]
    lang, surer = decide(langs, model.within.get(family, []), values)
    return lang, min(1.0, sure * surer)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a whole text's features."""
    ids, counts = np.unique(np.concatenate(list(trigrams(text))), return_counts=True)
    return ids.astype(np.int32), (FEATURE_SCALE * counts / max(1, counts.sum())).astype(np.float32)


def _sample_rows(families: Mapping[str, list[str]]):
    """Each row's features, for each machine that it helps to fit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lang, text, draw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at, values = (x.tobytes() for x in features(text))
                made += [(*machine, draw, at, values) for machine in machines_of(lang, draw, families)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["kind", "first", "second", "side", "draw", "at", "vals"])

    return rows


_SAMPLED = "kind string, first string, second string, side long, draw string, at binary, vals binary"
_FITTED = "kind string, first string, second string, at binary, vals binary, bias double"


def _fit_machine(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("side", "draw", "at", "vals")), strict=True))
    weights, bias = fit_svm([(np.frombuffer(at, np.int32), np.frombuffer(v, np.float32)) for _, _, at, v in rows], np.array([r[0] for r in rows]))
    at = np.flatnonzero(weights).astype(np.int32)
    names = [table[c][0].as_py() for c in ("kind", "first", "second")]
    arrays = [*[pa.array([x]) for x in names], pa.array([at.tobytes()], pa.binary()), pa.array([weights[at].tobytes()], pa.binary()), pa.array([float(bias)])]
    return pa.Table.from_arrays(arrays, names=["kind", "first", "second", "at", "vals", "bias"])


def train(labelled: DataFrame, sample: int = SAMPLE, families: Mapping[str, str] = FAMILIES, lang: str = "lang", text: str = "text", order: Column | None = None) -> Hierarchy:
    """Fit on the `sample` distinct texts of each language (null labels and texts without letters left out) whose hash `order`
    is smallest, so copies weigh nothing and the order of rows does not matter. A threshold on the hash, from counts of
    distinct hashes for each language, keeps all other rows out of the shuffle, and equal rows are combined before it. A
    table without such rows gives a model that knows no language. Any number of languages is learned; the model (up to half a
    megabyte for a machine), and what the driver holds, grow with them and their relatives, not with the rows."""
    bound_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (order if order is not None else F.md5(F.col(text))).alias("draw"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()  # one for each language
    if not counts:
        return Hierarchy()
    tree: dict[str, list[str]] = {}
    for r in sorted(counts, key=lambda r: r["lang"]):
        tree.setdefault(families.get(r["lang"], r["lang"]), []).append(r["lang"])
    # the first eight hexadecimal digits of the hash as a share of all; twice the sample and some more are let through
    share = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    most = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * sample + 100) / r["n"])) for r in counts], "lang string, most double")
    few = rows.join(F.broadcast(most), "lang").filter(share < F.col("most")).groupBy("lang", "draw").agg(F.min("text").alias("text"))  # one row for each language
    first = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("place") <= sample)
    sampled = first.select("lang", "text", "draw").mapInArrow(_sample_rows(tree), _SAMPLED)
    fitted = sampled.groupBy("kind", "first", "second").applyInArrow(_fit_machine, _FITTED).collect()  # one for each machine
    found = []
    for r in fitted:
        weights = np.zeros(_SIZE, np.float32)
        weights[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["vals"], np.float32)
        found.append((r["kind"], r["first"], r["second"], weights, r["bias"]))
    return assembled(tree, found)


def identify(docs: DataFrame, model: Hierarchy, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1); `und` and 0 for a null text, one without a letter, or a model that has
    learned no language. Whole texts are read. Empty input gives an empty result; input columns of those names are
    replaced. No shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    duels = model.duels()
    weights = np.stack([d.weights for d in duels], axis=1) if duels else np.zeros((_SIZE, 0), np.float32)
    bare = Hierarchy(model.families, [Duel(d.first, d.second, np.zeros(0), d.bias) for d in model.between], {f: [Duel(d.first, d.second, np.zeros(0), d.bias) for d in ds] for f, ds in model.within.items()})
    shared = spark.sparkContext.broadcast((bare, weights))  # a quarter of a megabyte for each machine
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hierarchy, columns = shared.value
        for batch in batches:
            found = [predict(hierarchy, t, columns) for t in batch.column(at).to_pylist()]
            arrays = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(rows, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the key's text is divisible by 5 (a null key: not held out, nor learned from)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0, F.lit(False))
