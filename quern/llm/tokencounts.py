"""Token counts of whole texts under a unigram model, by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import bound_batches

#: Mark of a pre-token's start in the vocabulary file.
START = "▁"
#: Scores are integers of so many units for a natural logarithm, so sums are exact and ties are real.
UNITS = 1_000_000
#: Zipf-Mandelbrot shift of the ranks.
SHIFT = 2.7
#: Trie nodes and terminal counts kept in a worker; each starts anew beyond its bound.
MAX_NODES, MAX_TERMINALS = 300_000, 400_000


def load_scores(path: str) -> dict[str, int]:
    """Scaled log-probability of each ordinary piece of a sentencepiece vocabulary. The file ranks its pieces but has no
    probabilities, so they follow the Zipf-Mandelbrot law of the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.fsum(1 / (r + 1 + SHIFT) for r in range(len(ids)))
    return {model.id_to_piece(i): round(UNITS * -math.log((r + 1 + SHIFT) * total)) for r, i in enumerate(ids)}


class PrefixTrie:
    """The distinct pre-tokens seen, in a trie. A node holds the best score and token count of its prefix, computed once
    when the node is made; a pre-token's count is that of its last node.

    Best: the highest sum of piece scores, then the fewest tokens. A character that is no piece by itself may stand as its
    UTF-8 bytes, one token each, at a score below every piece's."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.endings = {p[i:] for p in scores for i in range(len(p))}
        self.unknown = min(scores.values(), default=0) - 10 * UNITS
        self.terminals: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0], [0]

    def count(self, word: str) -> int:
        """Tokens of a pre-token (without its start mark)."""
        found = self.terminals.get(word)
        if found is None:
            if len(self.best) > MAX_NODES:
                self.clear()
            if len(self.terminals) > MAX_TERMINALS:
                self.terminals.clear()
            found = self.terminals[word] = self._insert(START + word)
        return found

    def _insert(self, token: str) -> int:
        node, path, children, best, tokens = 0, [0], self.children, self.best, self.tokens
        scores, endings = self.scores, self.endings
        for j, char in enumerate(token, 1):
            nxt = children.get((node, char))
            if nxt is None:
                value, fewest = None, 0
                if char not in scores:
                    value = best[node] + self.unknown
                    fewest = tokens[node] + len(char.encode("utf-8", "surrogatepass"))
                for i in range(j - 1, -1, -1):
                    piece = token[i:j]
                    if piece not in endings:
                        break
                    score = scores.get(piece)
                    if score is not None:
                        before = path[i]
                        score += best[before]
                        if value is None or score > value or score == value and tokens[before] + 1 < fewest:
                            value, fewest = score, tokens[before] + 1
                nxt = children[node, char] = len(best)
                best.append(value)
                tokens.append(fewest)
            node = nxt
            path.append(node)
        return tokens[node]


_TRIES: dict[str, PrefixTrie] = {}


def trie(path: str) -> PrefixTrie:
    """One trie for each vocabulary and worker process."""
    if path not in _TRIES:
        _TRIES[path] = PrefixTrie(load_scores(path))
    return _TRIES[path]


def _count(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = trie(path)
        for batch in batches:
            pieces, tokens = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                counts = list(map(shared.terminals.get, words))
                if None in counts:
                    counts = [shared.count(w) if n is None else n for w, n in zip(words, counts, strict=True)]
                pieces.append(len(words))
                tokens.append(sum(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], names=["key", "n_pretokens", "n_tokens"])

    return rows


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its `key`, `n_pretokens` (runs without white space) and `n_tokens`. A null or empty text, or one of white
    space, has none of either. Rows that repeat each give a row; an empty table gives an empty result; other columns are
    not read. `vocabulary` is the path of a sentencepiece model on every worker. No shuffle; a task streams its rows."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(_count(vocabulary), f"key {kind}, n_pretokens long, n_tokens long")
    return counted.withColumnRenamed("key", key)
