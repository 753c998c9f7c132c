"""Token-id files: byte-level BPE ids packed with a Simple-8b word-aligned code, as a PySpark data source.

A file holds blocks of up to BLOCK ids and a footer. A 64-bit word has a selector in its upper four bits and as many ids
of equal width as the selector says in the other sixty. Values of more than sixty bits are escapes: the packed stream has
a 0 in their place, and the block lists their positions and values. The footer gives each block's offset and counts and
each document's id and length, so any block can be decoded alone, without a loop over words."""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quern.llm.storage import bound_batches, in_key_order, open_fs, scratch_path

BLOCK = 1 << 16
#: Ids in a word and bits of each, by selector; selectors 0 and 1 are not used.
SELECTORS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
MAX_VALUE = (1 << 60) - 1
MAGIC = b"QSIMPLE8"
_SHIFTS = {s: (np.arange(n, dtype=np.uint64) * np.uint64(b)) for s, (n, b) in SELECTORS.items()}
_COUNTS = np.zeros(16, dtype=np.int64)
for _s, (_n, _b) in SELECTORS.items():
    _COUNTS[_s] = _n


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escape positions and escape values of a block of unsigned ids. Each word takes as many ids as fit."""
    ids = np.ascontiguousarray(ids).astype(np.uint64)
    n = len(ids)
    escapes = np.flatnonzero(ids > MAX_VALUE).astype(np.uint32)
    values = ids[escapes]
    ids[escapes] = 0
    bits = np.minimum(np.frexp(ids.astype(np.float64))[1], 60).astype(np.uint8)
    selector = np.full(n, max(SELECTORS), dtype=np.uint8)
    widest = int(bits.max()) if n else 0
    for s in sorted(SELECTORS, reverse=True):  # ends with the selector that takes the most ids; zeros follow the last one
        count, width = SELECTORS[s]
        if width >= widest:
            selector[:] = s
            continue
        wide = np.zeros(n + count + 1, dtype=np.int32)  # how many of the ids before each are too wide
        np.cumsum(bits > width, out=wide[1 : n + 1])
        wide[n + 1 :] = wide[n]
        selector[wide[count : count + n] == wide[:n]] = s
    steps, i, starts = _COUNTS[selector].tolist(), 0, []
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts, dtype=np.int64)
    chosen = selector[starts] if n else selector
    padded = np.concatenate([ids, np.zeros(60, dtype=np.uint64)])
    words = np.zeros(len(starts), dtype=np.uint64)
    for s, (count, _) in SELECTORS.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            taken = padded[starts[mine, None] + np.arange(count)] << _SHIFTS[s]
            words[mine] = np.bitwise_or.reduce(taken, axis=1) | np.uint64(s << 60)
    return words, escapes, values


def unpack(words: np.ndarray, n: int, escapes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The n ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) + 60, dtype=np.uint64)
    for s, (count, bits) in SELECTORS.items():
        mine = np.flatnonzero(selector == s)
        if len(mine):
            out[starts[mine, None] + np.arange(count)] = (words[mine, None] >> _SHIFTS[s]) & np.uint64((1 << bits) - 1)
    out = out[:n]
    out[escapes] = values
    return out


class BlockFile:
    """Writes one token file to an open stream."""

    def __init__(self, stream):
        self.stream, self.at, self.held, self.n_held = stream, 0, [], 0
        self.blocks: list[tuple[int, int, int, int]] = []  # offset, ids, words, escapes
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, keys: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Documents with their ids one after another."""
        self.keys += keys
        self.lengths += lengths
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for i in range(0, end, BLOCK):
            part = ids[i : min(i + BLOCK, end)]
            words, escapes, values = pack(part)
            self.blocks.append((self.at, len(part), len(words), len(escapes)))
            self._put(words.astype("<u8").tobytes() + escapes.astype("<u4").tobytes() + values.astype("<u8").tobytes())
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        footer = [
            struct.pack("<QQ", len(self.blocks), len(self.keys)), np.array(self.blocks, dtype="<i8").tobytes(),
            np.array([k or 0 for k in self.keys], dtype="<i8").tobytes(), np.array([k is None for k in self.keys], dtype="u1").tobytes(),
            np.array(self.lengths, dtype="<i8").tobytes(),
        ]
        size = sum(map(len, footer))
        self._put(b"".join(footer) + struct.pack("<Q", size) + MAGIC)


class BlockIndex:
    """The footer of a token file, and its blocks on demand."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.size()
        stream.seek(end - 16)
        tail = stream.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<Q", tail[:8])[0]
        stream.seek(end - 16 - size)
        footer = stream.read(size)
        n_blocks, n_docs = struct.unpack_from("<QQ", footer)
        at = 16
        self.blocks = np.frombuffer(footer, dtype="<i8", count=4 * n_blocks, offset=at).reshape(-1, 4)
        at += 32 * n_blocks
        self.keys = np.frombuffer(footer, dtype="<i8", count=n_docs, offset=at)
        self.null = np.frombuffer(footer, dtype="u1", count=n_docs, offset=at + 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(footer, dtype="<i8", count=n_docs, offset=at + 9 * n_docs)

    def block(self, i: int) -> np.ndarray:
        offset, n, n_words, n_escapes = self.blocks[i].tolist()
        self.stream.seek(offset)
        data = self.stream.read(8 * n_words + 12 * n_escapes)
        words = np.frombuffer(data, dtype="<u8", count=n_words)
        escapes = np.frombuffer(data, dtype="<u4", count=n_escapes, offset=8 * n_words)
        return unpack(words, n, escapes, np.frombuffer(data, dtype="<u8", count=n_escapes, offset=8 * n_words + 4 * n_escapes))

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in file order; holds one block and one document."""
        left, i = np.zeros(0, dtype=np.uint64), 0
        for length in self.lengths.tolist():
            parts, got = [left], len(left)
            while got < length:
                parts.append(self.block(i))
                got += len(parts[-1])
                i += 1
            whole = np.concatenate(parts) if len(parts) > 1 else left
            yield whole[:length]
            left = whole[length:]


class WrongCut(Exception):
    """White space stands beside a space at which a text was cut."""


class _Pieces(dict):
    """Ids of pieces, found by an encoder when they are first asked for. When there are too many, those that are asked for
    again are taken over and the rest are forgotten in the end."""

    def __init__(self, encoder: Encoder, space: str):
        super().__init__()
        self.encoder, self.space, self.before = encoder, space, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encoder.piece(piece, self.space, self)
        if len(piece) <= Encoder.LONGEST:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > Encoder.PIECES:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts by the tokenizers library, equal to its `encode(text, add_special_tokens=False)`, markers of a text's
    end and other added tokens included.

    A text is cut where a byte-level pre-tokenizer always starts a new word and no added token reaches across: at single
    spaces and line ends between two other characters, and between letters and the marks after them. The library encodes each
    distinct piece once (its model alone where a piece is of Latin letters, which are one word), with the space before it,
    and its ids are kept in a bounded cache. With a tokenizer file for which that does not hold, it encodes texts as they are."""

    #: Pieces in a generation of the cache, of which two are kept, and characters of a piece that is kept.
    PIECES, LONGEST = 700_000, 64
    #: Characters below this are letters, or none, in every version of Unicode.
    SETTLED = "\u0250"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cutter, added = rules.get("pre_tokenizer") or {}, rules.get("added_tokens", [])
        plain = not any(rules.get(k) for k in ("normalizer", "truncation", "padding", "post_processor")) and not rules["model"].get("dropout")
        marked = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s|^\w", t["content"])) for t in added)
        self.cuts = plain and marked and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.spaced, self.bare = _Pieces(self, " "), _Pieces(self, "")
        if self.cuts:
            shown = lambda text: self.library.pre_tokenizer.pre_tokenize_str(text)[0][0]  # noqa: E731  how the model sees a word
            self.model, self.space, self.line = self.library.model, shown(" a")[0], self._library("\n")
            self.letters = {i: shown(chr(i)) for i in range(ord(self.SETTLED)) if chr(i).isalpha()}

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < self.SETTLED)

    def piece(self, piece: str, space: str, alike: _Pieces) -> bytes:
        if self._word(piece):
            word = piece if piece.isascii() else piece.translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(self.space + word if space else word)]).tobytes()
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise WrongCut
        stem = piece.rstrip(string.punctuation)
        if stem != piece and self._word(stem):
            return alike[stem] + self.bare[piece[len(stem) :]]
        line, _, more = piece.partition("\n")
        if more and not line[-1].isspace() and not more[0].isspace():
            return alike[line] + self.line + self.bare[more]
        return self._library(space + piece)

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's order."""
        if not self.cuts:
            return self._library(text)
        self.spaced.age()
        self.bare.age()
        pieces = text.split(" ")
        try:
            return self.bare[pieces[0]] + b"".join(map(self.spaced.__getitem__, pieces[1:]))
        except WrongCut:
            return b"".join(self._any(p, i > 0) for i, p in enumerate(self.cut.split(text)))

    def _any(self, piece: str, inner: bool) -> bytes:
        """The ids of a piece that may have white space at an end of the text."""
        try:
            return (self.spaced if inner else self.bare)[piece]
        except WrongCut:
            return self._library(f" {piece}" if inner else piece)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@dataclass
class WrittenTokens(WriterCommitMessage):
    part: int
    file: str
    documents: int
    tokens: int


class TokenWriter(DataSourceArrowWriter):
    """Rows (key, text) in order, one file for each task. Options: path, tokenizer, end (the id after each document).
    Only files of committed tasks are named in the manifest, with the count of ids before each."""

    def __init__(self, options: dict):
        self.path, self.tokenizer, self.end = options["path"], options["tokenizer"], int(options.get("end", 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenTokens | None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        part, encode = TaskContext.get().partitionId(), encoder(self.tokenizer).encode_batch
        name, end, tokens = f"{part:06d}-{uuid.uuid4().hex}.s8b", array("I", [self.end]).tobytes(), 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            file = BlockFile(out)
            for batch in iterator:
                found = encode([t or "" for t in batch.column(1).to_pylist()])
                ids = np.frombuffer(end.join([*found, b""]), dtype=np.uint32)
                file.add(batch.column(0).to_pylist(), [len(x) // 4 + 1 for x in found], ids)
                tokens += len(ids)
            file.close()
        return WrittenTokens(part, name, len(file.keys), tokens)

    def commit(self, messages: list[WrittenTokens | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, base = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            files.append({"file": m.file, "documents": m.documents, "tokens": m.tokens, "before": base})
            base += m.tokens
        with fs.open_output_stream(f"{root}/_manifest.json") as f:
            f.write(json.dumps({"files": files, "tokens": base}).encode())

    def abort(self, messages: list[WrittenTokens | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.file}")


@dataclass
class TokenPart(InputPartition):
    file: str
    before: int


class TokenReader(DataSourceReader):
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) of all files in the manifest; ids are null with the option ids=false."""

    SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"
    ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def __init__(self, options: dict):
        self.path, self.ids = options["path"], options.get("ids", "true") == "true"

    def partitions(self) -> list[TokenPart]:
        fs, root = open_fs(self.path)
        with fs.open_input_stream(f"{root}/_manifest.json") as f:
            files = json.loads(f.read())["files"]
        return [TokenPart(x["file"], x["before"]) for x in files if x["documents"]] or [TokenPart("", 0)]

    def read(self, partition: TokenPart) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, root = open_fs(self.path)
        rows, held, start = [], 0, partition.before
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            index = BlockIndex(f)
            for key, null, ids in zip(index.keys.tolist(), index.null.tolist(), index.documents(), strict=True):
                rows.append((None if null else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int64) if self.ids else None))
                start += len(ids)
                held += 64 + len(ids) * 8 * self.ids
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: Iterable[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), self.ARROW, strict=True)], schema=self.ARROW)


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "simple8b_tokens"

    def schema(self) -> str:
        return TokenReader.SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text (null: empty) and write the ids, `end` after each document, in ascending `key` order (nulls
    first; ties by a hash of the text). Other columns are not written. One range shuffle of (key, text); a task streams its
    documents into one file. An empty table gives files without documents. Rows that repeat are written as often."""
    spark = docs.sparkSession
    bound_batches(spark)
    spark.dataSource.register(TokenSource)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    laid = in_key_order(rows, "key", F.xxhash64("text"))
    laid.write.format("simple8b_tokens").option("path", path).option("tokenizer", tokenizer).option("end", str(end)).mode("append").save()


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row for each document in the files under `path`."""
    spark.dataSource.register(TokenSource)
    return spark.read.format("simple8b_tokens").option("ids", str(ids).lower()).load(path)


def encode_and_read(docs: DataFrame, tokenizer: str, end: int = 0, **columns) -> DataFrame:
    """Write token files under the shared folder and read the documents' digests back from them."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end, **columns)
    return read_tokens(docs.sparkSession, path, ids=False).drop("ids")
