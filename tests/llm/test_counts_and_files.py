import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from quern.llm import tokencounts, tokenfiles

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def trie():
    return tokencounts.PrefixTrie(tokencounts.load_scores(PIECES))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)  # at its default setting


def brute(token, scores, unknown):
    """The best (score, fewest tokens) over all segmentations, by dynamic programming on one word alone."""
    best = [(0, 0)]
    for j in range(1, len(token) + 1):
        found = [(best[i][0] + scores[token[i:j]], -(best[i][1] + 1)) for i in range(j) if token[i:j] in scores]
        if token[j - 1] not in scores:
            found.append((best[j - 1][0] + unknown, -(best[j - 1][1] + len(token[j - 1].encode()))))
        score, fewest = max(found)
        best.append((score, -fewest))
    return best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdetionsr,.é日😀ß'", min_size=1, max_size=14))
def test_trie_counts_like_a_word_alone(trie, word):
    assert trie.count(word) == brute(tokencounts.START + word, trie.scores, trie.unknown)


def test_trie_counts_like_the_library(trie):
    ours = Tokenizer(models.Unigram([("<unk>", 0.0), *((p, s / tokencounts.UNITS) for p, s in trie.scores.items())], unk_id=0, byte_fallback=False))
    for word in "the theme theory them internationalisation whatever, Straße déjà 12345 a".split():
        assert trie.count(word) == len(ours.encode(tokencounts.START + word).ids)


def test_prefixes_are_computed_once(trie):
    trie.clear()
    trie.terminals.clear()
    trie.count("prefixes")
    before = len(trie.best)
    trie.count("prefixed")
    assert len(trie.best) == before + 1


def test_counts_of_odd_texts(spark, odd, trie):
    table = odd.withColumns({"n_tokens": F.lit("clash"), "key": F.lit(1)})
    found = tokencounts.count_tokens(table, PIECES)
    assert found.columns == ["doc_id", "n_pretokens", "n_tokens"] and found.count() == odd.count()
    by_id = {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}
    assert all((by_id[i]["n_pretokens"], by_id[i]["n_tokens"]) == (0, 0) for i in (1, 2, 3)) and by_id[7]["n_pretokens"] == 60_000
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for i in (4, 5, 8, 9):
        assert by_id[i]["n_tokens"] == sum(brute(tokencounts.START + w, trie.scores, trie.unknown) for w in texts[i].split())
    assert tokencounts.count_tokens(odd.limit(0), PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=200))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, escapes, high = tokenfiles.pack(ids)
    assert (tokenfiles.unpack(words, len(ids), escapes, high) == ids).all()
    assert len(words) <= len(ids) and len(escapes) == sum(v > tokenfiles.MAX_VALUE for v in values)


def test_packing_density():
    words, _, _ = tokenfiles.pack(np.ones(6000, np.uint64))
    assert len(words) == 100
    words, _, _ = tokenfiles.pack(np.full(3000, 50_000, np.uint64))
    assert len(words) == 1000


def encoded(*texts):
    return [np.frombuffer(x, np.uint32).tolist() for x in tokenfiles.encoder(BPE).encode_batch(list(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab 1 \n\t'.,sé日\x85\xa0\x1f²Ⅷ_<|ßñªµ$&Ǆʼ", max_size=40), max_size=4))
def test_encoder_equals_the_library(library, texts):
    assert encoded(*texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_cache_ages(library, monkeypatch):
    monkeypatch.setattr(tokenfiles.Encoder, "PIECES", 20)
    own = tokenfiles.Encoder(BPE)
    texts = [" ".join(f"word{i % 7} x{chr(97 + i % 26)}y{i}, again." for i in range(n, n + 9)) for n in range(60)]
    for text in texts:
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.spaced) <= 20 + 4 * 9 and len(own.spaced.before) <= 20 + 4 * 9


def test_query_against_the_library(spark, library):
    from compare import TINY

    from quern.llm.queries import op5_token_files

    want, at = [], 0
    for r in sorted(spark.read.parquet(f"{TINY}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op5_token_files(spark, TINY).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_files_of_odd_texts(spark, odd, library):
    table = odd.withColumns({"start": F.lit(1), "ids": F.lit("clash")})
    found = tokenfiles.encode_and_read(table, BPE).collect()
    assert len(found) == odd.count()
    expected = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at, got = 0, sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [k for k, _ in expected]
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    for r, (key, text) in zip(got, expected, strict=True):
        if key is not None:
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert tokenfiles.encode_and_read(odd.limit(0), BPE).count() == 0


def test_ids_can_be_read(spark, docs, library):
    from quern.llm.storage import scratch_path

    path = scratch_path(spark, "t")
    tokenfiles.write_tokens(docs((2, "b " * 70_000), (1, "hello world")), path, BPE, end=50_256)
    found = {r["doc_id"]: r["ids"] for r in tokenfiles.read_tokens(spark, path).collect()}
    assert found[1] == [*library.encode("hello world").ids, 50_256] and len(found[2]) > 70_000


def test_added_tokens_have_their_ids(library):
    texts = ("hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n", "a <|endoftext| b", "x <|endoftext|>  <|endoftext|> y")
    assert encoded(*texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded("hello <|endoftext|> world") == [[31373, 220, 50256, 995]]


def test_files_with_other_rules_are_left_to_the_library():
    other = public_tokenizers.path("word_bpe_49k.json")
    own, library = tokenfiles.Encoder(other), Tokenizer.from_file(other)
    assert not own.cuts
    for text in ("Hello  World <|endoftext|> again", "", " a b "):
        assert np.frombuffer(own.encode_batch([text])[0], np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("null_share", [0.0, 0.5])
def test_ranges_split_rows_that_share_a_key(spark, null_share):
    from quern.llm.storage import in_key_order

    rows = [(None if i < 1000 * null_share else 7 if i < 800 else i, f"t{i}") for i in range(1000)]
    laid = in_key_order(spark.createDataFrame(rows, "key long, text string"), "key", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    found = [(r["part"], r["key"] is not None, r["key"] or 0) for r in laid.collect()]
    assert found == sorted(found) and len(found) == 1000  # the order holds over the partitions
    sizes = {}
    for part, *_ in found:
        sizes[part] = sizes.get(part, 0) + 1
    assert max(sizes.values()) < 450 and len(sizes) >= 3


def test_token_counts_of_a_whole_table(spark, trie):
    from compare import TINY

    from quern.llm.queries import op2_token_counts

    want, known = [], {}
    for r in spark.read.parquet(f"{TINY}/documents.parquet").collect():
        words = (r["text"] or "").split()
        for w in words:
            if w not in known:
                known[w] = brute(tokencounts.START + w, trie.scores, trie.unknown)
        want.append((r["doc_id"], len(words), sum(known[w] for w in words)))
    assert sorted(map(tuple, op2_token_counts(spark, TINY).select("doc_id", "n_pretokens", "n_tokens").collect())) == sorted(want)
