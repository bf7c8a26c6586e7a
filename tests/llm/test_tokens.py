"""Operators 1, 2 and 8."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ROWS, key
from wordloom.llm import _blocks as B
from wordloom.llm import bpe, packing
from wordloom.llm import token_counts as T

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, empty, library):
    small = bpe.encode(docs, RANKS, P.PATTERN, block_bytes=3000, decode_too=True).collect()
    want = key((i, np.asarray(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in ROWS)
    assert key((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in small) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in small)
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_bpe_decode_and_array(spark, docs, library):
    encoded = bpe.encode(docs.where("doc_id in (1, 4, 8)"), RANKS, P.PATTERN)
    got = {r["doc_id"]: r for r in bpe.ids_array(bpe.decode(encoded, RANKS)).collect()}
    for i, t in ROWS:
        if i in (1, 4, 8):
            assert got[i]["ids"] == library.encode_ordinary(t) and bytes(got[i]["decoded"]).decode() == t


def test_pattern_classes(library):
    """The splitter finds the pre-tokens of the library's pattern, with characters of newer Unicode versions too."""
    split = bpe.splitter(P.PATTERN)()
    texts = ["".join(f"a{c} {c}1{c}{c}" for c in bpe.newer_characters()[::97] + "é٣ "), *("".join(map(chr, range(c, c + 999))) for c in range(1, 0xC000, 997))]
    for t in texts:
        assert [x for w in split(t) for x in library._core_bpe.encode_single_piece(w.encode())] == library.encode_ordinary(t)


def brute_count(word: bytes, scores: dict) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[a][0] + scores[word[a:end]], best[a][1] + 1) for a in range(end) if word[a:end] in scores]
        top = max(s for s, _ in options)
        best.append((top, min(c for s, c in options if s == top)))
    return best[-1][1]


def test_token_counts(docs, empty):
    import regex

    scores, split = T.piece_scores(RANKS), regex.compile(P.PATTERN).findall
    memo = {}
    want = key((i, len(ws), sum(memo.setdefault(w, brute_count(w.encode(), scores)) for w in ws)) for i, t in ROWS for ws in [split(t or "")])
    got = T.token_counts(docs, RANKS, P.PATTERN, block_bytes=5000).collect()
    assert key((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in got) == want
    assert T.token_counts(empty, RANKS, P.PATTERN).count() == 0


def test_long_pre_tokens_that_begin_alike_are_dealt_apart():
    rng = random.Random(1)
    words = ["https" + "".join(rng.choices("abcdef0123456789", k=40)) for _ in range(2000)]
    assert len({T.dealt_by(w) for w in words}) > 1900 and {T.dealt_by(w) for w in ("house", "houses", "household")} == {"house"}


def test_blocks_made_again_of_other_rows_are_an_error(spark, docs):
    """As when an executor is lost and its source gives its rows in another order."""
    split = lambda: str.split
    index = lambda df: B.index_blocks(df.select("doc_id", "text").coalesce(1), split, 4)
    once, again = index(docs.where("doc_id < 8")), index(docs.where("doc_id < 8 and doc_id <> 2"))
    sizes = lambda: lambda words, _: np.asarray([[len(w)] for w in words])
    finish = lambda: lambda _, ids, lengths, pos, values: iter([pa.record_batch({"n": pa.array([int(values.sum())])})])
    assert B.reassemble(B.valued(once, 4, sizes), 4, finish, "n bigint").count() == 1
    mixed = once.where(F.col("kind") == B.DOCS).union(again.where(F.col("kind") == B.WORDS))
    with pytest.raises(Exception, match="made again of other rows"):
        B.reassemble(B.valued(mixed, 4, sizes), 4, finish, "n bigint").count()


def test_trie_ties():
    trie = T.VocabularyTrie({b"a": -1.0, b"b": -1.0, b"ab": -2.0, b"abc": -9.0, b"c": -1.0})
    assert T.trie_counts([b"ab", b"abc", b"", b"a", b"ab"], trie).tolist() == [1, 2, 0, 1, 1]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_word_encoder(reference):
    e = packing.WordEncoder(WORDS)
    texts = [t or "" for _, t in ROWS] + ["It's WE'LL don't're x'S", "a <|endoftext|> b", "x<|startoftext|>Y Z<|endoftext|>", "<|ENDOFTEXT|> <| endoftext|>", "<|endoftext|", "１２ ½ Ⅷ ﬁ ǅ ß µ ª", "a b c\u0085d"]
    assert e.fast.usable
    for _ in range(2):  # from scratch, and from what is kept
        for t, got in zip(texts, e.encode(texts)):
            assert np.frombuffer(got, np.uint32).tolist() == reference.encode(t, add_special_tokens=False).ids


def brute_bfd(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        room = min((b for b in bins if b >= x), default=None)
        if room is None:
            bins.append(capacity - x)
        else:
            bins[bins.index(room)] -= x
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = 50
    lengths = rng.choice([1, 2, 3, 7, 11, 24, 25, 26, 50] if seed % 2 else np.arange(1, 51), 400)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan_runs(dict(zip(values.tolist(), counts.tolist())), capacity)
    used, covered = {}, 0
    ends = np.append(plan["key"][1:], 0)
    for k, at, first, offset, end in zip(plan["key"].tolist(), plan["rank"].tolist(), plan["sequence"].tolist(), plan["offset"].tolist(), ends.tolist()):
        length = k >> 44
        stop = (end & ((1 << 44) - 1)) if end >> 44 == length else dict(zip(values.tolist(), counts.tolist()))[length]
        for r in range(stop - at):
            used.setdefault(first + r, []).append((offset, length))
            covered += 1
    assert covered == 400
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == brute_bfd(lengths.tolist(), capacity)


def test_packed_documents(docs, empty, reference):
    got = packing.packed_documents(docs, WORDS, capacity=256).collect()
    want = []
    for i, t in ROWS:
        ids = np.asarray([*reference.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, min(256, len(ids) - a), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == key(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 256
    assert len(sequences) <= math.ceil(sum(w[3] for w in want) / 256) + 1
    assert packing.packed_documents(empty, WORDS).count() == 0


def test_pack_odd_lengths(spark):
    items = spark.createDataFrame([(1, 0, 3), (2, 0, None), (3, 0, 0), (4, 0, 99), (5, 0, 7)], "doc_id bigint, piece int, length bigint")
    got = {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in packing.best_fit_pack(items, 10).collect()}
    assert got[5] == (0, 0) and got[1] == (0, 7) and got[2] == got[3] == got[4] == (None, None)


def test_pack_columns_of_the_same_names(spark):
    items = spark.createDataFrame([(1, 0, 3, 9, 9, 9, 9)], "doc_id bigint, piece int, length bigint, sequence_id int, offset int, _len int, _salt int")
    got = packing.best_fit_pack(items, 10)
    assert sorted(got.columns) == sorted(items.columns) and got.first()["sequence_id"] == 0 and got.first()["_len"] == 9


def test_long_text_is_whole(docs):
    assert sum(r["length"] for r in packing.token_pieces(docs.where("doc_id = 7"), WORDS, 512).collect()) > len(LONG.split())
    assert hashlib.sha256(LONG.encode()).hexdigest()
