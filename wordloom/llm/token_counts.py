"""Operator 8: token counts by dynamic programming over a trie that pre-tokens share.

A text's tokens are those of the best unigram segmentation of its pre-tokens: each vocabulary item of rank r scores
-ln(r + 2), as in a Zipf distribution of the ranks, a segmentation scores the sum, and the best one counts (at equal scores
the one with fewer tokens). A forward score depends on a prefix alone, so distinct pre-tokens go into a trie and each node
is scored once, for all that share it; the terminal nodes keep the counts, which are joined back to the documents. Pre-tokens
are dealt to reducers by their first ``SHARED`` characters, long ones by their first half, so that the many long strings that begin alike (addresses,
runs of digits, code) don't meet in one reducer. A node is scored once in each reducer that has it.

Null text counts 0. Null and repeated doc_ids are kept, a row for each row. Other columns are ignored; an empty table
gives an empty result. Every single byte must be in the vocabulary, so any text has a segmentation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm import _blocks as B
from wordloom.llm._common import short_batches, bucket_count, texts
from wordloom.llm.bpe import load_ranks, splitter

#: Characters by which pre-tokens are dealt, at least.
SHARED = 5


def dealt_by(word: str) -> str:
    return word[: max(SHARED, len(word) // 2)]


def piece_scores(path: str) -> dict[bytes, float]:
    return {token: -math.log(rank + 2) for token, rank in load_ranks(path).items()}


class VocabularyTrie:
    """The vocabulary's items, spelt backwards, so that all items that end at a position are found in one walk."""

    def __init__(self, scores: dict[bytes, float]):
        self.root: dict = {}
        for token, score in scores.items():
            node = self.root
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = score

    def step(self, word: bytes, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Score and count of the prefix of length ``end`` from those of the shorter prefixes."""
        node, top, fewest = self.root, -math.inf, 0
        for start in range(end - 1, -1, -1):
            node = node.get(word[start])
            if node is None:
                break
            score = node.get(-1)
            if score is not None:
                x = best[start] + score
                if x > top or x == top and count[start] + 1 < fewest:
                    top, fewest = x, count[start] + 1
        return top, fewest


def trie_counts(words: list[bytes], trie: VocabularyTrie) -> np.ndarray:
    """Token counts of distinct words.

    In sorted order the words visit the nodes of their trie depth first; the path to the present node is all that is kept,
    and each node is scored once, when it is first entered.
    """
    out = np.zeros(len(words), np.int32)
    order = sorted(range(len(words)), key=words.__getitem__)
    best, count, path = [0.0], [0], b""
    for i in order:
        word = words[i]
        shared, most = 0, min(len(path), len(word))
        if word[:most] == path[:most]:
            shared = most
        else:
            while word[shared] == path[shared]:
                shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            x, c = trie.step(word, end, best, count)
            best.append(x)
            count.append(c)
        path = word
        out[i] = count[len(word)]
    return out


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_bytes of each row of docs."""
    spark = docs.sparkSession
    short_batches(spark)
    n = bucket_count(docs)

    def value():
        trie = VocabularyTrie(piece_scores(ranks_path))

        def make(words: list[str], _) -> np.ndarray:
            raw = [w.encode() for w in words]
            return np.stack([trie_counts(raw, trie), np.fromiter(map(len, raw), np.int32, len(raw))], axis=1)

        return make

    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def finish():
        def make(_, ids, lengths, pos, values) -> Iterator[pa.RecordBatch]:
            ends = np.concatenate([[0], np.cumsum(lengths)])
            sums = []
            for k in range(2):
                running = np.concatenate([[0], np.cumsum(values[:, k].astype(np.int64)[pos])]) if len(pos) else np.zeros(1, np.int64)
                sums.append(np.diff(running[ends]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(sums[0]), pa.array(sums[1])], schema=schema)

        def safe(block, ids, lengths, pos, values):
            return make(block, ids, lengths, pos, values if isinstance(values, np.ndarray) else np.zeros((0, 2), np.int32))

        return safe

    rows = B.index_blocks(texts(docs), splitter(pattern), n, block_bytes, route=dealt_by)
    return B.reassemble(B.valued(rows, n, value), n, finish, "doc_id bigint, n_pretokens bigint, n_tokens bigint, n_bytes bigint")
