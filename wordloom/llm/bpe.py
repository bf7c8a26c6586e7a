"""Operator 2: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are split by the tokenizer's pattern. Pre-tokens leave their documents with their positions (as positions in a block,
see ``_blocks``), each distinct one of the corpus is encoded once, the ids are joined back and reassembled by position.
Decoding joins the table of the tokens' bytes, whose size is the vocabulary's.

Null text is an empty text (no ids, empty bytes). Null and repeated doc_ids are kept, a row for each row. Other columns of
the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import _blocks as B
from wordloom.llm._common import short_batches, bucket_count, texts


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_NEWER: list[str] = []


def newer_characters() -> str:
    """Characters that this process's ``regex`` counts among letters or numbers and the library's patterns, of an older
    Unicode version, don't. Found once for each worker process, by asking both."""
    if not _NEWER:
        import regex
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        classes = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={})
        every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
        theirs: set[str] = set()
        for i in range(0, len(every), 20_000):
            theirs.update(bytes(classes.encode_ordinary("".join(every[i : i + 20_000]))).decode())
        _NEWER.append("".join(sorted(set(regex.findall(r"[\p{L}\p{N}]", "".join(every))) - theirs)))
    return _NEWER[0]


def splitter(pattern: str):
    """Makes a function of a text that returns its pre-tokens, as the library's pattern finds them."""

    def make():
        import regex

        found, newer = regex.compile(pattern), newer_characters()
        if not newer:
            return found.findall
        odd = re.compile(f"[{_ranges(newer)}]").search
        plain = dict.fromkeys(map(ord, newer), "\ue000")  # neither letter nor number in any version

        def split(text: str) -> list[str]:
            if text.isascii() or odd(text) is None:
                return found.findall(text)
            return [text[m.start() : m.end()] for m in found.finditer(text.translate(plain))]

        return split

    return make


def _ranges(characters: str) -> str:
    """Sorted characters as the inside of a character class."""
    runs: list[list[int]] = []
    for c in map(ord, characters):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _encoder(path: str, pattern: str):
    def make():
        import tiktoken

        ranks = load_ranks(path)
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

        kind = np.min_scalar_type(max(ranks.values()))  # sent in two bytes an id, if that will do

        def values(words: list[str], _) -> list[bytes]:
            one = core.encode_single_piece
            return [np.asarray(one(w.encode()), kind).tobytes() for w in words]

        return values

    return make


def _ragged(flat: np.ndarray, starts: np.ndarray, size: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (start and size by position) one after the other; second, their ends."""
    length = size[pos]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[pos] - (ends - length), length)
    at += np.arange(total)
    return flat[at], ends


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = B.BLOCK_BYTES, decode_too: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens; with decode_too also decoded (binary).

    :func:`ids_array` turns ids into an array column; :func:`decode` works on any ids.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = bucket_count(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), *([("decoded", pa.binary())] if decode_too else [])])

    def finish():
        token_bytes = _token_bytes(ranks_path) if decode_too else None
        kind = np.min_scalar_type(max(load_ranks(ranks_path).values()))

        def make(_, ids, lengths, pos, values) -> Iterator[pa.RecordBatch]:
            ends = np.concatenate([[0], np.cumsum(lengths)])
            step = 2000
            for i in range(0, len(ids), step):
                own = ids[i : i + step]
                got, word_ends = joined_ids(values, pos[ends[i] : ends[min(i + step, len(ids))]])
                last = np.concatenate([[0], word_ends])[ends[i : i + len(own) + 1] - ends[i]]
                cols = [pa.array(own, pa.int64()), _slices(got.view(np.uint8), last * 4), pa.array(np.diff(last), pa.int64())]
                if decode_too:
                    cols.append(_decoded(token_bytes, got, last))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

        cache: dict = {}

        def joined_ids(values, pos):
            if cache.get("of") is not values:
                size = np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize
                cache.update(of=values, size=size, flat=np.frombuffer(b"".join(values), kind).astype(np.uint32), starts=np.concatenate([[0], np.cumsum(size)]))
            return _ragged(cache["flat"], cache["starts"], cache["size"], pos)

        return make

    rows = B.index_blocks(texts(docs), splitter(pattern), n, block_bytes)
    return B.reassemble(B.valued(rows, n, _encoder(ranks_path, pattern)), n, finish, "doc_id bigint, ids binary, n_tokens bigint" + ", decoded binary" * decode_too)


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of consecutive runs; the first run begins at ends[0]."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes, where each begins, and its size."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(size)]), size


def _decoded(token_bytes, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    flat, starts, size = token_bytes
    out, token_ends = _ragged(flat, starts, size, ids.astype(np.int64))
    return _slices(out, np.concatenate([[0], token_ends])[ends])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (with ids as :func:`encode` gives them) and a column decoded: the ids' bytes. Null ids: empty bytes."""
    schema = encoded.select("*", F.lit(b"").alias("decoded")).schema

    def run(batches):
        token_bytes = _token_bytes(ranks_path)
        for batch in batches:
            ids = [x or b"" for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(token_bytes, np.frombuffer(b"".join(ids), np.uint32), ends)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def ids_array(df: DataFrame, column: str = "ids") -> DataFrame:
    """The binary ids as an array of integers."""
    hexed = F.hex(column)
    le = F.transform(F.sequence(F.lit(1), (F.length(column) / 4).cast("int")), lambda i: hexed.substr(((i - 1) * 8 + 1).cast("int"), F.lit(8)))
    number = F.transform(le, lambda h: F.conv(F.concat(h.substr(7, 2), h.substr(5, 2), h.substr(3, 2), h.substr(1, 2)), 16, 10).cast("int"))
    return df.withColumn(column, F.when(F.length(column) > 0, number).otherwise(F.array().cast("array<int>")))
