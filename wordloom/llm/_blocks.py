"""Distinct-word joins for texts without one shuffled row per word.

A task cuts its documents into blocks of some megabytes of text. For each block it emits

* one ``DOCS`` row: the words of its documents, in order, as positions in the block's list of distinct words;
* one ``WORDS`` row for each bucket of the word hash: the block's distinct words of that bucket.

``WORDS`` rows of a bucket meet in one reducer, which sees each distinct word of the corpus exactly once and makes a value
for it. It sends ``VALUES`` rows back to the blocks, where :func:`reassemble` puts the values into the words' places.

A hot word costs one entry a block, however often it occurs. The rows of a block come from one task, so the scheme is
sound under retries as long as the source gives a partition's rows in the same order again, as file scans do. Each packet of a block holds a
digest of its documents and words; where a lost block has been made again of other rows, its packets don't agree, and :func:`reassemble`
raises.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm._common import reducer_count

DOCS, WORDS, VALUES, EXTRA = 0, 1, 2, 3
ROW = "kind int, slot int, block bigint, payload binary"
_ARROW = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
#: Text in a block: what one Python worker indexes at once.
BLOCK_BYTES = 24 << 20


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def squeezed(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def expanded(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def word_hash(words: list) -> np.ndarray:
    """64-bit hashes, the same in each process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close inputs (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack_positions(pos: np.ndarray) -> list[bytes]:
    """Positions are ranks by frequency: the 255 commonest take a byte, the others three more."""
    small = np.minimum(pos, 255).astype(np.uint8)
    rest = pos[pos >= 255] - 255
    planes = [((rest >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)]
    z = zstandard.ZstdCompressor(level=3).compress
    return [z(small.tobytes()), *map(z, planes)]


def unpack_positions(parts: list[bytes]) -> np.ndarray:
    z = zstandard.ZstdDecompressor().decompress
    small = np.frombuffer(z(parts[0]), np.uint8)
    pos = small.astype(np.int64)
    high = small == 255
    rest = np.zeros(int(high.sum()), np.int64)
    for k, p in enumerate(parts[1:]):
        rest |= np.frombuffer(z(p), np.uint8).astype(np.int64) << (8 * k)
    pos[high] = rest + 255
    return pos


def digest_of(ids: list, lengths: np.ndarray, packed: list[bytes], words: list) -> int:
    """64 bits that tell a block's documents and distinct words from those of others."""
    import xxhash

    h = xxhash.xxh3_64()
    for part in (repr(ids).encode(), np.asarray(lengths, np.int64).tobytes(), *packed, word_hash(words).tobytes()):
        h.update(part)
    return h.intdigest()


def smallest(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes each as they need."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def steps(at: np.ndarray) -> np.ndarray:
    """Rising positions as steps; cumsum() gives them back."""
    return smallest(np.diff(at, prepend=0))


def joined(values: list[bytes]) -> tuple[np.ndarray, bytes]:
    return smallest(np.fromiter(map(len, values), np.int64, len(values))), b"".join(values)


def apart(sizes: np.ndarray, data: bytes) -> Iterator[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return (data[a:b] for a, b in zip([0, *ends], ends))


def numbers() -> dict:
    """Numbers things from 0 in the order in which they are looked up first."""
    of: dict = defaultdict()
    of.default_factory = of.__len__
    return of


def by_slot(slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each slot that occurs, and where, in order."""
    order = np.argsort(slot, kind="stable")
    if len(order):
        own = slot[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield from zip(own[first].tolist(), np.split(order, first[1:]))


def grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    """Groups of rows of equal values in a column, of batches sorted by it: one group at a time is held."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[column] != key:
                yield key, rows
                rows = []
            key = row[column]
            rows.append(row)
    if rows:
        yield key, rows


def to_buckets(rows: DataFrame, n: int) -> DataFrame:
    """Rows of a slot together, one slot after the other; several slots may share a reducer."""
    reducers = reducer_count(rows.sparkSession, n)
    return rows.repartitionById(reducers, F.pmod("slot", F.lit(reducers))).sortWithinPartitions("slot")


def to_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows of a block together, one block after the other."""
    return rows.repartition(reducer_count(rows.sparkSession, n), "block").sortWithinPartitions("block")


class Index:
    """The words of a block's documents."""

    def __init__(self):
        self.ids, self.lengths, self.chunks, self.bytes = [], [], [], 0
        self.of = numbers()

    def add(self, doc_id, words: list, size: int) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.chunks.append(np.fromiter(map(self.of.__getitem__, words), np.int32, len(words)))
        self.bytes += size

    def closed(self, buckets: int, route: Callable | None = None) -> tuple[list, np.ndarray, np.ndarray, list, np.ndarray]:
        """Row ids, words a row, positions of all words, the distinct words and their buckets.

        Distinct words are in falling order of frequency, those of a frequency by bucket: a bucket's are then mostly in a row.
        """
        words = list(self.of)
        pos = np.concatenate(self.chunks) if self.chunks else np.zeros(0, np.int32)
        # Another hash than the bucket number's own, so that buckets and hash partitions are independent.
        slot = (mixed(word_hash(words if route is None else list(map(route, words))) ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((slot, -np.bincount(pos, minlength=len(words))))
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        return self.ids, np.asarray(self.lengths, np.int64), rank[pos], [words[i] for i in order.tolist()], slot[order]


def index_blocks(docs: DataFrame, split: Callable, buckets: int, block_bytes: int = BLOCK_BYTES, extra: Callable | None = None, counted: Callable | None = None, route: Callable | None = None) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` as DOCS and WORDS rows.

    split() makes a function of a text that returns its words; extra(ids, lengths, positions, words) may return more
    (slot, payload) rows of kind EXTRA; counted(ids) says which documents count in the words' frequencies, else all do; words are
    dealt to buckets by their hash, or by that of route(word).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, part, done = split(), TaskContext.get().partitionId(), 0
        block = Index()

        def close() -> Iterator[pa.RecordBatch]:
            ids, lengths, pos, words, slot = block.closed(buckets, route)
            key = (part << 24) | done
            if counted is None:
                times = np.bincount(pos, minlength=len(words))
            else:
                times = np.bincount(pos[np.repeat(np.asarray(counted(ids), bool), lengths)], minlength=len(words))
            packed = pack_positions(pos)
            digest = digest_of(ids, lengths, packed, words)
            rows = [(DOCS, int(mixed(np.asarray([key], np.uint64))[0] % np.uint64(buckets)), pack((ids, lengths, len(words), packed, digest)))]
            for b, at in by_slot(slot):
                rows.append((WORDS, b, pack((steps(at), [words[i] for i in at.tolist()], smallest(times[at]), digest))))
            if extra is not None:
                rows += [(EXTRA, s, p) for s, p in extra(ids, lengths, pos, words)]
            for i in range(0, len(rows), 64):
                k, s, p = zip(*rows[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array([key] * len(k), pa.int64()), pa.array(p, pa.binary())], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                block.add(doc_id, words_of(text), len(text))
                if block.bytes >= block_bytes:
                    yield from close()
                    block, done = Index(), done + 1
        if block.ids:
            yield from close()

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def valued(rows: DataFrame, n: int, value: Callable, pass_kinds: tuple[int, ...] = (DOCS,), extra: Callable | None = None) -> DataFrame:
    """Bring each bucket's WORDS rows together and make VALUES rows of them; rows of pass_kinds go through.

    value() makes a function of (distinct words, their counts) that returns a list of bytes or an array, one value a word. extra()
    makes a function of (slot, the distinct words' counts, [(block, payload)] of EXTRA rows) that returns (kind, slot, block, payload)
    rows. One bucket is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = value()
        other = extra() if extra is not None else None
        for slot, rows in grouped(batches, 1):
            of = numbers()
            packets, more, total = [], [], np.zeros(0, np.int64)
            for kind, _, block, payload in rows:
                if kind in pass_kinds:
                    yield _one(kind, slot, block, payload)
                elif kind != WORDS:
                    more.append((block, payload))
                else:
                    at, words, times, digest = unpack(payload)
                    pos = np.fromiter(map(of.__getitem__, words), np.int64, len(words))
                    if len(of) > len(total):
                        total = np.concatenate([total, np.zeros(max(len(of), 2 * len(total)) - len(total), np.int64)])
                    total[pos] += times  # a block's words are distinct
                    packets.append((block, at, pos, digest))
            rows.clear()
            total = total[: len(of)]
            values = make(list(of), total) if of else []
            array = values if isinstance(values, np.ndarray) else None
            for block, at, pos, digest in packets:
                yield _one(VALUES, slot, block, pack((at, array[pos] if array is not None else joined([values[i] for i in pos.tolist()]), digest)))
            del packets, values, array, of
            if other is not None and (more or len(total)):
                for row in other(slot, total, more):
                    yield _one(*row)

    return to_buckets(rows, n).mapInArrow(run, ROW)


def _one(kind: int, slot: int, block: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([slot], pa.int32()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], schema=_ARROW)


def reassemble(rows: DataFrame, n: int, finish: Callable, schema: str, extra: int | None = None) -> DataFrame:
    """Put the VALUES of each block into its words' places. One block is held at a time.

    finish() makes a function of (block, ids, lengths, positions, values in the order of the block's words) that yields
    record batches of ``schema``; with ``extra``, a kind of rows, also of [(slot, payload)] of the block's rows of that kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = finish()
        for block, rows in grouped(batches, 2):
            ids, lengths, n_words, packed, digest = unpack(next(r[3] for r in rows if r[0] == DOCS))
            found = [unpack(r[3]) for r in rows if r[0] == VALUES]
            if any(d != digest for _, _, d in found):
                raise RuntimeError(f"block {block} has been made again of other rows: the source doesn't give a partition's rows in the same order")
            more = [[(r[1], r[3]) for r in rows if r[0] == extra]] if extra is not None else []
            rows.clear()
            if found and isinstance(found[0][1], np.ndarray):
                values = np.zeros((n_words, *found[0][1].shape[1:]), found[0][1].dtype)
                for at, v, _ in found:
                    values[np.cumsum(at, dtype=np.int64)] = v
            else:
                values = [None] * n_words
                for at, v, _ in found:
                    for i, x in zip(np.cumsum(at, dtype=np.int64).tolist(), apart(*v)):
                        values[i] = x
            found.clear()
            yield from make(block, ids, lengths, unpack_positions(packed), values, *more)

    return to_blocks(rows, n).mapInArrow(run, schema)
