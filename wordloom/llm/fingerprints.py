"""Operator 7: document fingerprints by consistent weighted sampling.

A document's terms are its words (A-Z lower-cased, cut at ASCII white space), weighted by their counts. For term k and
sample s, r and c are Gamma(2, 1) and beta is uniform, all derived from (64-bit hash of k, s) alone; with

    t = floor(ln w / r + beta),   ln a = ln c - r * (t - beta) - r

the sample is the (k, t) of the least a (Ioffe, ICDM 2010), so two documents agree in a sample with a probability equal to
their generalised Jaccard similarity, sum of min weights over sum of max weights. A sample is written as 16 bits, a hash of
(k, t); different samples agree by chance once in 65,536.

Each worker keeps the samples' ``ln a`` of the (term, weight) pairs it met last, ``KEPT_CELLS`` numbers at most; a pair that
isn't there is drawn again from its hash. So the vocabulary has no bound, and a document of any length takes bounded memory.

Documents come in descending order of doc_id (nulls last, then by a hash of the text, then by their place in the source):
ranges of this order are sorted apart. The ranges begin at rows drawn from the table; each range's first row is also sent to
the range before it, so every document meets its successor with one shuffle. Null or repeated ids are split like others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm._blocks import mixed
from wordloom.llm._common import short_batches, shuffle_width, texts

#: Numbers that a worker keeps: 128 MB.
KEPT_CELLS = 1 << 24
#: Rows drawn for each range of documents, from which the ranges' beginnings are taken.
DRAWN = 64
_SAMPLERS: dict = {}
_CODE = np.int64(0xFFFF)
_ODD = [np.uint32(2 * int(x) + 1) for x in mixed(np.arange(101, 109, dtype=np.uint64)) >> np.uint64(33)]
_STEPS = ((np.uint32(16), np.uint32(0x85EBCA6B)), (np.uint32(13), np.uint32(0xC2B2AE35)))


class Sampler:
    """Draws ``samples`` consistent weighted samples of a document."""

    def __init__(self, samples: int):
        self.samples, self.most = samples, max(256, KEPT_CELLS // samples)
        self.kept: dict[tuple[bytes, int], int] = {}
        self.table, self.hits = np.empty((self.most, samples)), np.zeros(self.most, np.int32)
        self.key = mixed(np.arange(1, 5 * samples + 1, dtype=np.uint64)).astype(np.uint32).reshape(5, samples)

    @classmethod
    def get(cls, samples: int) -> Sampler:
        """One for each worker process."""
        if samples not in _SAMPLERS:
            _SAMPLERS[samples] = cls(samples)
        return _SAMPLERS[samples]

    def drawn(self, pairs: list[tuple[bytes, int]]) -> np.ndarray:
        """``ln a`` of each pair of a term and its weight, a column for each sample; the last 16 bits are the sample's code."""
        term = np.fromiter((xxhash.xxh3_64_intdigest(k) for k, _ in pairs), np.uint64, len(pairs))
        log_w = np.log(np.fromiter((w for _, w in pairs), np.float32, len(pairs)))[:, None]
        low, high = term.astype(np.uint32)[:, None], (term >> np.uint64(32)).astype(np.uint32)[:, None]

        def bits(k: int) -> np.ndarray:
            """32 bits of each term and sample; each k mixes both halves of the term's hash in its own way."""
            x = (low + high * _ODD[k]) ^ self.key[k]
            for shift, factor in _STEPS:
                x ^= x >> shift
                x *= factor
            x ^= x >> np.uint32(16)
            return x

        def uniform(k: int) -> np.ndarray:
            """A number between 0 and 1."""
            x = (bits(k) >> np.uint32(8)).astype(np.float32)
            x += np.float32(0.5)
            x *= np.float32(2.0**-24)
            return x

        r = -np.log(uniform(0) * uniform(1))
        a = np.log(-np.log(uniform(2) * uniform(3)))
        own = bits(4)
        beta = (own >> np.uint32(8)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        a -= r * (t - beta + np.float32(1))
        code = own * _ODD[5] + (low ^ t.astype(np.int32).view(np.uint32) * _ODD[6])
        code = ((code ^ code >> np.uint32(15)) * _ODD[7]) >> np.uint32(16)
        return ((a.astype(np.float64).view(np.int64) & ~_CODE) | code.astype(np.int64)).view(np.float64)

    def _forget(self) -> None:
        """Keep the pairs met again since the last time, if they leave room."""
        again = [p for p, k in self.kept.items() if self.hits[k] > 1]
        if 2 * len(again) > self.most:
            again = []
        at = [self.kept[p] for p in again]
        self.table[: len(at)] = self.table[at]
        self.hits[: len(at)] = self.hits[at] // 2
        self.hits[len(at) :] = 0
        self.kept = dict(zip(again, range(len(again))))

    def rows(self, pairs: list[tuple[bytes, int]]) -> np.ndarray:
        """Where the table has the pairs, half as many as it has rows at most."""
        found = list(map(self.kept.get, pairs))
        if None in found:
            new = [p for p, k in zip(pairs, found) if k is None]
            if len(self.kept) + len(new) > self.most:
                self._forget()
                new = [p for p in pairs if p not in self.kept]
            for i in range(0, len(new), 256):
                some, first = new[i : i + 256], len(self.kept)
                self.table[first : first + len(some)] = self.drawn(some)
                self.kept.update(zip(some, range(first, first + len(some))))
            found = list(map(self.kept.get, pairs))
        at = np.asarray(found, np.int64)
        self.hits[at] += 1
        return at

    def codes(self, text: str) -> np.ndarray:
        """The samples as 16-bit numbers; all zero for a text without words."""
        terms = list(Counter(text.encode().lower().split()).items())
        if not terms:
            return np.zeros(self.samples, np.uint16)
        best = np.full(self.samples, np.inf)
        step = min(self.most // 2, 4096)
        for i in range(0, len(terms), step):
            best = np.minimum(best, self.table[self.rows(terms[i : i + step])].min(axis=0))
        return (best.view(np.int64) & _CODE).astype(np.uint16)


def hexed(codes: np.ndarray) -> str:
    return codes.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the generalised Jaccard similarity of the documents of two fingerprints."""
    return float(np.count_nonzero(a == b)) / len(a)


def fingerprints(docs: DataFrame, samples: int = 128) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of each row. Null text: empty. Other columns are ignored."""
    short_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler.get(samples)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hexed(sampler.codes(t or "")) for t in batch.column(1).to_pylist()], pa.string())], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, text, span, ahead: rows dealt into ranges of the order (spans), each sorted; a row with ``ahead`` is the
    head of the following span (of the first span after the last), at the end of this one.

    The order is that of (doc_id is null, doc_id falling, hash of the text, hash of the place in the source). The source must
    give a partition's rows in the same order again, as file scans do.
    """
    spark = docs.sparkSession
    n = shuffle_width(spark)
    own = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    # ~doc_id falls as doc_id rises, without overflow.
    rank = F.coalesce(F.bitwise_not("doc_id"), F.lit(0))
    order = [F.col("doc_id").isNull().cast("bigint"), rank, F.xxhash64("text"), F.xxhash64(F.monotonically_increasing_id(), F.lit(7))]
    own = own.select("doc_id", "text", *(c.alias(f"k{i}") for i, c in enumerate(order)))
    key = F.struct("k0", "k1", "k2", "k3")
    total = own.select("doc_id").count()
    share = min(1.0, DRAWN * n / max(1, total))
    some = own.where(F.pmod(F.xxhash64("k3", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    draw = sorted(tuple(r[0]) for r in some.select(key).collect())  # about DRAWN rows a range, whatever the table
    edges = sorted({draw[i * len(draw) // n] for i in range(1, n)}) if draw else []
    first = own.agg(F.min(key)).collect()[0][0]
    if first is not None and edges[:1] == [tuple(first)]:
        edges = edges[1:]
    heads = {edge: k for k, edge in enumerate(edges)}  # the head of span k + 1 also goes to span k
    if first is not None:
        heads[tuple(first)] = len(edges)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["span", "ahead", "doc_id", "text", "k2", "k3"]
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(2, 6))))
            rows = [batch.column(k) for k in (0, 1, 4, 5)]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(edges, k) for k in keys], pa.int32()), pa.array([False] * len(keys)), *rows], names=names)
            if at := [(i, heads[k]) for i, k in enumerate(keys) if k in heads]:
                rows = [c.take(pa.array([i for i, _ in at])) for c in rows]
                yield pa.RecordBatch.from_arrays([pa.array([s for _, s in at], pa.int32()), pa.array([True] * len(at)), *rows], names=names)

    spread = own.mapInArrow(dealt, "span int, ahead boolean, doc_id bigint, text string, k2 bigint, k3 bigint")
    return spread.repartitionById(len(edges) + 1, F.col("span")).sortWithinPartitions("span", "ahead", F.col("doc_id").desc_nulls_last(), "k2", "k3")


def edit_likeness(docs: DataFrame, samples: int = 128) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last floor(n_chars / 3) code points are the first ones
    of the next document, and their likenesses: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Null text is empty. Null doc_ids come last and repeated ones one after the other, in the order of a hash of the text
    and, for equal texts, of their place. A table of one row follows itself. Other columns are ignored; an empty table gives
    an empty result.
    """
    short_batches(docs.sparkSession, 200)
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler.get(samples)
        held, out = None, []
        for batch in batches:
            for span, ahead, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                codes = sampler.codes(text)
                if held is not None and held[0] == span:
                    _, own_id, own, own_codes = held
                    k = len(own) // 3
                    edited = own[: len(own) - k] + text[:k]
                    edited_codes = own_codes if edited == own else sampler.codes(edited)
                    out.append((own_id, len(own), edited, hexed(own_codes), hexed(edited_codes), likeness(own_codes, edited_codes), likeness(own_codes, codes)))
                held = None if ahead else (span, doc_id, text, codes)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=schema)
                out = []

    return successors(docs).select("span", "ahead", "doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
