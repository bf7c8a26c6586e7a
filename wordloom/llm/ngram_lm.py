"""Operator 4: language-model scores from a log-frequency Bloom filter of n-gram counts.

A trigram model. Counts of words are exact: they are joined to the documents block by block (see ``_blocks``). Pairs and
triples of words, all of them, are kept in a Bloom filter that holds level 1, 2, ... of an n-gram up to its quantised log count;
levels are probed one by one until one fails, which gives the count rounded down to a level's bound.

The filter is the model: it is filled from training documents alone, in segments by the n-gram's hash, each by the reducer of its n-grams. Where
all segments together have ``broadcast_bytes`` or less they are broadcast, and each block of documents probes them for its own n-grams,
a segment at a time. A larger filter isn't broadcast, as it grows with the corpus: there each block sends its distinct n-grams to
the segments' reducers, which probe the same segments once for each distinct n-gram and send the levels back, a byte each. Both ways
give the same levels, so the same scores. Data sent grow in proportion to the
corpus; the number of buckets with it too. Probabilities are

    p1(w)     = (c(w) + 1) / (N + V + 1)
    p2(w | v) = (q(v, w) + m2 * p1(w)) / (c(v) + m2)
    p3(w | u v) = (q(u, v, w) + m3 * p2(w | v)) / (Q(u, v) + m3)

where q is the count found, rounded down, and Q the upper bound of the level found, so that the sum over w stays at 1 or less
(but for the filter's false positives). A text begins after an end; its first word has no triple. m2 and m3 (``prior2``,
``prior3``) are pseudo-counts, chosen on training documents alone: with the model learned from those of sf0.1 whose crc32 mod 7 is neither 2 nor 3,
the documents with 3 have a log10 probability of -3.4503 a token (p1 gives -4.1748; 800 and 5 gave -3.4704, 400 and 3 -3.5027).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import _blocks as B
from wordloom.llm._common import bucket_count, free_shuffles, short_batches, source_bytes, texts, written

END = b"\n"  # no word can hold it
STATS, LEVELS, SEGMENT = 4, 5, 6
#: Bits of an n-gram's hash by which it is told, beyond those of the source's size in bytes: that two n-grams of the corpus are taken for
#: one is then far rarer than a false positive of the filter.
SPARE_BITS = 12
#: A filter up to this size is broadcast.
BROADCAST_BYTES = 32 << 20
#: Text in a block. The arrays about a block's n-grams take some thirty times as much.
BLOCK_BYTES = 12 << 20


def tokens(text: str) -> list[bytes]:
    """A-Z lower-cased, words without ASCII white space, then the end."""
    return [*text.encode().lower().split(), END]


def remainder(doc_id, m: int) -> int:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def chained(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from the hash of all but its last word and that of the last word."""
    with np.errstate(over="ignore"):
        return B.mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


class LogFrequencyFilter:
    """A segment of a Bloom filter of n-grams and levels."""

    def __init__(self, thresholds: np.ndarray, hashes: int, bits_per_entry: float):
        self.thresholds, self.hashes, self.bits_per_entry = thresholds, hashes, bits_per_entry
        self.bits = np.zeros(64, np.uint8)

    def walk(self, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bits of entries (hash and level) start, and their steps; modulo the segment's length."""
        with np.errstate(over="ignore"):
            a = B.mixed(h + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        return a, (a >> np.uint64(29)) * np.uint64(2) + np.uint64(1)

    def fill(self, h: np.ndarray, counts: np.ndarray) -> None:
        """Store n-grams and their counts of 1 or more; the segment's length follows the number of entries."""
        top = np.searchsorted(self.thresholds, counts, "right").astype(np.int8)  # levels 1..top
        m = np.uint64(max(64, int(top.sum(dtype=np.int64) * self.bits_per_entry)))
        self.bits = np.zeros(int(m), np.uint8)  # a byte a bit while it is in use: faster to fill and to probe
        level = 0
        while len(h):
            level += 1
            some = top >= level
            h, top = h[some], top[some]
            for i in range(0, len(h), 1 << 20):
                own = h[i : i + (1 << 20)]
                a, step = self.walk(own, np.full(len(own), level))
                for _ in range(self.hashes):
                    self.bits[(a % m).astype(np.int64)] = 1
                    a += step

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level found of each hash, 0 for none: levels are probed from the first on until one fails."""
        out, m = np.zeros(len(h), np.uint8), np.uint64(len(self.bits))
        for i in range(0, len(h), 1 << 20):
            alive = np.arange(i, min(len(h), i + (1 << 20)))
            for k in range(1, len(self.thresholds) + 1):
                a, step = self.walk(h[alive], np.full(len(alive), k))
                for _ in range(self.hashes):
                    hit = np.flatnonzero(self.bits[(a % m).astype(np.int64)])
                    alive, step = alive[hit], step[hit]
                    a = a[hit] + step
                if not len(alive):
                    break
                out[alive] = k
        return out


def level_bounds(base: float, most: int = 1 << 40) -> np.ndarray:
    """Least counts of the levels: 1, 2, then in steps of the base."""
    bounds, x = [1], 1.0
    while bounds[-1] < most:
        x = max(x * base, bounds[-1] + 1)
        bounds.append(int(np.ceil(x)))
    return np.asarray(bounds, np.int64)


class Grams:
    """The distinct pairs and triples of a block's tokens in the order of their hashes, which is that of the buckets too; the same
    whenever it is made of the same block.

    pos: positions of all tokens in the list of distinct words; word: these words' hashes; end: the end's position.
    """

    def __init__(self, lengths: np.ndarray, pos: np.ndarray, word: np.ndarray, end: int, buckets: int, bits: int):
        own = word[pos]
        before = np.empty_like(own)
        before[1:], before[:1] = own[:-1], word[end]  # each document ends with the end
        two = chained(before, own)
        # A triple is a pair followed by a word; the first word of a text ends none.
        self.inner = np.ones(len(pos), bool)
        self.inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        at = np.flatnonzero(self.inner)
        self.hashes, place = np.unique(np.concatenate([two, chained(two[at - 1], own[at])]) >> np.uint64(64 - bits), return_inverse=True)
        self.pair, self.triple = place[: len(pos)], place[len(pos) :]
        self.history = self.pair[at - 1]
        bounds = [-(-(s << bits) // buckets) for s in range(buckets)]
        self.ends = np.append(np.searchsorted(self.hashes, np.asarray(bounds, np.uint64)), len(self.hashes))

    def times(self, counted: np.ndarray) -> np.ndarray:
        """How often the n-grams occur among the counted tokens."""
        n = len(self.hashes)
        return np.bincount(self.pair[counted], minlength=n) + np.bincount(self.triple[counted[self.inner]], minlength=n)


def _planes(x: np.ndarray) -> list[bytes]:
    """Whole numbers from 0 as one compressed string for each of their bytes."""
    size = int(x.max() if len(x) else 0).bit_length() + 7 >> 3
    return [B.squeezed(((x >> (8 * k)) & 255).astype(np.uint8).tobytes()) for k in range(size)]


def _of_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, p in enumerate(planes):
        out |= np.frombuffer(B.expanded(p), np.uint8).astype(np.int64) << (8 * k)
    return out


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, base: float = 1.5, bits_per_entry: float = 12.0, hashes: int = 8, prior2: float = 1600.0, prior3: float = 5.0, block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Learns from the documents whose crc32(doc_id as text) mod ``folds`` isn't ``held``. Null text is empty: its only token
    is the end. A null doc_id counts as the empty text there. Repeated rows are each counted and scored; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = bucket_count(docs)
    alone = source_bytes(docs) <= broadcast_bytes  # the filter of such a source may fit; its true size is looked at before it is broadcast
    bits = min(60, max(40, source_bytes(docs).bit_length() + SPARE_BITS))
    bounds = level_bounds(base)
    trained = lambda ids: np.asarray([remainder(i, folds) != held for i in ids], bool)

    def ngrams(ids, lengths, pos, words):
        """The block's n-grams and their counts in training documents, by bucket."""
        g = Grams(lengths, pos, B.word_hash(words), words.index(END), n, bits)
        times = g.times(np.repeat(trained(ids), lengths))
        for s in np.flatnonzero(np.diff(g.ends)).tolist():
            own, n_times = g.hashes[g.ends[s] : g.ends[s + 1]].view(np.int64), times[g.ends[s] : g.ends[s + 1]]
            if alone:  # scoring doesn't need the others here
                own, n_times = own[n_times > 0], n_times[n_times > 0]
            if len(own):
                yield s, B.pack((len(own), _planes(np.diff(own, prepend=0)), _planes(n_times)))

    def value():
        return lambda words, total: np.stack([total, B.word_hash(words).view(np.int64)], axis=1)

    def reduced():
        def make(slot, total, packets):
            yield STATS, slot, -1, B.pack((int(total.sum()), int((total > 0).sum())))
            h, times, blocks = [], [], []
            for block, payload in packets:
                size, steps, counts = B.unpack(payload)
                h.append(np.cumsum(_of_planes(steps, size)).view(np.uint64))
                times.append(_of_planes(counts, size))
                blocks.append(block)
            if not h:
                return
            ends = np.cumsum([len(x) for x in h])
            own, times = np.concatenate(h), np.concatenate(times)
            h.clear()
            distinct, place = np.unique(own, return_inverse=True)
            counts = np.bincount(place, times, len(distinct)).astype(np.int64)
            segment = LogFrequencyFilter(bounds, hashes, bits_per_entry)
            segment.fill(distinct[counts > 0], counts[counts > 0])
            if alone:
                yield SEGMENT, slot, -1, B.pack((len(segment.bits), np.packbits(segment.bits)))
                return
            found = segment.levels(distinct)[place]
            for block, a, b in zip(blocks, [0, *ends.tolist()], ends.tolist()):
                yield LEVELS, slot, block, B.squeezed(found[a:b].tobytes())

        return make

    rows = B.index_blocks(texts(docs), lambda: tokens, n, block_bytes, extra=ngrams, counted=trained)
    kept, _ = written(B.valued(rows, n, value, extra=reduced), "lm", "kind")
    del rows
    free_shuffles(spark)
    kept = kept.select("kind", "slot", "block", "payload")
    segments = None
    if alone:
        model = kept.where(F.col("kind") == SEGMENT)
        if (model.agg(F.sum(F.length("payload"))).first()[0] or 0) > broadcast_bytes:
            return lm_scores(docs, folds, held, base, bits_per_entry, hashes, prior2, prior3, block_bytes, -1)
        segments = spark.sparkContext.broadcast({r["slot"]: bytes(r["payload"]) for r in model.collect()})  # broadcast_bytes at most
    stats = [B.unpack(bytes(r["payload"])) for r in kept.where(F.col("kind") == STATS).select("payload").collect()]  # two numbers a bucket
    n_train, n_words = sum(s[0] for s in stats), sum(s[1] for s in stats)
    levels = None if segments is None else _broadcast_levels(segments, lambda: LogFrequencyFilter(bounds, hashes, bits_per_entry))
    finish = _scoring(bounds, n_train + n_words + 1, prior2, prior3, n, bits, levels)
    scored = B.reassemble(kept.where(~F.col("kind").isin(STATS, SEGMENT)), n, finish, SCORES, extra=LEVELS)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def token_scores(c: np.ndarray, cv: np.ndarray, q2: np.ndarray, q3: np.ndarray, up: np.ndarray, size: int, prior2: float, prior3: float) -> np.ndarray:
    """log10 probabilities from c(w), c(v), q(v, w), q(u, v, w) and Q(u, v); Q is 0 where the history is unseen."""
    p1 = (c + 1) / size
    p2 = (q2 + prior2 * p1) / (cv + prior2)
    return np.log10((np.minimum(q3, up) + prior3 * p2) / (up + prior3))


def _sent_levels(g: Grams, sent: list) -> np.ndarray:
    """Levels of a block's n-grams as the segments' reducers have sent them."""
    level = np.zeros(len(g.hashes), np.uint8)
    for slot, payload in sent:
        level[g.ends[slot] : g.ends[slot + 1]] = np.frombuffer(B.expanded(payload), np.uint8)
    return level


def _broadcast_levels(segments, make: Callable[[], LogFrequencyFilter]) -> Callable[[Grams, list], np.ndarray]:
    """Levels of a block's n-grams, probed in the segments that have been broadcast."""

    def levels(g: Grams, _: list) -> np.ndarray:
        level = np.zeros(len(g.hashes), np.uint8)
        for slot in np.flatnonzero(np.diff(g.ends)).tolist():
            if slot in segments.value:
                segment = make()
                size, packed = B.unpack(segments.value[slot])
                segment.bits = np.unpackbits(packed, count=size)
                level[g.ends[slot] : g.ends[slot + 1]] = segment.levels(g.hashes[g.ends[slot] : g.ends[slot + 1]])
        return level

    return levels


def _scoring(bounds: np.ndarray, size: int, prior2: float, prior3: float, buckets: int, bits: int, levels: Callable | None = None):
    """Scores of a block's documents from its words' counts and the levels of its n-grams."""
    levels = levels or _sent_levels
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    schema = pa.schema(list(zip(names, [pa.int64()] * 3 + [pa.float64()] * 2)))
    least = np.concatenate([[0], bounds])
    most = np.concatenate([[0], bounds[1:] - 1, [np.iinfo(np.int64).max]])

    def finish():
        def make(_, ids, lengths, pos, values, sent) -> Iterator[pa.RecordBatch]:
            count, word = values[:, 0], np.ascontiguousarray(values[:, 1]).view(np.uint64)
            g = Grams(lengths, pos, word, int(pos[lengths[0] - 1]), buckets, bits)
            level = levels(g, sent)
            ends = np.cumsum(lengths)
            c = count[pos]
            cv = np.empty_like(c)
            cv[1:], cv[0] = c[:-1], c[ends[0] - 1]
            q2 = np.minimum(least[level[g.pair]], np.minimum(c, cv))
            q3, up = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            q3[g.inner], up[g.inner] = least[level[g.triple]], most[level[g.history]]
            up[1:] = np.minimum(up[1:], cv[:-1])  # a pair is no commoner than its words
            up = np.minimum(up, cv)
            score = token_scores(c, cv, q2, np.minimum(q3, q2), up, size, prior2, prior3)
            first = ends - lengths
            sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), np.log10((c + 1) / size), score)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), *map(pa.array, sums)], schema=schema)

        return make

    return finish
