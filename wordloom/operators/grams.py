"""Counts of runs of words, by sorted windows.

A chapter gives one row for each place: the longest run of words that begins there, with a key of hashes, those of its first ``low`` words in the upper
bits and of each further word below. Rows meet by the upper bits and are sorted by the key alone, a number, so the places of each shorter run stand
together too, and all lengths are counted in one pass over sorted rows. Places whose bits occur too rarely are left out before their words are looked
at; equal bits prove nothing, so runs are told apart by their words. A place is shuffled once, not once for each length and once more for each
chapter; a task holds a block of rows and the counts of those runs that may go on in the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import lexicon
from wordloom.functions import text as X

#: Words that are worked on at once, rows of a batch that goes back, and rows that are counted at once.
WORDS, ROWS, BLOCK = 1 << 18, 1 << 15, 1 << 16
#: What stands between words over which no run goes; texts of words are cut at blanks.
CUT = "\n"
#: Bits of a key for the first words, and for all others.
FIRST, REST = 35, 28
_WINDOW = pa.schema([("run", pa.string()), ("text", pa.string()), ("x", pa.int64()), ("key", pa.int64())])
_COUNT = pa.schema([("run", pa.string()), ("text", pa.string()), ("count", pa.int64()), ("document_count", pa.int64())])


def _array(c: pa.Array | pa.ChunkedArray, kind: pa.DataType = pa.string()) -> pa.Array:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c if c.type == kind else c.cast(kind)


def _batches(schema: pa.Schema, *columns: pa.Array) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    for k in range(0, whole.num_rows, ROWS):
        yield whole.slice(k, ROWS)


def _pieces(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Chapters of some WORDS words, whose numbers are ``sizes``."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _width(low: int, high: int) -> int:
    """Bits of a key for each word after the first."""
    return REST // max(1, high - low)


def _hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _content(forms: pa.Array, codes: pa.Array) -> np.ndarray:
    """Whether each form (column) is a content word in the language of each code (row)."""
    none = np.zeros(len(forms), bool)
    stop = [pc.is_in(forms, pa.array(lexicon.STOP_WORDS[c], pa.string())).to_numpy(zero_copy_only=False) if c in lexicon.STOP_WORDS else none for c in codes.to_pylist()]
    return ~np.array(stop, bool).reshape(len(codes), len(forms))


def _windows(low: int, high: int, min_length: int, ends: bool = False) -> Callable:
    """Takes run, code (of its language), words (with blanks between them) and total. The run of up to ``high`` words at each place where ``low`` or more are. Bit n of x: it is the first place in its chapter of its first n
    words. A row without text has a sum of words in x. With ``ends`` a run begins with a content word, and goes up to the last one it can end with."""
    width = _width(low, high)

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        runs, lists = _array(batch.column("run")), pc.split_pattern(_array(batch.column("words")), " ")
        totals = pa.table({"run": runs, "n": batch.column("total")}).group_by("run").aggregate([("n", "sum")])
        yield from _batches(_WINDOW, totals["run"], pa.nulls(totals.num_rows, pa.string()), totals["n_sum"], pa.array(np.zeros(totals.num_rows, np.int64)))
        coded = _array(lists.flatten()).dictionary_encode()
        forms, parent = coded.dictionary, pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(forms):
            gone = pc.equal(forms, CUT).to_numpy(zero_copy_only=False) | (pc.utf8_length(forms).to_numpy(zero_copy_only=False) < max(1, min_length))
            code[gone[code]] = -1
        code, parent = np.concatenate([code, np.full(high, -1)]), np.concatenate([parent, np.full(high, -1)])
        size = len(code) - high
        ok = [code[:size] >= 0]
        for k in range(1, high):
            ok.append(ok[-1] & (code[k : size + k] >= 0) & (parent[k : size + k] == parent[:size]))
        at = np.flatnonzero(ok[low - 1])
        if ends and len(at):
            coded_runs = _array(batch.column("code")).dictionary_encode()
            own_code = pc.fill_null(coded_runs.indices, len(coded_runs.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            content = np.concatenate([_content(forms, coded_runs.dictionary), np.ones((1, len(forms)), bool)])[own_code[parent], code]
            at, last = at[content[at]], np.zeros(size, np.int64)
            for k in range(low - 1, high):
                last[at[ok[k][at] & content[at + k]]] = k
            at = at[last[at] >= low - 1]
            ok = [o & (k <= last) for k, o in enumerate(ok)]
        if not len(at):
            return
        named = runs.dictionary_encode()
        x, same, rows, words, own = np.zeros(len(at), np.int64), parent[at], np.arange(len(at)), [], _hashes(forms)
        key, rest = _hashes(named.dictionary)[named.indices.to_numpy(zero_copy_only=False)[same]], np.zeros(len(at), np.uint64)
        for k in range(high):
            has = ok[k][at]
            codes = np.where(has, code[at + k], 0)
            words.append(forms.take(pa.array(codes, mask=~has)))
            if k < low:
                key = (key + own[codes]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            else:
                rest |= np.where(has, own[codes] >> np.uint64(64 - width), np.uint64(0)) << np.uint64(REST - (k + 1 - low) * width)
                same, rows = same[has[rows]], rows[has[rows]]
            if not len(same):
                continue
            # Places of equal first words in a chapter have one number, in the order in which they come.
            same = pd.factorize(same * len(forms) + code[at[rows] + k])[0].astype(np.int64)
            if k + 1 >= low:
                x[rows[np.diff(np.maximum.accumulate(same), prepend=-1) > 0]] |= 1 << (k + 1)
                # A run that a chapter has once is the first of its longer ones as well.
                more = np.bincount(same)[same] > 1
                x[rows[~more]] |= (1 << (high + 1)) - (1 << (k + 1))
                same, rows = same[more], rows[more]
        key = ((key >> np.uint64(64 - FIRST)) << np.uint64(REST) | rest).astype(np.int64)
        yield from _batches(_WINDOW, runs.take(pa.array(parent[at])), pc.binary_join_element_wise(*words, " ", null_handling="skip"), pa.array(x), pa.array(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, pc.divide(pc.binary_length(batch.column("words")), 8)):  # words are taken to have eight bytes
                yield from made(piece)

    return run


class _Sorted:
    """Counts of all runs of low to high words that windows sorted by their keys begin with."""

    def __init__(self, low: int, high: int, least: int):
        self.low, self.high, self.least = low, high, least
        self.shift = {n: REST - (n - low) * _width(low, high) for n in range(low, high + 1)}
        self.last = None  # key of the row before
        self.open = {n: {} for n in self.shift}  # counts so far of the runs of n words whose bits are those of the last row

    def add(self, runs: pa.Array, texts: pa.Array, x: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Rows whose first words' bits occur often enough, or may occur in other blocks.
        bits = key >> self.shift[self.low]
        starts = np.flatnonzero(np.diff(bits, prepend=bits[0] - 1))
        sizes = np.diff(starts, append=len(bits))
        rows = np.flatnonzero(np.repeat((sizes >= self.least) | self._shared(bits[starts], self.low, key[-1]), sizes))
        runs, texts, x, key, final = runs.take(pa.array(rows)), texts.take(pa.array(rows)), x[rows], key[rows], key[-1]
        split = pc.split_pattern(texts, " ")
        words, begin = _array(split.flatten()), split.offsets.to_numpy()
        size, begin = np.diff(begin), begin[:-1] - begin[0]
        coded = words.dictionary_encode()
        forms, code = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        same, rows = runs.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(len(rows))
        for n in range(1, self.high + 1):
            more = size[rows] >= n
            rows, same = rows[more], same[more]
            same = pd.factorize(same * forms + code[begin[rows] + n - 1])[0].astype(np.int64)
            if n < self.low:
                continue
            first = rows[np.diff(np.maximum.accumulate(same), prepend=-1) > 0]
            counts, docs = np.bincount(same), np.bincount(same, weights=x[rows] >> n & 1).astype(np.int64)
            shared = self._shared(key[first] >> self.shift[n], n, final)

            def found(which: np.ndarray, n: int = n, first: np.ndarray = first) -> tuple[pa.Array, pa.Array]:
                at = first[which]
                return runs.take(pa.array(at)), pc.binary_join_element_wise(*(words.take(pa.array(begin[at] + j)) for j in range(n)), " ")

            done = ~shared & (counts >= self.least)
            if done.any():
                yield from _batches(_COUNT, *found(done), pa.array(counts[done]), pa.array(docs[done]))
            yield from self._carried(n, final, key[first[shared]] >> self.shift[n], *(found(shared) if shared.any() else ([], [])), counts[shared], docs[shared])
            more = (shared | (counts >= self.least))[same]
            rows, same = rows[more], same[more]
        self.last = final

    def _shared(self, bits: np.ndarray, n: int, final: int) -> np.ndarray:
        """Whether runs of n words with these bits may occur in the blocks before or after as well."""
        return (bits == final >> self.shift[n]) | (self.last is not None and bits == self.last >> self.shift[n])

    def _carried(self, n: int, final: int, bits: np.ndarray, runs: pa.Array, texts: pa.Array, counts: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds the counts of shared runs of n words; those that can't go on are done."""
        before, after = self.open[n], {}
        goes_on = self.last is not None and self.last >> self.shift[n] == final >> self.shift[n]
        for own, run, text, count, doc in zip(bits, pa.array(runs, pa.string()).to_pylist(), pa.array(texts, pa.string()).to_pylist(), counts.tolist(), docs.tolist()):
            held = before if goes_on or own != final >> self.shift[n] else after
            c, d = held.get((run, text), (0, 0))
            held[run, text] = c + count, d + doc
        if not goes_on:
            self.open[n] = after
            yield from self._done(before)

    def _done(self, held: dict) -> Iterator[pa.RecordBatch]:
        found = [(*k, *c) for k, c in held.items() if c[0] >= self.least]
        if found:
            yield from _batches(_COUNT, *(pa.array(list(c), f.type) for c, f in zip(zip(*found), _COUNT)))

    def end(self) -> Iterator[pa.RecordBatch]:
        for held in self.open.values():
            yield from self._done(held)


def _counted(low: int, high: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, size = _Sorted(low, high, max(1, least)), [], 0

        def added() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held)
            held.clear()
            yield from state.add(*(_array(block[c]) for c in ("run", "text")), *(block[c].to_numpy() for c in ("x", "key")))

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("text")))
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= BLOCK:
                yield from added()
                size = 0
        if held:
            yield from added()
        yield from state.end()

    return run


def _counts_and_totals(own: DataFrame, low: int, high: int, least: int, min_length: int, ends: bool = False) -> tuple[DataFrame, DataFrame]:
    """run, text, count, document_count of runs of words; and run, total. Both read the exchange of the places, so places are made and shuffled once, and
    of the counts, which have one row for each run of words already, nothing is shuffled again."""
    words = F.array_join("words", " ", CUT).alias("words")  # one string goes to Python faster than an array
    own = own.where(F.col("run").isNotNull()).select("run", X.language_code(F.col("run")).alias("code"), words, F.greatest("total", F.lit(0)).cast("bigint").alias("total"))
    places = own.mapInArrow(_windows(low, high, min_length, ends), "run string, text string, x bigint, key bigint")
    # The join with totals asks for runs that aren't null below their exchange; asked for here, both uses of it stay equal.
    dealt = places.where(F.col("run").isNotNull()).repartition(F.shiftright("key", REST))
    counts = dealt.sortWithinPartitions("key").mapInArrow(_counted(low, high, least), "run string, text string, count bigint, document_count bigint")
    return counts, dealt.groupBy("run").agg(F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("x"))), F.lit(0)).alias("total"))


def run_counts(own: DataFrame, low: int, high: int, least: int = 1, min_length: int = 1) -> DataFrame:
    """The rows that :func:`wordloom.operators.index.counted` makes of runs of low to high words, those that occur ``least`` times or more.

    ``own`` has run, words (a chapter's; a run of words doesn't cross nulls) and total. A run with a word shorter than min_length is left out.
    """
    counts, totals = _counts_and_totals(own, low, high, least, min_length)
    none = F.lit(0).cast("bigint")
    return counts.select("*", F.lit(False).alias("is_total"), none.alias("total")).union(totals.select("run", F.lit(""), none, none, F.lit(True), "total"))


def runs_with_totals(own: DataFrame, low: int, high: int, least: int = 1, min_length: int = 1, ends: bool = False) -> DataFrame:
    """run, text, count, document_count of :func:`run_counts`, and the run's total. With ``ends`` only those with content words at both ends are counted
    in full; others may be there with smaller counts."""
    counts, totals = _counts_and_totals(own, low, high, least, min_length, ends)
    return counts.join(F.broadcast(totals), "run")  # a row a run
