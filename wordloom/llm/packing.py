"""Operator 1: best-fit-decreasing packing with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so documents of a length, and bins of a remaining capacity, are alike. The
plan therefore comes from the histogram of lengths (at most ``capacity`` rows, whatever the data): for each length, in
falling order, the segment tree finds the tightest open class of bins in logarithmic time, and all bins of the class are
filled as one document after another would fill them. It is written down as runs (ranks of a length to bins), and each
document finds its place by its rank among those of its length. Ranks are counted by length and salt, so a length that
a third of the documents share is still counted by many tasks.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm._common import short_batches, shuffle_width, texts, written

#: Distinct words whose ids a worker keeps.
WORDS_KEPT = 300_000


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters.update((b, chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in letters))
    return letters


class FastMerges:
    """The tokenizer's merges as byte ranks for tiktoken, which encodes many words in a call.

    A word end is a zero byte that the word's last byte takes up before any other merge. Fits tokenizers that compose (NFC),
    squeeze white space, lower-case and split by PIECES; for others usable is False.
    """

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.usable = model.get("end_of_word_suffix") == "</w>" and kinds == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": self.PIECES}
        if not self.usable:
            return
        letters, vocabulary = byte_letters(), model["vocab"]
        of = {c: b for b, c in letters.items()}

        def raw(token: str) -> bytes:
            end = token.endswith("</w>") and token != "</w>"
            return bytes(of[c] for c in (token[:-4] if end else token)) + b"\0" * end

        ids = np.zeros(512 + len(model["merges"]), np.uint32)
        ranks = {}
        for b, c in letters.items():
            ranks[bytes([b])], ranks[bytes([b, 0])] = b, 256 + b
            ids[b], ids[256 + b] = vocabulary[c], vocabulary[c + "</w>"]
        for k, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if ranks.setdefault(raw(left) + raw(right), 512 + k) == 512 + k:
                ids[512 + k] = vocabulary[left + right]
        self.ids, self.end = ids, 256 + ord("\n")
        self.split = regex.compile(self.PIECES + r"|\n").findall
        self.ordinary = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin-1 letters without zeros, which NFC leaves alone and lower() maps one to one."""
        found = self.split("\n".join(words).lower() + "\n")
        ranks = np.asarray(self.ordinary("\0".join(found) + "\0"), np.int64)
        ends = np.flatnonzero(ranks == self.end)
        data, ends = self.ids[ranks].tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]


class WordEncoder:
    """Ids of a tokenizer that drops white space and marks word ends: words are encoded apart, distinct ones once in a while.

    Texts that hold a part of an added token (such as <|endoftext|>) as it is written are encoded whole by the library, which cuts them
    at added tokens before anything else.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # What any text with an added token must hold; only those of two or more plain ASCII characters at the start can be told so.
        self.marks = sorted({a[:2] for a in added})
        self.fast = FastMerges(path)
        self.fast.usable = self.fast.usable and all(len(m) == 2 and m.isascii() and not m.isalnum() for m in self.marks)
        self.odd = re.compile("[\x1c-\x1f]").search
        self.other = re.compile("[^\x01-\xff]").search
        self.apart = regex.compile(r"[^\s]+").findall
        self.kept: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Maximal runs without Unicode white space. (split() would also cut at the four separators U+001C to U+001F.)"""
        return self.apart(text) if self.odd(text) else text.split()

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            if not self.fast.usable or self.other("".join(some)):
                slow = [w for w in some if not self.fast.usable or self.other(w)]
                for w, e in zip(slow, self.tokenizer.encode_batch(slow, add_special_tokens=False)):
                    self.kept[w] = np.asarray(e.ids, np.uint32).tobytes()
                some = [w for w in some if w not in self.kept]
            if some:
                self.kept.update(zip(some, self.fast.encode(some)))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(m in t for m in self.marks)}
        split = [[] if i in whole else self.words(t) for i, t in enumerate(texts)]
        if len(self.kept) > WORDS_KEPT:
            self.kept.clear()
        new = set().union(*split).difference(self.kept)
        if new:
            self.learn(list(new))
        get = self.kept.__getitem__
        ids = [b"".join(map(get, words)) for words in split]
        for i in whole:
            ids[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32).tobytes()
        return ids


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit) of each document, followed by end_id.

    Only documents longer than the capacity are cut. Null and empty texts give one piece, of the end alone. Null and
    repeated doc_ids are kept, each row on its own; other columns are ignored; an empty table gives no pieces.
    """
    short_batches(docs.sparkSession, 200)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    end = np.asarray([end_id], np.uint32).tobytes()
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                rows += [(doc_id, k, at // 4, min(size, len(ids) - at) // 4, ids[at : at + size]) for k, at in enumerate(range(0, len(ids), size))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


class OpenBins:
    """Counts of open bins by remaining capacity, in a segment tree, and the bins of each class as runs of numbers."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, deque[list[int]]] = {}

    def add(self, remaining: int, first: int, n: int) -> None:
        self.runs.setdefault(remaining, deque()).append([first, n])
        self._change(remaining, n)

    def _change(self, at: int, n: int) -> None:
        at += self.leaves
        while at:
            self.tree[at] += n
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds ``length``."""
        at = length + self.leaves
        if self.tree[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.tree[2 * at])
                return at - self.leaves
            at //= 2
        return None

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of a class, numbered in a row."""
        run = self.runs[remaining][0]
        first, n = run[0], min(run[1], most)
        run[0] += n
        run[1] -= n
        if not run[1]:
            self.runs[remaining].popleft()
        self._change(remaining, -n)
        return first, n


def plan_runs(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where best-fit decreasing puts documents, by length and rank among those of the length: each row sends
    ranks rank, rank + 1, ... of a length, up to the next row's, to sequences sequence, sequence + 1, ... at offset."""
    bins, made, rows = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            fresh = room is None
            if fresh:
                room = capacity
            each = room // length  # a bin that took one of them stays the tightest until it is full
            want = max(1, left // each)
            if fresh:
                first, n = made, want
                made += n
            else:
                first, n = bins.take(room, want)
            each = min(each, left)
            for k in range(each):
                rows.append((length, rank, first, capacity - room + k * length))
                rank += n
            left -= n * each
            bins.add(room - each * length, first, n)
    cols = np.asarray(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (cols[:, 0] << 44) | cols[:, 1], "rank": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3]}


def best_fit_pack(items: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` with sequence_id and offset, both bigint: place of each in a sequence of at most ``capacity``.

    Null lengths, lengths under 1 and those over the capacity get nulls. Columns named sequence_id or offset are replaced, and must
    not be the length or the order. Items equal in ``order`` are placed in any order. ``items`` is read twice: pass a written table.
    """
    items = items.drop("sequence_id", "offset")
    spark = items.sparkSession
    salts = shuffle_width(spark)
    own = items.withColumn("__pack_len", F.col(length).cast("bigint"))
    own = own.withColumn("__pack_len", F.when(F.col("__pack_len").between(1, capacity), F.col("__pack_len")))
    own = own.withColumn("__pack_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = own.where("__pack_len is not null").groupBy("__pack_len", "__pack_salt").agg(F.count("*").alias("__pack_n"))
    histogram = {r["__pack_len"]: r["n"] for r in counts.groupBy("__pack_len").agg(F.sum("__pack_n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(plan_runs(histogram, capacity))

    by_length = Window.partitionBy("__pack_len").orderBy("__pack_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__pack_len", "__pack_salt", F.coalesce(F.sum("__pack_n").over(by_length), F.lit(0)).alias("__pack_before"))
    ranked = own.withColumn("__pack_rank", F.row_number().over(Window.partitionBy("__pack_len", "__pack_salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["__pack_len", "__pack_salt"], "left")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        p = plan.value
        rank = ranks.to_numpy(np.int64)
        run = np.searchsorted(p["key"], (lengths.to_numpy(np.int64) << 44) | rank, "right") - 1
        return pd.DataFrame({"sequence_id": p["sequence"][run] + rank - p["rank"][run], "offset": p["offset"][run]})

    fits = F.col("__pack_len").isNotNull()
    if not histogram:
        return items.withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    shortest = min(histogram)
    placed = ranked.withColumn("__pack_at", place(F.coalesce("__pack_len", F.lit(shortest)), F.when(fits, F.col("__pack_rank") + F.col("__pack_before")).otherwise(0).cast("bigint")))
    return placed.select(*items.columns, F.when(fits, F.col("__pack_at.sequence_id")).alias("sequence_id"), F.when(fits, F.col("__pack_at.offset")).alias("offset"))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with ids_crc32, sequence_id and offset. The ids are written once, to the shared folder."""
    made = token_pieces(docs, tokenizer_path, capacity, end_id).withColumn("place", F.monotonically_increasing_id())
    pieces, _ = written(made, "pieces")  # with its place, a piece is told from equal ones
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "place")
    return best_fit_pack(slim, capacity, order=("doc_id", "piece", "place")).drop("place")
