"""Operator 13: periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping it. Each run has a root that is a
Lyndon word in one of two orders of the alphabet (any order of the words, and its reverse), and a Lyndon root is the longest Lyndon word
from its start on. So the two Lyndon arrays name every run's period and a place in it, and direct comparisons of words extend it to both
sides. The Lyndon array is made from right to left: the longest Lyndon word at i ends where the next smaller suffix begins, and the suffixes
to compare i with are found along the next smaller suffixes of those to its right. What has been matched is used again: how far a suffix agrees
with its next smaller one often tells how far a third agrees with it, and the stretch matched last at a distance is kept, so a comparison at
this distance that reaches its start goes on at its end. No two words are found equal twice at a distance; tests count the comparisons of
texts with many repetitions, which grow as their length. There are no suffix arrays or trees, and no hashes of stretches.

Runs with less than LEAST_PERIODS periods, or LEAST_WORDS words, aren't reported. All words of a reported run occur LEAST_PERIODS times in the
text or oftener, so rarer words cut the text, and Lyndon arrays are made of what is between them; that loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm._common import short_batches, texts

LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Words, by the contract: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def longest_lyndon(w: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place; the end of the text is smaller than any letter."""
    n = len(w)
    following, same = [n] * n, [0] * n  # the next smaller suffix, and how many letters it has in common with this one
    begins, ends = [n] * (n + 1), [0] * (n + 1)  # by distance: the last stretch x with w[x] == w[x + distance], and where it stops
    for i in range(n - 2, -1, -1):
        a, j, x = w[i], i + 1, 0  # the suffixes at i and j have x letters in common, or more
        while j < n:
            if not x:
                b = w[j]
                if b < a:
                    break
                if b > a:
                    j = following[j]
                    continue
            d = j - i
            last, y = n - d, i + x
            if y < last and w[y] == w[y + d]:
                y, known = y + 1, begins[d]
                while y < last and y < known and w[y] == w[y + d]:
                    y += 1
                if y >= known:
                    y = ends[d]
                begins[d], ends[d] = i, y
            x = y - i
            if y == last or w[y] > w[y + d]:
                break
            # The suffix at j is greater; the next one smaller than it has c letters in common with it.
            c = same[j]
            while c > x:  # they are beyond the letter that tells i from j, so it is greater as well
                j = following[j]
                c = same[j]
            j = following[j]
            if c < x:  # it is smaller than j by a letter that i shares with j
                x = c
                break
        following[i], same[i] = j, x if j < n else 0
    return [j - i for i, j in enumerate(following)]


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that can be in a run, with one number of its own between any two stretches of them, and their places."""
    numbers: dict[bytes, int] = {}
    own = np.asarray([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    often = np.bincount(own)[own] >= LEAST_PERIODS
    edges = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0])))).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= LEAST_WORDS]
    if not len(edges):
        return own[:0], own[:0]
    places = np.concatenate([np.arange(a, b + 1) for a, b in edges])
    letters = np.append(own, 0)[places]
    letters[np.cumsum(edges[:, 1] - edges[:, 0] + 1) - 1] = -1 - np.arange(len(edges))
    return letters, places


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Start, length and period of each run, by start and then period."""
    if len(words) < LEAST_WORDS:
        return []
    letters, places = _letters(words)
    n = len(letters)
    if not n:
        return []
    w = letters.tolist()
    roots = []
    for order in (w, (-letters).tolist()):
        size = np.asarray(longest_lyndon(order))
        i = np.flatnonzero(np.arange(n) + (LEAST_PERIODS - 1) * size < n)
        for k in range(1, LEAST_PERIODS):  # a reported run's first root is followed by so many equal ones
            i = i[letters[i] == letters[i + k * size[i]]]
        roots += zip(i.tolist(), size[i].tolist())
    found, covered = [], [-1] * (n + 1)
    for i, p in sorted(roots):
        if i + p <= covered[p]:
            continue
        end, start = i + p, i
        while end < n and w[end] == w[end - p]:
            end += 1
        while start > 0 and w[start - 1] == w[start - 1 + p]:
            start -= 1
        covered[p] = end - 1
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
            found.append((int(places[start]), end - start, p))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, runs, left = [], [], []
        for text in batch.column("text"):
            words = text.as_py().split()  # of bytes: at ASCII white space alone
            own = find_runs(words)
            n.append(len(words))
            runs.append([{"start": s, "length": k, "period": p} for s, k, p in own])
            left.append(b" ".join(collapse(words, own)).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(runs, _OUT.field("runs").type), pa.array(left, pa.string())], schema=_OUT)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed (the kept words, one space between) of each row.

    A null, empty or blank text has no words, no runs and collapses to the empty text. Rows stay apart whatever their ids; a null doc_id stays
    null; other columns, whatever their names, are not looked at. Nothing is shuffled: a row is read whole by one task, in time
    that grows nearly as its number of words.
    """
    short_batches(docs.sparkSession)
    rows = texts(docs).select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(_batches, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, a tenth of which (by h = crc32 of doc_id as text) have their words repeated from some word on.

    With h % 10 = 0, g = h / 10, n > 0 words, a = g % n and p = 1 + (n - a) / (3 + g % 8), the word at i >= a becomes that at a + (i - a) % p.
    A null doc_id has no h, and its text stays as it is.
    """
    own = texts(docs).withColumn("_h", F.crc32(F.col("doc_id").cast("string")))
    own = own.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    own = own.withColumns({"_a": F.when(n > 0, g % n), "_g": g}).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))

    def word(i: Column) -> Column:
        a = F.col("_a")
        return F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % F.col("_p")).cast("int"))

    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return own.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Rows of :func:`periodic_runs` with the longest run (ties: least start, then period) and digests of the runs and of what is left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.withColumn("_top", longest)
    start, length, period = -F.col("_top.start"), F.col("_top.length"), -F.col("_top.period")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
