"""Operator 5: removal of repeated content-defined line chunks.

A text is cut into lines, at line breaks and after sentence ends (a long line is many sentences). A line of over ``LONG``
words is cut further where a rolling hash over its words says so, or over its characters where there are no blanks.

A rolling hash over the hashes of each two neighbouring lines chooses the boundaries of chunks: of the two windows in any three lines, that of the
smaller hash. A chunk begins at each line and ends with the window chosen of it and the two lines after it; and one ends at each line and
begins with the window chosen of it and the two lines before it. So a chunk has two or three lines, or as many more as it takes to
have ``min_words`` words, and depends on lines beside it at most where it has two. Chunks overlap; those of a passage of three lines or
more are the same wherever it stands, and cover it whole. A line alone is no chunk: it stays, however often it occurs, unless it is long
and so cut into several.

Of each chunk that occurs more than once, the first occurrence (least doc_id, nulls last, then place) stays and the lines of the others are
removed; so the first occurrence of each line stays too. White space between lines doesn't count.

1. The distinct lines of a block of documents go, with their bytes, to the bucket of their hash, where equal bytes meet. Lines
   that occur more than once get a number of their own.
2. Chunks all of whose lines have one are sent, as these numbers, to the bucket of their hash, where equal chunks meet.
3. What is to be removed goes back to the blocks.

Lines and chunks are sent once for each block of documents, so one that a third of the documents share is sent once a block.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm import _blocks as B
from wordloom.llm._common import bucket_count, drop_folder, free_shuffles, short_batches, written

_STOPS, _WIDE, _OTHER, _BREAKS = ".!?", "。！？｡．", "؟۔।॥។။។", r"\n\r\v\f\x85\u2028\u2029"
#: A sentence's end with the blanks after it, or a line break. It begins with one class of characters, which is quick to search for.
LINE_ENDS = re.compile(
    rf"[{_STOPS}{_WIDE}{_OTHER}{_BREAKS}](?:(?<=[{_STOPS}])[{_STOPS}]*[\"')\]’”»]*[ \t\xa0\u3000]+"
    rf"|(?<=[{_WIDE}])[{_WIDE}]*[」』）”’]*\s*|(?<=[{_OTHER}])[{_OTHER}]*\s*|(?<=[{_BREAKS}])\s*)"
)
#: Characters of scripts written without blanks: two count as a word.
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
NO_BLANKS = re.compile(f"[{UNSPACED}]")
#: What a long line is cut between: words, but single characters of unspaced scripts and of strings of over 40 characters.
ATOMS = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,40}}+(?![^\s{UNSPACED}])|\S")
LONG = 24  # words, with single blanks between, in a line that is cut further
PIECE = 4  # atoms in a piece of a long line, about
CHARS = 8  # so many characters count as a word, if there are fewer words
LAST = np.iinfo(np.int64).max  # where null doc_ids stand
#: A repeated line's number is its bucket's and BITS of its own, SIZE bytes in all.
BITS, SIZE = 28, 6


def has_unspaced(text: str) -> bool:
    return not text.isascii() and NO_BLANKS.search(text) is not None


def lines(text: str) -> list[tuple[int, str]]:
    """Start and text of each line, without white space around it; blank lines are left out."""
    starts, found, _ = lines_of([text])
    return list(zip(starts, found))


def lines_of(texts: list[str]) -> tuple[list[int], list[str], list[int]]:
    """Starts and texts of the lines of all texts, and where each text's lines begin, and the end. Long lines are cut all together."""
    starts: list[int] = []
    found: list[str] = []
    begin = [0]
    long: list[tuple[int, list[str]]] = []  # places of long lines, and their words
    for text in texts:
        ends = [m.end() for m in LINE_ENDS.finditer(text)]
        own = [0, *ends]
        raw = [text[a:b] for a, b in zip(own, ends)]
        raw.append(text[own[-1] :])
        cut = list(map(str.strip, raw))
        if "" in cut:  # blank lines
            some = [k for k, x in enumerate(cut) if x]
            own, raw, cut = [own[k] for k in some], [raw[k] for k in some], [cut[k] for k in some]
        if any(map(str.isspace, [x[0] for x in raw])):  # lines that begin with blanks
            own = [a + len(x) - len(x.lstrip()) for a, x in zip(own, raw)]
        wide = has_unspaced(text)
        for k, n in enumerate(map(len, cut), len(found)):
            if n > 2 * LONG or wide and n > LONG:
                line = cut[k - len(found)]
                unspaced = wide and has_unspaced(line)
                if line.count(" ") >= LONG or n >= (LONG + 1) * CHARS or unspaced and weights([line])[0] > LONG:
                    long.append((k, line.split()))
        starts += own
        found += cut
        begin.append(len(found))
    if not long:
        return starts, found, begin
    all_starts: list[int] = []
    all_found: list[str] = []
    done, more, added = 0, [0], 0
    for (at, _), cuts in zip(long, pieces([(found[at], words) for at, words in long])):
        all_starts += starts[done:at]
        all_found += found[done:at]
        start, line, done = starts[at], found[at], at + 1
        all_starts += [start + i for i, _ in cuts]
        all_found += [line[i:j] for i, j in cuts]
        added += len(cuts) - 1
        more.append(added)
    before = np.searchsorted([at for at, _ in long], begin)
    return all_starts + starts[done:], all_found + found[done:], (np.asarray(begin) + np.asarray(more)[before]).tolist()


def pieces(long: list[tuple[str, list[str]]]) -> list[list[tuple[int, int]]]:
    """Start and end of the pieces of long lines, given with their words: a hash of two neighbouring atoms says whether the second ends
    a piece."""
    if not long:
        return []
    n = np.fromiter((len(words) for _, words in long), np.int64, len(long))
    atoms = [w for _, words in long for w in words]
    size = np.fromiter(map(len, atoms), np.int64, len(atoms))
    first = np.cumsum(n) - n
    start = np.cumsum(size + 1) - size - 1
    start -= np.repeat(start[first], n)
    # Words with one blank between any two; in other lines atoms are looked for one by one.
    plain = (np.add.reduceat(size, first) + n - 1 == [len(line) for line, _ in long]) & (np.maximum.reduceat(size, first) <= 40)
    plain &= [not has_unspaced(line) for line, _ in long]
    if not plain.all():
        of = [(atoms[i : i + k], size[i : i + k], start[i : i + k]) for i, k in zip(first.tolist(), n.tolist())]
        for i in np.flatnonzero(~plain).tolist():
            line = long[i][0]
            spans = np.asarray([m.span() for m in ATOMS.finditer(line)])
            of[i] = ([line[a:b] for a, b in spans.tolist()], spans[:, 1] - spans[:, 0], spans[:, 0])
        atoms, size, start = [w for x, _, _ in of for w in x], np.concatenate([x for _, x, _ in of]), np.concatenate([x for _, _, x in of])
        n = np.asarray([len(x) for x, _, _ in of])
    h = B.word_hash(atoms)
    end = np.cumsum(n)
    mixed = h.copy()
    mixed[1:] += h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    mixed[end[:-1]] = h[end[:-1]]  # a line's first atom has none before it
    last = (mixed >> np.uint64(40)) & np.uint64(0xFFFF) < 0x10000 // PIECE
    last[end - 1] = True
    to = np.flatnonzero(last)
    spans = list(zip(start[np.concatenate([[0], to[:-1] + 1])].tolist(), (start[to] + size[to]).tolist()))
    ends = np.searchsorted(to, end).tolist()
    return [spans[i:j] for i, j in zip([0, *ends], ends)]


def weights(found: list[str]) -> np.ndarray:
    """What each line counts for the least number of words, by its words (between ASCII white space) or by its characters: 1 at least."""
    data = np.frombuffer("\n".join(found).encode("utf-8", "surrogatepass"), np.uint8)  # no line holds a line break
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13))])
    ends = np.append(np.flatnonzero(data == 10), len(data))
    words = np.diff(np.searchsorted(np.flatnonzero(~blank[1:] & blank[:-1]), ends), prepend=0)
    wide = np.flatnonzero(data >= 0xE0)  # scripts without blanks are beyond the alphabets of two bytes
    if len(wide):
        for i in B.distinct(np.searchsorted(ends, wide)).tolist():
            words[i] += len(NO_BLANKS.findall(found[i])) // 2
    return np.maximum(words, np.fromiter(map(len, found), np.int64, len(found)) // CHARS)


def boundaries(line_hash: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether of the two windows in the three lines from each line on the second has the smaller hash; begin: where each text's lines begin, and
    the end."""
    n = len(line_hash)
    second = np.zeros(n, bool)
    if n > 2:
        window = B.mixed(line_hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + line_hash[1:])
        second[:-2] = window[1:] < window[:-1]
        for back in (1, 2):  # three lines of one text
            at = begin - back
            second[at[(at >= 0) & (begin <= n)]] = False
    return second


def runs(weight: np.ndarray, begin: np.ndarray, second: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the chunks, in order. begin: where each text's lines begin, and the end; second: of :func:`boundaries`; least:
    what a chunk weighs."""
    n = len(weight)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
    i, per = np.arange(n), np.diff(begin)
    low, high = np.repeat(begin[:-1], per), np.repeat(begin[1:], per)
    last = np.maximum(np.searchsorted(total[1:], total[:-1] + least), i + 1 + second)
    first = np.concatenate([[-1], i[:-1]])
    first[2:] -= ~second[:-2] & (low[2:] <= i[:-2])
    first = np.minimum(np.searchsorted(total[:-1], total[1:] - least, "right") - 1, first)
    ahead, back = last < high, first >= low
    both = B.distinct(np.concatenate([i[ahead] * (n + 1) + last[ahead], first[back] * (n + 1) + i[back]]))
    return both // (n + 1), both % (n + 1)


def first_of(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where the least keys of each group 0, 1, ... stand."""
    order = np.lexsort((*keys[::-1], group))
    return order[np.searchsorted(group[order], np.arange(int(group.max()) + 1))]


def chunks(text: str, min_words: int = 10) -> list[tuple[int, int]]:
    """Start and end of the text's chunks that may be removed, in order; they overlap."""
    own = lines(text)
    found, begin = [x for _, x in own], np.asarray([0, len(own)])
    first, last = runs(weights(found), begin, boundaries(B.word_hash(found), begin), min_words)
    return [(own[i][0], own[j][0] + len(own[j][1])) for i, j in zip(first.tolist(), last.tolist())]


def dedup_lines(docs: DataFrame, min_words: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of docs, with text without the repeated chunks, n_chars of the new text if there is such a column, and
    n_chunks, n_removed, removed_chars.

    Null texts stay null, empty ones empty. Repeated rows are documents of their own: the later row loses its repeated
    chunks. doc_ids of other types than whole numbers keep their type; for the order of documents they are cast to bigint, and
    those that can't be come last. Columns named n_chunks, n_removed or removed_chars are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = bucket_count(docs)
    own = docs.drop("n_chunks", "n_removed", "removed_chars")
    names = own.columns
    at_text = names.index("text")
    at_chars = names.index("n_chars") if "n_chars" in names else None
    shape = T.StructType([*own.schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_chunks", "n_removed", "removed_chars")]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def dealt(key: int, kind: int, words: list, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Distinct words of a block, and columns about them, by bucket."""
        slot = (B.mixed(B.word_hash(words) ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(n)).astype(np.int64)
        for s, at in B.by_slot(slot):
            yield B._one(kind, s, key, B.pack((B.steps(at), [words[k] for k in at.tolist()], *(c[at] for c in columns))))

    def home(key: int) -> int:
        return int(B.mixed(np.asarray([key], np.uint64))[0] % np.uint64(n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        rows, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            key = (part << 24) | done
            gc.disable()  # the many small objects made here hold no cycles
            starts, found, begin = lines_of([row[at_text] or "" for row, _ in rows])
            of = B.numbers()
            seq = np.fromiter(map(of.__getitem__, found), np.int64, len(found))
            words, begin = list(of), np.asarray(begin)
            gc.enable()
            weight = weights(words)
            second = boundaries(B.word_hash(words)[seq], begin)
            first, _ = runs(weight[seq], begin, second, min_words)
            starts, sizes = np.asarray(starts, np.int64), np.fromiter(map(len, words), np.int64, len(words))[seq]
            gaps = starts.copy()  # what stands before a line: little, so it takes little room
            gaps[1:] -= starts[:-1] + sizes[:-1]
            heads = begin[:-1][np.diff(begin) > 0]
            gaps[heads] = starts[heads]
            new = np.concatenate([[True], seq[1:] > np.maximum.accumulate(seq)[:-1]])[: len(seq)]  # lines seen first here are in order
            n_chunks = np.diff(np.searchsorted(first, begin))
            ids = np.asarray([LAST if i is None else i for _, i in rows], np.int64)
            yield B._one(B.DOCS, home(key), key, B.pack(([row for row, _ in rows], B.smallest(gaps), B.smallest(sizes), begin, B.smallest(n_chunks))))
            yield B._one(B.EXTRA, home(key), key, B.pack((np.packbits(new), B.smallest(seq[~new]), B.smallest(weight), np.packbits(second), begin, ids)))
            yield from dealt(key, B.WORDS, words, B.smallest(np.bincount(seq, minlength=len(words))))

        for batch in batches:
            for *row, doc_id in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((tuple(row), doc_id))
                size += len(row[at_text] or "")
                if size >= block_bytes:
                    yield from close()
                    rows, size, done = [], 0, done + 1
        if rows:
            yield from close()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in B.grouped(batches, 1):
            of = B.numbers()  # equal bytes, not only equal hashes
            packets = []
            for _, _, block, payload in rows:
                at, words, count = B.unpack(payload)
                packets.append((block, np.cumsum(at, dtype=np.int64), np.fromiter(map(of.__getitem__, words), np.int64, len(words)), count))
            total = np.zeros(len(of), np.int64)
            for _, _, pos, count in packets:
                total[pos] += count  # a block's lines are distinct
            if len(of) > 1 << BITS:
                raise OverflowError(f"a bucket has {len(of)} distinct lines; {1 << BITS} have numbers")
            for block, at, pos, _ in packets:
                again = total[pos] > 1
                if again.any():
                    yield B._one(B.VALUES, slot, block, B.pack((B.steps(at[again]), pos[again] | slot << BITS)))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in B.grouped(batches, 2):
            new, old, weight, second, begin, ids = B.unpack(next(r[3] for r in rows if r[0] == B.EXTRA))
            new = np.unpackbits(new, count=int(begin[-1])).astype(bool)
            seq = np.cumsum(new) - 1
            seq[~new] = old
            number = np.full(len(weight), -1, np.int64)
            for r in rows:
                if r[0] == B.VALUES:
                    at, x = B.unpack(r[3])
                    number[np.cumsum(at, dtype=np.int64)] = x
            number = number[seq]
            a, b = runs(weight[seq], begin, np.unpackbits(second, count=len(seq)).astype(bool), min_words)
            once = np.concatenate([[0], np.cumsum(number < 0)])
            both = once[b + 1] == once[a]
            a, b = a[both], b[both]
            if not len(a):
                continue
            doc, of = ids[np.searchsorted(begin, a, "right") - 1], B.numbers()
            data = np.ascontiguousarray(number.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :SIZE]).tobytes()
            place = np.fromiter((of[data[i:j]] for i, j in zip((SIZE * a).tolist(), (SIZE * (b + 1)).tolist())), np.int64, len(a))
            first = first_of(place, doc, np.arange(len(a)))
            yield B._one(B.EXTRA, home(block), block, B.pack((B.steps(a), B.smallest(b - a), B.smallest(place), len(of))))
            yield from dealt(block, B.WORDS, list(of), np.stack([doc[first], first], axis=1), B.smallest(np.bincount(place)))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in B.grouped(batches, 1):
            of, packets, columns = B.numbers(), [], []
            for kind, _, block, payload in rows:
                if kind == B.EXTRA:
                    yield B._one(kind, slot, block, payload)
                    continue
                at, words, first, count = B.unpack(payload)
                pos = np.fromiter(map(of.__getitem__, words), np.int64, len(words))
                packets.append((block, np.cumsum(at, dtype=np.int64), pos))
                columns.append((pos, first[:, 0], np.full(len(pos), block), first[:, 1], count.astype(np.int64)))
            if not packets:
                continue
            place, doc, of_block, at, count = map(np.concatenate, zip(*columns))
            best = first_of(place, doc, of_block, at)
            first, total = np.stack([of_block[best], at[best]], axis=1), np.bincount(place, count)
            for block, at, pos in packets:
                again = total[pos] > 1
                if again.any():
                    yield B._one(B.VALUES, slot, block, B.pack((at[again], first[pos[again]])))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sent in B.grouped(batches, 2):
            rows, gaps, sizes, begin, n_chunks = B.unpack(next(r[3] for r in sent if r[0] == B.DOCS))
            ends = np.cumsum(gaps, dtype=np.int64) + np.cumsum(sizes, dtype=np.int64)
            before = np.concatenate([[0], ends])[begin[:-1]]  # where the texts before a text end in all
            ends -= np.repeat(before, np.diff(begin))
            starts = ends - sizes
            first = last = np.zeros(0, np.int64)
            if places := [r[3] for r in sent if r[0] == B.EXTRA]:
                first, last, place, n_words = B.unpack(places[0])
                first = np.cumsum(first, dtype=np.int64)
                last = first + last
                keeper = np.full((n_words, 2), -1, np.int64)
                for r in sent:
                    if r[0] == B.VALUES:
                        at, x = B.unpack(r[3])
                        keeper[at] = x
                k = keeper[place]
                gone = (k[:, 0] >= 0) & ~((k[:, 0] == block) & (k[:, 1] == np.arange(len(k))))
                first, last = first[gone], last[gone]
            cuts = np.searchsorted(first, begin)
            for i in range(0, len(rows), 1000):
                out = []
                for r in range(i, min(i + 1000, len(rows))):
                    s = slice(cuts[r], cuts[r + 1])
                    cells, lost = list(rows[r]), 0
                    if cuts[r] < cuts[r + 1]:
                        text = cells[at_text]
                        kept, done = [], 0
                        for a, b in zip(starts[first[s]].tolist(), ends[last[s]].tolist()):
                            kept.append(text[done:a])
                            lost += b - max(a, done)
                            done = b
                        cells[at_text] = "".join([*kept, text[done:]]).strip()
                        if at_chars is not None:
                            cells[at_chars] = len(cells[at_text])
                    out.append((*cells, int(n_chunks[r]), int(cuts[r + 1] - cuts[r]), lost))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    numbered_rows = own.select("*", F.col("doc_id").cast("string").try_cast("bigint").alias("_order"))  # the order of documents goes by it
    kept, path = written(numbered_rows.mapInArrow(cut, B.ROW), "lines", partition_by="kind")
    kept = kept.select("kind", "slot", "block", "payload")
    again, _ = written(B.to_buckets(kept.where(F.col("kind") == B.WORDS), n).mapInArrow(numbered, B.ROW), "line-numbers")
    drop_folder(spark, f"{path}/kind={B.WORDS}")
    free_shuffles(spark)
    sent = B.to_blocks(kept.where(F.col("kind") == B.EXTRA).union(again), n).mapInArrow(chunked, B.ROW)
    valued = B.to_buckets(sent, n).mapInArrow(met, B.ROW)
    return B.to_blocks(kept.where(F.col("kind") == B.DOCS).union(valued), n).mapInArrow(finished, shape)


def removal_report(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """doc_id, n_chunks, n_removed, removed_chars, text of each row: what :func:`dedup_lines` did."""
    return dedup_lines(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), min_words)
