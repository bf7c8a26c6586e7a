"""Operator 3: n-gram Jaccard join as a blocked sparse matrix product.

Documents with the same set of word n-grams are one vertex. Links between different sets are found in three steps:

1. Candidates. A set is sorted (n-grams of hot counters of a fixed-size sketch last, otherwise by hash). If two sets have a
   Jaccard similarity of t = 0.8, at most 0.2 u of their u n-grams differ, each differing one breaks at most three of the
   u - 2 runs of three neighbours, so at least 0.4 u - 2 runs of three are common. Such runs are rare between texts that
   share only some lines. By the prefix principle, the first n - 1 - max(1, ceil(0.4 n) - 2) of a set's runs meet those
   of the other. Sets of few n-grams use the n-grams themselves, with the usual prefix.
   Buckets of runs give a spanning forest of the sets that share one, with sizes within the bound.
2. Components of these forests are cut into blocks by size band. For each pair of blocks within the size bound, the sparse
   incidence matrix of sets by n-grams is multiplied with its transpose, which accumulates overlap counts; pairs below the
   bound are discarded and the others' spanning forest is kept.
3. Components of the forests are the classes.

No step emits all pairs of a group: forests are linear in the group, and a group of m sets costs m / BLOCK copies of a set.
N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import _blocks as B
from wordloom.llm._common import bucket_count, drop_folder, short_batches, shuffle_width, texts, written
from wordloom.llm.components import connected_components, forest, linked_labels

SKETCH_BITS = 22
FEW = 12  # sets of fewer n-grams go by single n-grams
BLOCK = 512
BLOCK_CELLS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; of the whole sequence if there are fewer words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = max(1, len(h) - n + 1)
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(m, np.uint64(k))
        for i in range(k):
            out = B.mixed(out * _STEP + h[i : i + m])
    return B.distinct(out)


def set_id(s: np.ndarray) -> int:
    return int(np.asarray([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def ceil_share(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def keys(s: np.ndarray, hot: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The hashed keys under which a set looks for candidates."""
    n = len(s)
    late = hot[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    out = []
    # Common n-grams of sets within the bound: at least num/den of either.
    if n < FEW * den // num + 1 or num * 10 < den * 7:
        out.append(np.concatenate([s[~late], s[late]])[: n - ceil_share(n, num, den) + 1])
    if n >= FEW and num * 10 >= den * 7:
        order = np.concatenate([s[~late], s[late]])
        with np.errstate(over="ignore"):
            runs = B.mixed(B.mixed(B.mixed(order[:-2]) + order[1:-1] * _STEP) + order[2:] * _STEP)
        common = max(1, ceil_share(n, 3 * num - 2 * den, den) - 2)
        slow = np.concatenate([late[~late], late[late]])[2:]
        out.append(runs[np.lexsort((runs, slow))][: n - 2 - common + 1])
    return out


def _described(docs: DataFrame, n: int, slots: int) -> DataFrame:
    """A row for each document (kind 0: doc_id, mark, set's id and size), and slices of a task's sketch of n-gram counts (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("sid", pa.int64()), ("n_shingles", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sets = [ngram_set(t or "", n) for t in batch.column(1).to_pylist()]
            m = len(sets)
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)) if m else 0
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array([0] * m, pa.int32()), batch.column(0), batch.column(2), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([None] * m, pa.binary())], schema=schema)
        if counts.any():
            edges = np.linspace(0, len(counts), slots + 1).astype(np.int64)
            for k in range(slots):
                part = counts[edges[k] : edges[k + 1]]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([k], pa.int32()), *[pa.array([None], pa.int64())] * 4, pa.array([B.pack(B.smallest(part))], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "kind int, slot int, doc_id bigint, mark bigint, sid bigint, n_shingles bigint, payload binary")


def _hot_counters(described: DataFrame, total: int, slots: int, width: int) -> np.ndarray:
    """Which counters are far above the mean: a bitmap of fixed size, put together from the slots' parts."""
    bound = 4 * total / (1 << SKETCH_BITS) + 64
    edges = np.linspace(0, 1 << SKETCH_BITS, slots + 1).astype(np.int64)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for slot, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[slot] = sums.get(slot, 0) + B.unpack(payload).astype(np.int64)
        for slot, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([B.pack(np.flatnonzero(s >= bound))], pa.binary())], names=["slot", "payload"])

    hot = np.zeros(1 << SKETCH_BITS, bool)
    parts = described.where("kind = 1").select("slot", "payload").repartition(width, "slot").mapInArrow(run, "slot int, payload binary")
    for r in parts.collect():
        hot[edges[r["slot"]] + B.unpack(bytes(r["payload"]))] = True
    return hot


def thinned(h: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key and size: which stand for all in other blocks, and links (a, b) of neighbours within the bound.

    Of a chain of rows of a key, each within the bound of the next, the first and the last are kept and enough between them
    that neighbours kept are within the bound of each other; whatever is within the bound of a row is then within the bound
    of one kept.
    """
    near = (h[1:] == h[:-1]) & (size[1:] * num <= size[:-1] * den)
    a = np.flatnonzero(near)
    kept = np.ones(len(h), bool)
    if len(a):
        inner = np.zeros(len(h), bool)  # rows with a neighbour within the bound on both sides
        inner[1:-1] = near[1:] & near[:-1]
        last, before = 0, -2
        for i in np.flatnonzero(inner).tolist():
            if i != before + 1:
                last = size[i - 1]
            before = i
            if size[i + 1] * num <= last * den:
                kept[i] = False
            else:
                last = size[i]
    return kept, a, a + 1


def _candidates(docs: DataFrame, n: int, num: int, den: int, hot, slots: int, block_keys: int = 1_500_000) -> DataFrame:
    """Links (a, b) between sets: a spanning forest, bucket by bucket, of those that share a key within the size bound."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(hot.value).astype(bool)
        held, owner, sids, sizes, seen, total = [], [], [], [], set(), 0

        def packets() -> Iterator[pa.RecordBatch]:
            h, own = np.concatenate(held), np.repeat(np.arange(len(owner)), owner)
            slot = (B.mixed(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(slots)).astype(np.int64)
            s, z = np.asarray(sids, np.int64), np.asarray(sizes, np.int64)
            order = np.lexsort((z[own], h, slot))
            h, own, slot = h[order], own[order], slot[order]
            kept, a, b = thinned(h, z[own], num, den)
            # The block's own forest travels with its first packet.
            links = np.unique(np.stack([own[a], own[b]], axis=1), axis=0)
            inside = [s[np.asarray(x, np.int64)] for x in forest(*links.T.tolist())]
            h, own, slot = h[kept], own[kept], slot[kept]
            ends = np.searchsorted(slot, np.arange(slots + 1))
            for k in range(slots):
                at = slice(ends[k], ends[k + 1])
                if ends[k] < ends[k + 1]:
                    used, local = np.unique(own[at], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([B.pack((h[at], B.smallest(local), s[used], B.smallest(z[used]), *inside))], pa.binary())], names=["slot", "payload"])
                    inside = [s[:0], s[:0]]

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = ngram_set(text or "", n)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                for k in keys(s, late, num, den):
                    held.append(k)
                    owner.append(len(k))
                    sids.append(sid)
                    sizes.append(len(s))
                    total += len(k)
            if total >= block_keys:
                yield from packets()
                held, owner, sids, sizes, seen, total = [], [], [], [], set(), 0
        if total:
            yield from packets()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in B.grouped(batches, 0):
            parts = [B.unpack(p) for _, p in rows]
            h = np.concatenate([p[0] for p in parts])
            sid = np.concatenate([p[2][p[1]] for p in parts])
            size = np.concatenate([p[3][p[1]] for p in parts]).astype(np.int64)
            inside = [np.concatenate([p[k] for p in parts]) for k in (4, 5)]
            del parts
            order = np.argsort(h, kind="stable")
            h = h[order]
            shared = np.zeros(len(h), bool)
            shared[1:] = h[1:] == h[:-1]
            shared[:-1] |= shared[1:]
            h, order = h[shared], order[shared]
            sid, size = sid[order], size[order]
            order = np.lexsort((sid, size, h))  # neighbours in a key's list, by size: a gap in sizes parts it
            h, sid, size = h[order], sid[order], size[order]
            near = (h[1:] == h[:-1]) & (sid[1:] != sid[:-1]) & (size[1:] * num <= size[:-1] * den)
            a, b = (np.concatenate([x, y]) for x, y in zip((sid[:-1][near], sid[1:][near]), inside))
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1), axis=0)
                v, root = forest(pairs[:, 0].tolist(), pairs[:, 1].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    return B.to_buckets(docs.select("text").mapInArrow(post, "slot int, payload binary"), slots).mapInArrow(meet, "a bigint, b bigint")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: the incidence matrix times its transpose, column by column where columns are
    short, as dense strips where they are long."""
    m = len(sets)
    own = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros(m * m, np.float32)
    order = np.argsort(col, kind="stable")
    own, start = own[order], np.concatenate([[0], np.cumsum(times)[:-1]])
    short = 48
    for d in range(2, min(short, m) + 1):
        at = start[times == d]
        step = max(1, 2_000_000 // (d * d))
        for i in range(0, len(at), step):
            rows = own[at[i : i + step, None] + np.arange(d)]
            out += np.bincount((rows[:, :, None] * m + rows[:, None, :]).ravel(), minlength=m * m).astype(np.float32)
    out = out.reshape(m, m)
    long = np.flatnonzero(times > short)
    for i in range(0, len(long), 2048):
        strip = long[i : i + 2048]
        x = np.zeros((m, len(strip)), np.float32)
        at = np.repeat(start[strip], times[strip]) + _ramps(times[strip])
        x[own[at], np.repeat(np.arange(len(strip)), times[strip])] = 1
        out += x @ x.T
    return out


def _ramps(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _linked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, sid, side, shingles), sorted by task: the forest of each task's links."""

    def done(rows):
        sids = np.asarray([r[0] for r in rows], np.int64)
        side = np.asarray([r[1] for r in rows])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = np.asarray([len(s) for s in sets], np.float64)
        o = overlaps(sets).astype(np.float64)
        # |x & y| / |x | y| >= num / den
        link = (o * (den + num) >= num * (size[:, None] + size[None, :])) & (o > 0)
        if (side == 1).any():
            link &= side[:, None] != side[None, :]
        np.fill_diagonal(link, False)
        label = linked_labels(link)
        at = np.flatnonzero(label != np.arange(len(label)))
        return sids[at], sids[label[at]]

    task, rows, out = None, [], []
    for batch in batches:
        for t, sid, side, shingles in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if t != task and rows:
                out.append(done(rows))
                rows = []
            task = t
            rows.append((sid, side, shingles))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(2)], names=["a", "b"])
            out = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in done(rows)], names=["a", "b"])


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), sid of each row.

    Two documents link when their sets' Jaccard similarity is num / den or more (0.5 < num / den <= 1). Null texts and texts
    without words have empty sets and link with nothing. Rows of equal sets are linked, repeated doc_ids too; null doc_ids
    count as larger than others: a class of nulls alone has a null component. Other columns are ignored; an empty table
    gives an empty result. Members of candidate groups are looked up by a broadcast join up to broadcast_rows, by a shuffled
    one beyond.
    """
    spark = docs.sparkSession
    short_batches(spark)
    width = shuffle_width(spark)
    own = texts(docs).withColumn("mark", F.xxhash64("text"))  # with doc_id, finds a row of a set again, null and repeated ids too
    described, _ = written(_described(own, n, width), "described", "kind")
    rows = described.where("kind = 0").select("doc_id", "mark", "sid", "n_shingles")
    total = rows.agg(F.sum("n_shingles")).collect()[0][0] or 0
    hot = spark.sparkContext.broadcast(np.packbits(_hot_counters(described, total, width, width)))
    found, path = written(_candidates(own, n, num, den, hot, bucket_count(docs)), "candidates")
    groups, _ = written(connected_components(found), "groups")
    drop_folder(spark, path)

    # One document of each set, its group, size band and block.
    sets = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark")).alias("d"), F.first("n_shingles").alias("n"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num) if num < den else 1.0) + 1e-9).cast("int")
    members, _ = written(sets.join(groups.withColumnRenamed("vertex", "sid"), "sid").select("sid", "d.doc_id", "d.mark", "n", "root", band.alias("band")), "members")
    whole = members.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("cells"))
    small = whole.where((F.col("c") <= BLOCK) & (F.col("cells") <= BLOCK_CELLS)).select("root")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_CELLS)).cast("int")
    large, _ = written(members.join(small, "root", "left_anti").groupBy("root", "band").agg(blocks.alias("blocks")), "bands")
    up = large.select("root", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    down = large.select("root", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    shape = large.join(up, ["root", "band"], "left").join(down, ["root", "band"], "left").select("root", "band", "blocks", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"))
    shape, _ = written(shape, "shape")
    placed = members.join(shape, ["root", "band"], "left")
    placed, _ = written(placed, "placed")

    n_members = placed.count()
    lookup = placed.select(F.col("doc_id").alias("key"), F.col("mark").alias("key_mark"), F.col("sid").alias("want"), "root", "band", "blocks", "above", "below")
    if n_members <= broadcast_rows:
        lookup = F.broadcast(lookup)
    chosen = own.join(lookup, (F.col("mark") == F.col("key_mark")) & F.col("doc_id").eqNullSafe(F.col("key"))).select("text", "want", "root", "band", "blocks", "above", "below")
    pairs = _block_rows(chosen, n)
    linked = pairs.repartition(width, "task").sortWithinPartitions("task").mapInArrow(lambda b: _linked(b, num, den), "a bigint, b bigint")
    links, _ = written(linked, "linked")
    classes = connected_components(links).withColumnsRenamed({"vertex": "sid", "root": "class"})

    # The smallest doc_id of each class, first by set, then by class.
    least = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("low"))
    least, _ = written(least.join(classes, "sid", "left").select("sid", "low", F.coalesce("class", "sid").alias("class")), "least")
    lows, _ = written(least.groupBy("class").agg(F.min("low").alias("component_id")), "lows")
    of_set, _ = written(least.join(lows, "class").select("sid", "component_id"), "of-set")
    return rows.join(of_set, "sid", "left").select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "sid")


def _block_rows(chosen: DataFrame, n: int) -> DataFrame:
    """(task, sid, side, shingles): a set for each pair of blocks that it takes part in."""

    def tasks(sid, root, band, blocks, above, below):
        if blocks is None:
            return [((root, 0, 0, 0, 0), 0)]
        mine = (sid & 0xFFFFFFFFFFFF) * 2654435761 % (1 << 32) % blocks
        out = [((root, band, min(mine, k), band, max(mine, k)), int(k < mine)) for k in range(blocks)]
        out += [((root, band, mine, band + 1, k), 0) for k in range(above or 0)]
        return out + [((root, band - 1, k, band, mine), 1) for k in range(below or 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # of rows equal in doc_id and text one will do; others come twice at most for a task
        for batch in batches:
            rows = []
            for text, sid, *place in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if sid in seen:
                    continue
                seen.add(sid)
                s = ngram_set(text or "", n)
                rows += [(xxhash.xxh3_64_intdigest(repr(t)) >> 1, sid, side, s.tobytes()) for t, side in tasks(sid, *place)]
                if len(rows) > 500:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows):
        t, sid, side, s = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(sid, pa.int64()), pa.array(side, pa.int32()), pa.array(s, pa.binary())], names=["task", "sid", "side", "shingles"])

    return chosen.mapInArrow(run, "task bigint, sid bigint, side int, shingles binary")
