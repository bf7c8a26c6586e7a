"""Operator 10: near-duplicate embeddings by a robust-pruned flat graph.

1. Balls. Vectors within ``ball_degrees`` of a leader form a ball; a ball is so small that its members surely link with
   each other. Leaders are found among the vectors of a nearest centroid, in parts of ``CHUNK`` where there are more; leaders of
   such parts then take each other's balls over where the whole ball still fits. So a group of near copies, however large, is a
   few balls, and pairs inside are counted, not listed.
2. Graph. Centroids are fitted on a bounded sample. A ball's leader goes to the shard of its nearest centroid (its home)
   and to those of centroids at most ``margin_degrees`` farther. Each shard builds a robust-pruned graph (Vamana's rule);
   adjacency lists of a leader in several shards are united.
3. Search. In its home shard each leader is searched for greedily, from the shard's medoid and its own node, and the range
   is then expanded over all nodes within reach.
4. Verification. Two balls link surely, or not at all, by their leaders' angle and radii, and so does a member with a ball; the
   rest are compared in double precision, in blocks of ``COMPARED`` members a side.
5. Audit. The links of all vectors whose vec_id is divisible by ``audit_every`` are counted by brute force over all vectors. If
   of a vector's links outside its own ball fewer than ``recall`` were found (the mean over vectors that have such links), the margin
   is doubled and 2 to 4 are done again; once it is a right angle, leaders are compared with each other in blocks instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm._common import shuffle_width, written
from wordloom.llm.components import connected_components

SAMPLE = 20_000  # vectors that centroids are fitted on, at most about
SHARD = 1_500  # leaders of a home shard, about
CHUNK = 20_000  # vectors among which leaders are chosen at once
COMPARED = 1_024  # members of a ball in a block
QUERIES = 8_192  # audited vectors compared in a pass over all others
SLACK = 1e-7  # radians of rounding error
AUDITED = 1_000  # vectors of the second audit, about, in a small table


def unit(x) -> np.ndarray | None:
    """The vector over its length in double precision; None if it is null, empty, zero or not finite."""
    if x is None or not len(x) or any(v is None for v in x):
        return None
    v = np.asarray(x, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def angle(cosine) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(7)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        at = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def robust_pruned(x: np.ndarray, degree: int = 16, pool: int = 40, alpha: float = 1.2) -> list[np.ndarray]:
    """Adjacency lists: of its nearest candidates a node keeps those not much closer to one kept before; links are both ways."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    kept: list[list[int]] = [[] for _ in range(n)]
    pool = min(pool, n - 1)
    low = x.astype(np.float32)
    for i in range(0, n, 1024):
        s = low[i : i + 1024] @ low.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        for r, own in enumerate(near):
            own = own[np.argsort(-s[r, own], kind="stable")]
            d = 1 - s[r, own]
            between = 1 - low[own] @ low[own].T
            alive = np.ones(len(own), bool)
            mine = kept[i + r]
            while len(mine) < degree and alive.any():
                k = int(alive.argmax())
                mine.append(int(own[k]))
                alive &= alpha * between[k] > d
                alive[k] = False
    both: list[set] = [set(a) for a in kept]
    for a, mine in enumerate(kept):
        for b in mine:
            both[b].add(a)
    return [np.fromiter(a, np.int64, len(a)) for a in both]


def range_search(x: np.ndarray, adjacency: list[np.ndarray], entries: list[int], q: np.ndarray, reach: float, beam: int = 24) -> list[int]:
    """Nodes with a cosine of ``reach`` or more: greedy search by a beam, whose end is widened over all nodes within reach."""
    seen = set(entries)
    sims = x[entries] @ q
    best = [(s, e) for s, e in zip(sims.tolist(), entries)]
    front = [(-s, e) for s, e in best]
    heapq.heapify(front)
    heapq.heapify(best)
    found = {e for s, e in best if s >= reach}
    while front:
        s, node = heapq.heappop(front)
        if -s < reach and len(best) >= beam and -s < best[0][0]:
            break
        new = [b for b in adjacency[node].tolist() if b not in seen]
        if not new:
            continue
        seen.update(new)
        for v, b in zip((x[new] @ q).tolist(), new):
            if v >= reach:
                found.add(b)
            if v >= reach or len(best) < beam or v > best[0][0]:
                heapq.heappush(front, (-v, b))
                heapq.heappush(best, (v, b))
                if len(best) > beam:
                    heapq.heappop(best)
    return list(found)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches sorted by their first column, group by group."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row[1:])
    if rows:
        yield key, rows


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors(vec_id, embedding); see :func:`audited_near_duplicates`."""
    return audited_near_duplicates(vectors, **options)[0]


def audited_near_duplicates(vectors: DataFrame, threshold: float = 0.95, ball_degrees: float = 9.0, margin_degrees: float = 6.0, recall: float = 0.97, audit_every: int = 100) -> tuple[DataFrame, float | None]:
    """vec_id, n_links, component_id, kept of each row of vectors(vec_id, embedding), and the recall that the audit measured: on the ids
    divisible by audit_every, or on about AUDITED vectors or one in audit_every where those have no links to be missed. None if these
    have none either.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of different
    lengths don't link. Rows with equal vec_ids are vectors of their own. Null vec_ids come after others: a component of
    nulls alone has a null component_id, and its rows aren't kept. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    width = shuffle_width(spark)
    theta = float(np.arccos(threshold))
    radius = min(np.radians(ball_degrees), 0.49 * theta)

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("rid", F.monotonically_increasing_id())
    schema = pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("u", pa.binary())])

    def normal(batches):
        for batch in batches:
            out = []
            for vec_id, x, rid in zip(*(c.to_pylist() for c in batch.columns)):
                v = unit(x)
                out.append((rid, vec_id, 0 if v is None else len(v), None if v is None else v.tobytes()))
            if out:
                yield _table(out, schema)

    own, _ = written(rows.mapInArrow(normal, "rid bigint, vec_id bigint, dim int, u binary"), "vectors")
    valid = own.where("u is not null")
    counts = {r["dim"]: r["count"] for r in valid.groupBy("dim").count().collect()}  # lengths of vectors: a few
    centres = {}
    for dim, n in counts.items():
        some = valid.where(F.col("dim") == dim)
        if n > SAMPLE:
            some = some.where(F.pmod(F.xxhash64("rid"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
        sample = np.stack([np.frombuffer(r["u"], np.float64) for r in some.select("u").orderBy("rid").collect()] or [np.eye(1, dim)[0]])
        centres[dim] = centroids(sample, max(1, n // SHARD))
    shared = spark.sparkContext.broadcast(centres)
    first = dict(zip(sorted(centres), np.concatenate([[0], np.cumsum([len(centres[d]) for d in sorted(centres)])]).tolist()))

    members, balls = _balls(valid, shared, first, width, radius)
    widest = balls.agg(F.max("radius")).collect()[0][0] or 0.0

    inside = members.select("rid", "ball").join(balls.select("ball", "size"), "ball").select("rid", (F.col("size") - 1).alias("inside"))

    def audit(queries: Column) -> DataFrame:
        """All links of the vectors asked for, by brute force, and how many of them are inside their balls."""
        return written(_brute_counts(valid, valid.where(queries).select("rid", "dim", "u"), threshold).join(inside, "rid"), "truth")[0]

    # Where no vector of these ids has a link outside its ball, so that they tell nothing, others are audited: all of a small table.
    one_in = max(1, min(audit_every, sum(counts.values()) // AUDITED))
    audits = [F.pmod("vec_id", F.lit(audit_every)) == 0, F.pmod(F.xxhash64("rid", F.lit(9)), F.lit(one_in)) == 0]
    truth, margin = None, float(np.radians(margin_degrees))
    while True:
        exact = margin >= np.pi / 2
        pairs = _all_pairs(balls, width, theta) if exact else _found_pairs(balls, shared, first, width, theta, widest, margin)
        out, _ = written(_links(pairs, balls, members, own, width, theta, threshold), "links")
        reached = None
        while reached is None and (truth is not None or audits):
            truth = audit(audits.pop(0)) if truth is None else truth
            share = (F.col("n_links") - F.col("inside")) / (F.col("n") - F.col("inside"))
            reached = out.select("rid", "n_links").join(truth, "rid").where("n > inside").agg(F.avg(share)).collect()[0][0]
            truth = None if reached is None else truth
        if reached is None or reached >= recall or exact:
            return out.select("vec_id", "n_links", "component_id", "kept"), reached
        margin *= 2


def _balls(valid: DataFrame, shared, first: dict, width: int, radius: float) -> tuple[DataFrame, DataFrame]:
    """members(ball, rid, vec_id, angle, u), angle being an upper bound of that to the leader, and balls(ball, size, radius, low, u)."""

    def homed(batches):
        for batch in batches:
            out = []
            for rid, vec_id, dim, u in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((first[dim] + int((shared.value[dim] @ np.frombuffer(u, np.float64)).argmax()), rid, vec_id, u))
            if out:
                yield _table(out, pa.schema([("home", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("u", pa.binary())]))

    def led(batches):
        for _, rows in _grouped(batches):
            x = np.stack([np.frombuffer(m[3], np.float64) for m in rows])
            ball, off = np.full(len(x), -1), np.zeros(len(x))
            while len(left := np.flatnonzero(ball < 0)):
                leaders = left[:256]  # a block at once, then against each other
                s = x[leaders] @ x[leaders].T
                good: list[int] = []
                for k in range(len(leaders)):
                    if not good or angle(s[k, good].max()) > radius:
                        good.append(k)
                sims = x[left] @ x[leaders[good]].T
                at = sims.argmax(axis=1)
                a = angle(sims[np.arange(len(left)), at])
                near = a <= radius
                ball[left[near]], off[left[near]] = leaders[good][at[near]], a[near]
                ball[leaders[good]], off[leaders[good]] = leaders[good], 0.0
            yield _table([(rows[b][1], *m[:3], o, m[3]) for m, b, o in zip(rows, ball.tolist(), off.tolist())], pa.schema([("ball", pa.int64()), ("home", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("angle", pa.float64()), ("u", pa.binary())]))

    def in_parts(rows: DataFrame, id_column: str) -> DataFrame:
        """Rows of a home together, in parts of about CHUNK where there are more."""
        large = rows.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))  # a row a centroid: SAMPLE at most a length
        salt = F.pmod(F.xxhash64(id_column, F.lit(5)), F.col("parts"))
        cut = rows.join(F.broadcast(large), "home").withColumn("part", F.concat_ws(":", "home", salt))
        return cut.repartition(width, "part").sortWithinPartitions("part", id_column)

    homes, _ = written(valid.mapInArrow(homed, "home bigint, rid bigint, vec_id bigint, u binary"), "homes")
    parts = in_parts(homes, "rid").select("part", "home", "rid", "vec_id", "u")
    members, _ = written(parts.mapInArrow(led, "ball bigint, home bigint, rid bigint, vec_id bigint, angle double, u binary"), "members")

    def absorbed(batches):
        """Of leaders, those whose whole ball fits into another's, and by which angle they are off."""
        for _, rows in _grouped(batches):
            rows.sort(key=lambda r: (-r[1], r[0]))
            x, spread = np.stack([np.frombuffer(r[3], np.float64) for r in rows]), np.asarray([r[2] for r in rows])
            into, out = np.full(len(x), -1), []
            for k in range(len(rows)):
                if into[k] < 0:
                    a = angle(x[k + 1 :] @ x[k])
                    fits = np.flatnonzero((into[k + 1 :] < 0) & (a + spread[k + 1 :] + SLACK <= radius)) + k + 1
                    into[fits] = k
                    out += [(rows[j][0], rows[k][0], float(a[j - k - 1]) + SLACK) for j in fits.tolist()]
            if out:
                yield _table(out, pa.schema([("ball", pa.int64()), ("into", pa.int64()), ("off", pa.float64())]))

    # Leaders of homes that were cut into parts.
    cut = members.groupBy("home").count().where(F.col("count") > CHUNK).select("home")
    sums = members.join(F.broadcast(cut), "home").groupBy("home", "ball").agg(F.count("*").alias("size"), F.max("angle").alias("radius"))
    leaders, _ = written(sums.join(members.where("ball = rid").select("ball", "u"), "ball").select("home", "ball", "size", "radius", "u"), "part-leaders")
    if not leaders.isEmpty():
        moved, _ = written(in_parts(leaders, "ball").select("part", "ball", "size", "radius", "u").mapInArrow(absorbed, "ball bigint, into bigint, off double"), "moved")
        members, _ = written(members.join(moved, "ball", "left").select(F.coalesce("into", "ball").alias("ball"), "rid", "vec_id", (F.col("angle") + F.coalesce("off", F.lit(0.0))).alias("angle"), "u"), "balls")
    members = members.select("ball", "rid", "vec_id", "angle", "u")
    balls = members.groupBy("ball").agg(F.count("*").alias("size"), F.max("angle").alias("radius"), F.min("vec_id").alias("low"))
    return members, written(balls.join(members.where("ball = rid").select("ball", "u"), "ball"), "leaders")[0]


def _brute_counts(valid: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(rid, n): links of the audited vectors, by comparison with all others, some QUERIES of them at a time."""
    blocks = max(1, -(-queries.count() // QUERIES))
    out = []
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(blocks)) == block).collect()
        of = {d: [r for r in rows if r["dim"] == d] for d in {r["dim"] for r in rows}}
        q = valid.sparkSession.sparkContext.broadcast({d: (np.asarray([r["rid"] for r in some]), np.stack([np.frombuffer(r["u"], np.float64) for r in some])) for d, some in of.items()})

        def run(batches, q=q):
            sums = {d: np.zeros(len(rids), np.int64) for d, (rids, _) in q.value.items()}
            for batch in batches:
                dims = np.asarray(batch.column("dim"))
                for d, (_, x) in q.value.items():
                    at = np.flatnonzero(dims == d)
                    if len(at):
                        y = np.stack([np.frombuffer(batch.column("u")[i].as_py(), np.float64) for i in at.tolist()])
                        sums[d] += np.concatenate([(x[i : i + 1024] @ y.T >= threshold).sum(axis=1) for i in range(0, len(x), 1024)])
            for d, n in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(q.value[d][0]), pa.array(n)], names=["rid", "n"])

        got = valid.select("dim", "u").mapInArrow(run, "rid bigint, n bigint").groupBy("rid").agg((F.sum("n") - 1).alias("n"))
        out.append(written(got, "audit")[0] if blocks > 1 else got)
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("angle", pa.float64())])


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair of balls once in each direction."""
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "angle")).groupBy("a", "b").agg(F.max("angle").alias("angle"))


def _found_pairs(balls, shared, first, width, theta, widest, margin) -> DataFrame:
    """Steps 2 and 3: (a, b, angle) of balls whose members may link."""
    node = pa.schema([("shard", pa.int64()), ("ball", pa.int64()), ("home", pa.bool_()), ("radius", pa.float64()), ("u", pa.binary())])

    def sharded(batches):
        for batch in batches:
            out = []
            for ball, radius, u in zip(*(c.to_pylist() for c in batch.columns)):
                dim = len(u) // 8
                a = angle(shared.value[dim] @ np.frombuffer(u, np.float64))
                home = int(a.argmin())
                out += [(first[dim] + c, ball, c == home, radius, u) for c in np.flatnonzero(a <= a[home] + margin).tolist()]
            if out:
                yield _table(out, node)

    nodes, _ = written(balls.select("ball", "radius", "u").mapInArrow(sharded, "shard bigint, ball bigint, home boolean, radius double, u binary"), "nodes")

    def built(batches):
        for _, rows in _grouped(batches):
            ids = np.asarray([r[0] for r in rows])
            lists = robust_pruned(np.stack([np.frombuffer(r[1], np.float64) for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[a] for a in lists], pa.list_(pa.int64()))], names=["ball", "near"])

    graph = nodes.select("shard", "ball", "u").repartition(width, "shard").sortWithinPartitions("shard", "ball").mapInArrow(built, "ball bigint, near array<bigint>")
    graph = graph.groupBy("ball").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list a shard: a few
    graph, _ = written(graph, "graph")

    def searched(batches):
        for _, rows in _grouped(batches):
            place = {r[0]: k for k, r in enumerate(rows)}
            x = np.stack([np.frombuffer(r[3], np.float64) for r in rows])
            adjacency = [np.asarray([place[b] for b in r[4] if b in place], np.int64) for r in rows]
            medoid = int((x @ x.mean(axis=0)).argmax())
            out = []
            for k, (ball, home, radius, _, _) in enumerate(rows):
                if not home:
                    continue
                reach = float(np.cos(min(np.pi, theta + radius + widest + SLACK)))
                for b in range_search(x, adjacency, list({medoid, k}), x[k], reach):
                    a = float(angle(x[b] @ x[k]))
                    if b != k and a <= theta + radius + rows[b][2] + SLACK:
                        out.append((ball, rows[b][0], a))
                if len(out) > 50_000:
                    yield _table(out, _PAIR)
                    out = []
            if out:
                yield _table(out, _PAIR)

    routed = nodes.join(graph, "ball").select("shard", "ball", "home", "radius", "u", "near")
    pairs = routed.repartition(width, "shard").sortWithinPartitions("shard", "ball").mapInArrow(searched, "a bigint, b bigint, angle double")
    return _both_ways(pairs)


def _all_pairs(balls: DataFrame, width: int, theta: float) -> DataFrame:
    """(a, b, angle) of balls whose members may link, by comparison of all leaders in blocks."""
    blocks = max(1, -(-balls.count() // 2048))
    mine = F.pmod(F.xxhash64("ball", F.lit(9)), F.lit(blocks))
    rows = balls.select("ball", "radius", "u", mine.cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    task = F.concat_ws(":", F.length("u"), F.least("mine", "other"), F.greatest("mine", "other"))
    rows = rows.select(task.alias("task"), "ball", "radius", "u", (F.col("mine") > F.col("other")).alias("side"))

    def compared(batches):
        for key, rows in _grouped(batches):
            same = key.split(":")[1] == key.split(":")[2]
            sides = [[r for r in rows if same or r[3] == k] for k in (False, True)]
            if all(sides):
                x, y = (np.stack([np.frombuffer(r[2], np.float64) for r in s]) for s in sides)
                spread = np.asarray([r[1] for r in sides[1]])
                for k, r in enumerate(sides[0]):
                    a = angle(y @ x[k])
                    if out := [(r[0], sides[1][j][0], float(a[j])) for j in np.flatnonzero(a <= theta + r[1] + spread + SLACK).tolist() if sides[1][j][0] != r[0]]:
                        yield _table(out, _PAIR)

    return _both_ways(rows.repartition(width, "task").sortWithinPartitions("task").mapInArrow(compared, "a bigint, b bigint, angle double"))


def _links(pairs, balls, members, own, width, theta, threshold) -> DataFrame:
    """Step 4 and the components: rid, vec_id, n_links, component_id, kept."""
    side = lambda c: balls.select(F.col("ball").alias(c), F.col("size").alias(f"{c}_size"), F.col("radius").alias(f"{c}_radius"))
    pairs, _ = written(pairs.join(side("a"), "a").join(side("b"), "b"), "pairs")
    is_sure = F.col("angle") + F.col("a_radius") + F.col("b_radius") + SLACK <= theta
    sure = pairs.where(is_sure).groupBy(F.col("a").alias("ball")).agg(F.sum("b_size").alias("sure"))

    # Pairs of balls that their members decide. A member links with all of the other ball, with none, or has to be compared.
    near, _ = written(pairs.where(~is_sure), "unsure")
    of = lambda c: near.join(members.select(F.col("ball").alias(c), "rid", F.col("angle").alias("off"), "u"), c)
    least, most = F.col("angle") - F.col("off"), F.col("angle") + F.col("off")
    with_all = of("a").where(most + F.col("b_radius") + SLACK <= theta).select("a", "b", "rid", F.col("b_size").alias("n"))
    left = of("a").where((most + F.col("b_radius") + SLACK > theta) & (least - F.col("b_radius") - SLACK <= theta))
    right = of("b").where(least - F.col("a_radius") - SLACK <= theta)
    blocks = lambda c: F.ceil(F.col(f"{c}_size") / COMPARED).cast("int")
    salt = lambda c: F.pmod(F.xxhash64("rid", F.lit(13)), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    left = left.select("a", "b", salt("a").alias("i"), every("b").alias("j"), F.lit(0).alias("side"), "rid", "u")
    right = right.select("a", "b", every("a").alias("i"), salt("b").alias("j"), F.lit(1).alias("side"), "rid", "u")
    parts = left.union(right).select(F.concat_ws(":", "a", "b", "i", "j").alias("task"), "a", "b", "side", "rid", "u")

    def compared(batches):
        for _, rows in _grouped(batches):
            sides = [[r for r in rows if r[2] == k] for k in (0, 1)]
            if all(sides):
                x, y = (np.stack([np.frombuffer(r[4], np.float64) for r in s]) for s in sides)
                n = (x @ y.T >= threshold).sum(axis=1)
                if n.any():
                    yield _table([(rows[0][0], rows[0][1], sides[0][k][3], int(n[k])) for k in np.flatnonzero(n).tolist()], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("rid", pa.int64()), ("n", pa.int64())]))

    counted = parts.repartition(width, "task").sortWithinPartitions("task").mapInArrow(compared, "a bigint, b bigint, rid bigint, n bigint")
    checked, _ = written(counted.union(with_all), "checked")
    extra = checked.groupBy("rid").agg(F.sum("n").alias("extra"))
    links = pairs.where(is_sure).select("a", "b").union(checked.select("a", "b").distinct())
    comps = connected_components(links).select(F.col("vertex").alias("ball"), "root")
    labelled, _ = written(balls.select("ball", "size", "low").join(comps, "ball", "left").select("ball", "size", "low", F.coalesce("root", "ball").alias("root")).join(sure, "ball", "left"), "labelled")
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    found, _ = written(labelled.join(lows, "root").select("ball", (F.col("size") - 1 + F.coalesce("sure", F.lit(0))).alias("n"), "component_id"), "found")
    slim = members.select("rid", "ball").join(found, "ball").join(extra, "rid", "left").select("rid", (F.col("n") + F.coalesce("extra", F.lit(0))).cast("bigint").alias("n_links"), "component_id")
    out = own.select("rid", "vec_id", F.col("u").isNull().alias("odd")).join(slim, "rid", "left")
    component = F.when(F.col("odd"), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
