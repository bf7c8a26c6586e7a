"""Operator 9: size-tiered compaction of immutable shards under an atomically committed, versioned manifest.

A shard is a Parquet file. Arrivals are appended as small shards. Shards of a size tier (powers of the fan-out below the
target size) are merged, once there are enough of them, into files of about the target size: Spark packs whole small files
into read partitions of that size, and each partition is written as one file, so merging needs no shuffle. A version
is a JSON file of the live shards; it is written aside and renamed into place, which fails if another writer has
committed that version first. Old versions stay readable until :meth:`ShardStore.vacuum`.

Only DataFrame operations touch the rows; the driver handles one line a shard.
"""

from __future__ import annotations

import json
import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm._common import written


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Shards and manifests under ``root``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_out: int = 4, key: str = "doc_id"):
        self.spark, self.root, self.target_bytes, self.fan_out, self.key = spark, root.rstrip("/"), target_bytes, fan_out, key
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    # Manifests

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        folder = self._path(f"{self.root}/manifest")
        if not self.fs.exists(folder):
            return 0
        found = [re.fullmatch(r"v(\d+)\.json", s.getPath().getName()) for s in self.fs.listStatus(folder)]
        return max((int(m[1]) for m in found if m), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """Path, bytes, rows, least and greatest key, and tier of each live shard."""
        version = self.version() if version is None else version
        if not version:
            return []
        lines = self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json", wholetext=True).collect()[0][0]
        return [json.loads(x) for x in lines.splitlines() if x.strip()]

    def commit(self, shards: list[dict], base: int) -> int:
        """Make ``shards`` the live ones, as the version after ``base``."""
        staged = self._path(f"{self.root}/manifest/_staged-{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/manifest/v{base + 1:08d}.json")
        out = self.fs.create(staged, True)
        out.write(bytearray("".join(json.dumps(s, sort_keys=True) + "\n" for s in shards).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, final, none)
        except Exception as e:
            self.fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    # Shards

    def tier(self, size: int) -> int:
        """0 for shards of the target size, and one more for each factor of fan_out below."""
        return max(0, math.ceil(math.log(self.target_bytes / max(1, size), self.fan_out) - 1e-9))

    def _described(self, folder: str, schema: T.StructType) -> list[dict]:
        df = _files(self.spark, folder, schema=schema)
        meta = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col(self.key).alias("k"))
        rows = meta.groupBy("path", "bytes").agg(F.count("*").alias("rows"), F.min("k").alias("low"), F.max("k").alias("high")).collect()  # a row a shard
        return sorted(({**r.asDict(), "tier": self.tier(r["bytes"])} for r in rows), key=lambda s: s["path"])

    def _write(self, df: DataFrame, by: str | None = None) -> str:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(folder)
        return folder

    def append(self, df: DataFrame) -> int:
        """Write the rows as new shards, one a partition, and commit them with the live ones. Of no rows: no new version."""
        return self._add(self._described(self._write(df), df.schema))

    def append_arrivals(self, df: DataFrame, turn: str) -> None:
        """Write the rows of each value of a column as an arrival, one or more shards of its own, after one scan. Each is committed by itself, and
        the shards are compacted whenever fan_out of them have been."""
        arrivals: dict[str, list[dict]] = {}
        for s in self._described(self._write(df.withColumn("_arrival", F.col(turn)), "_arrival"), df.schema):
            arrivals.setdefault(s["path"].split("/")[-2], []).append(s)
        for k, name in enumerate(sorted(arrivals), 1):
            self._add(arrivals[name])
            if k % self.fan_out == 0:
                self.compact()

    def _add(self, new: list[dict]) -> int:
        if not new:
            return self.version()
        while True:
            base = self.version()
            try:
                return self.commit([*self.manifest(base), *new], base)
            except Conflict:
                continue

    def merge_plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs of shards to merge: tiers below the target that hold fan_out shards or more, larger shards first."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["tier"] > 0 and s["bytes"] <= self.target_bytes // 2:
                tiers.setdefault(s["tier"], []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_out]

    def compact(self) -> int:
        """Merge each tier's run into files of about the target size and commit; repeated until no tier is full."""
        while True:
            base = self.version()
            live = self.manifest(base)
            runs = self.merge_plan(live)
            if not runs:
                return base
            reader = self.spark.newSession()  # the sizes of read partitions are this merge's alone
            reader.conf.set("spark.sql.files.maxPartitionBytes", str(self.target_bytes))
            reader.conf.set("spark.sql.files.openCostInBytes", "0")
            reader.conf.set("spark.sql.files.minPartitionNum", "1")
            gone, new = set(), []
            for run in runs:
                rows = _files(reader, *[s["path"] for s in run])
                folder = self._write(rows)
                made = self._described(folder, rows.schema)
                if len(made) >= len(run):  # the cluster's settings keep read partitions this small
                    self.fs.delete(self._path(folder), True)
                    continue
                gone |= {s["path"] for s in run}
                new += made
            if not gone:
                return base
            try:
                self.commit([*[s for s in live if s["path"] not in gone], *new], base)
            except Conflict:
                continue  # another writer was first; its version is the new base

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with shard (path) and shard_bytes. Fails on a version without shards."""
        df = _files(self.spark, *[s["path"] for s in self.manifest(version)])
        return df.select("*", F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))

    def vacuum(self) -> None:
        """Delete shards that the last version doesn't hold. Older versions can't be read after it."""
        live = {self._path(s["path"]).toUri().getPath() for s in self.manifest()}
        files = self.fs.listFiles(self._path(f"{self.root}/data"), True)
        dead = []
        while files.hasNext():
            p = files.next().getPath()
            if p.getName().endswith(".parquet") and p.toUri().getPath() not in live:
                dead.append(p)
        for p in dead:
            self.fs.delete(p, False)


def _files(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows as they are in the files, whatever the names of their folders."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).parquet(*paths)


#: What a shard is aimed at, how many of a tier are merged, and arrivals: enough of them that shards are merged, and that what the first merges
#: make is merged again, whatever the size of the table and the partitions it is read in.
TARGET_BYTES, FAN_OUT, ARRIVALS = 128 << 20, 4, 20
_ADDED = {"shard": "string", "shard_bytes": "bigint", "shard_tier": "int", "shard_arrivals": "bigint", "store_version": "bigint"}


def sharded(docs: DataFrame, root: str, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """Append ``docs`` in arrivals (by a hash of doc_id), compact whenever fan_out of them have come, and return the rows as they are then
    stored, with shard, shard_bytes, shard_tier, shard_arrivals (how many arrivals have rows in the shard) and store_version.

    All columns and rows are kept, with nulls, repeated rows and empty texts as they are; columns of these five names are replaced. Keys of any
    type will do. An empty table gives an empty result.
    """
    own = docs.drop(*_ADDED)
    turn = "arrival"
    while turn in own.columns:
        turn += "_"
    store = ShardStore(docs.sparkSession, root, target_bytes, fan_out)
    store.append_arrivals(own.withColumn(turn, F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(arrivals))), turn)
    version = store.compact()
    if not version:
        return own.withColumns({c: F.lit(None).cast(t) for c, t in _ADDED.items()})
    rows = store.read()
    by_shard = rows.groupBy("shard", turn).count().groupBy("shard").agg(F.count("*").alias("shard_arrivals"))
    by_shard, _ = written(by_shard, "shard-arrivals")  # a row a shard: read back, its size is known, so the rows needn't be shuffled to meet it
    tier = F.greatest(F.ceil(F.log(F.lit(float(target_bytes)) / F.col("shard_bytes")) / math.log(fan_out) - 1e-9), F.lit(0)).cast("int")
    return rows.join(by_shard, "shard").withColumns({"shard_tier": tier, "store_version": F.lit(version).cast("bigint")}).select(*own.columns, *_ADDED)
