"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows in one Arrow batch sent to Python. Documents can be long, so batches are kept short.
BATCH_ROWS = 500


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch length to ``rows`` if it is longer, so a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shuffle_width(spark: SparkSession) -> int:
    """Number of reducers, as the session is set; a cluster for more data has more."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the source for each bucket of distinct words, lines or n-grams, which one task holds at a time.
BUCKET_BYTES = 8 << 20
#: Most buckets, and most reducers that they are dealt to.
MOST_BUCKETS, MOST_REDUCERS = 1 << 20, 20_000


def source_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads, as the planner knows it; sources of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def bucket_count(df: DataFrame) -> int:
    """Number of buckets: as many as the session has reducers, more where the source is large for them."""
    return max(shuffle_width(df.sparkSession), min(MOST_BUCKETS, -(-source_bytes(df) // BUCKET_BYTES)))


def reducer_count(spark: SparkSession, buckets: int) -> int:
    """Number of reducers that so many buckets are dealt to."""
    return min(buckets, max(shuffle_width(spark), MOST_REDUCERS))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests),
    an error on a cluster, whose machines don't share such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/wordloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. Returns the path too."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer needed, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's garbage collectors find finished shuffles, whose files executors then delete. Nothing that is in use is touched.

    Python's comes first: data frames are part of cycles, and hold on to the plans of the JVM until they are collected.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as bigint and text, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def binaries(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())
