"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Each half step is an aggregation of minima and an equi-join, both over tables in the shared folder: the lineage stays short
and a hot vertex's rows can be split by the adaptive join. The number of rows never grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm._common import drop_folder, written


def forest(a: list, b: list) -> tuple[list, list]:
    """Vertices other than the least of their component, and that least, of the given links."""
    parent: dict = {}

    def top(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    low = list(parent)
    return low, [top(x) for x in low]


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's links as stars around the least vertex of the partition's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) > 1_000_000:
                a, b = forest(a, b)
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, root) of each vertex with a link, root being the least vertex of its component; edges: (a, b), bigint.

    Loops and repeated links are allowed; links with a null are ignored. Raises an error if the stars aren't finished after
    ``most_rounds``, which grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    own = edges.select(edges.columns[0], edges.columns[1]).toDF("a", "b").where("a is not null and b is not null and a <> b")
    e, path = written(_contracted(own), "links")
    mark = _mark(e)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low, p1 = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "large-min")
        large, p2 = written(both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low, p3 = written(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e, p4 = written(small, "links")
        for old in (path, p1, p2, p3):
            drop_folder(spark, old)
        path, before, mark = p4, mark, _mark(e)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components are not finished after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(roots)


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")).collect()[0]
    return r["n"], r["h"], r["s"]


def linked_labels(link: np.ndarray) -> np.ndarray:
    """Least index of each row's component, of a symmetric boolean matrix."""
    label = np.arange(len(link))
    while True:
        low = np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link))
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
