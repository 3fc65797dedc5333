"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join (Kiveris et al., 2014); the number of steps grows with the
logarithm of the longest path. Tasks first shorten the paths that lie within their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import shared


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node of the links that isn't the least itself."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    top = np.fromiter((root(x) for x in range(len(nodes))), np.int64, len(nodes))
    moved = top != np.arange(len(nodes))
    return nodes[moved], nodes[top[moved]]


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        a, b = local_roots(*np.concatenate(held, axis=1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size >= 1_000_000:
            yield flush()
            size = 0
    if held:
        yield flush()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b, each node's neighbours linked to the least of them."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return around.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component): the least id that links reach, for each id that isn't the least itself.

    `links` has long columns a and b, in any order; loops and repeated links do no harm.
    """
    shared.ship(spark)
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    now = shared.written(spark, pairs.mapInArrow(_shorten, "a long, b long").distinct(), "links")
    mark = None
    while True:
        now = shared.written(spark, _star(_star(now, True), False), "links")
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = (n, total)
