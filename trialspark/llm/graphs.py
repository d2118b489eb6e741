"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task joins by itself: rounds of tiny shuffles would take longer. What is found is the same.
FEW = 20_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of a task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([root(x) for x in nodes], np.int64))], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node that links reach.

    Self-loops and null ends are ignored. Each round is two grouped minima joined back to the edges, so a
    hub is split by the adaptive skew join and pre-aggregated before its shuffle; rounds are logarithmic in
    the longest path. Rows of each round go to the shared folder. Up to `few` edges are joined by one task.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = cut(e), None
    if e.count() <= few:
        return e.coalesce(1).mapInArrow(joined, "node bigint, root bigint")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u")
        e = e.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(e.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        seen = Observation()
        e = cut(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        now = (seen.get["n"], seen.get["h"])
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
