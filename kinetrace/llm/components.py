"""Connected components of an edge table: in one task up to a fixed size, else by alternating
large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


#: Tables of at most this many edges (16 bytes each) are solved by one task on an executor.
SMALL_EDGES = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
            parent[max(a, b)] = min(a, b)  # the root of a component is its least node
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node that an edge (u, v) touches; root is the component's least node.

    Self-loops and repeated edges don't matter. Every step is a written table, groups are only
    ever summed up (never gathered) beyond SMALL_EDGES, and no edge comes to the driver.
    """
    if edges.count() <= SMALL_EDGES:
        return edges.where("u != v").coalesce(1).mapInArrow(_union_find, "node long, root long")
    current = scratch.keep(edges.where("u != v").select("u", "v").distinct(), f"{name}_0")
    state, step = None, 0
    while True:
        nxt = scratch.keep(_small_star(_large_star(current)), f"{name}_{step + 1}")
        seen = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        scratch.drop(f"{name}_{step}")
        current, step = nxt, step + 1
        if seen == state or not seen[0]:
            break
        state = seen
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
