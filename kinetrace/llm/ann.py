"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

Rows are dealt by a hash of their id to at most SHARDS shards of SHARD_ROWS rows or more (beyond
MOST_ROWS a shard, to more of them), so a search visits few shards however many rows there are. In a shard, equal vectors are
one node. Vectors get one more coordinate, so that nearness by distance is nearness by inner
product. The graph starts at random; in two passes over all nodes, a greedy search from the entry
point proposes neighbours for a node, and pruning keeps the nearest one and drops what is closer
to a kept neighbour (by the factor ALPHA) than to the node, and so on: few, but diverse edges.
Reverse edges are added and pruned alike, and one more edge a node makes every node reachable. A query runs a beam search in every shard; the shards'
best are merged. Scores are computed on the original vectors, in double precision.

A shard and a block of queries are the unit of work, and both are bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.llm.common import Scratch, stable_hash

SHARD_ROWS, SHARDS, MOST_ROWS, QUERY_BLOCK = 8192, 64, 262_144, 4096
DEGREE, ALPHA = 32, 1.2
BUILD_BEAMS, SEARCH_BEAM, EXPAND = (40, 64), 96, 4
#: Searches that run side by side, and the cells that they may mark as seen.
BATCH, SEEN_CELLS = 512, 1 << 25

INDEX = "dim int, shard int, n int, node_of binary, ids binary, vectors binary, graph binary, entry int"
FOUND = "query_id long, vec_id long, score double"


def _distances(points: np.ndarray, at: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances of points[at] (b x m) from targets (b x d)."""
    chosen = points[at]
    return (chosen * chosen).sum(axis=2) - 2 * np.matmul(chosen, targets[:, :, None])[:, :, 0] + (targets * targets).sum(axis=1)[:, None]


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the beam of each target, nearest first; -1 where there is none."""
    b, n = len(targets), len(points)
    pool = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf)
    done = np.ones((b, beam), dtype=bool)
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column takes the -1s
    pool[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _distances(points, pool[:, :1], targets)[:, 0]
    seen[:, entry] = True
    lines = np.arange(b)
    active = lines
    while len(active):
        # the nearest unexpanded nodes of each pool
        order = np.argsort(np.where(done[active], np.inf, dist[active]), axis=1, kind="stable")[:, :EXPAND]
        rows = active[:, None]
        fresh = ~done[rows, order]
        nodes = np.where(fresh, pool[rows, order], -1)
        done[rows, order] = True
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(active), -1)
        # each new node once a line
        near[seen[rows, near]] = -1
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[rows, near] = True
        seen[:, n] = False
        far = np.where(near >= 0, _distances(points, near, targets[active]), np.inf)
        all_nodes = np.concatenate([pool[active], near], axis=1)
        all_dist = np.concatenate([dist[active], far], axis=1)
        all_done = np.concatenate([done[active], near < 0], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        at = np.arange(len(active))[:, None]
        pool[active], dist[active], done[active] = all_nodes[at, best], all_dist[at, best], all_done[at, best]
        active = active[~done[active].all(axis=1)]
    pool[~np.isfinite(dist)] = -1
    return pool, dist


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` diverse neighbours of each node from its candidates (b x c, -1: none)."""
    cand = np.sort(candidates, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == nodes[:, None]] = -1
    own = np.where(cand >= 0, _distances(points, cand, points[nodes]), np.inf)
    chosen = points[cand]
    square = (chosen * chosen).sum(axis=2)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(chosen, chosen.transpose(0, 2, 1))
    alive = np.isfinite(own)
    out = np.full((len(nodes), degree), -1, dtype=np.int64)
    lines = np.arange(len(nodes))
    for k in range(degree):
        pick = np.where(alive, own, np.inf).argmin(axis=1)
        ok = alive[lines, pick]
        if not ok.any():
            break
        out[ok, k] = cand[lines[ok], pick[ok]]
        alive &= ~((alpha * alpha * between[lines, pick] < own) & ok[:, None])
        alive[lines, pick] = False
    return out


def build_graph(points: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """(graph: n x DEGREE + 1 with -1 for none, entry node) over distinct points."""
    n = len(points)
    rng = np.random.default_rng(seed)
    degree = min(DEGREE, max(1, n - 1))
    graph = np.full((n, DEGREE), -1, dtype=np.int64)
    if n == 1:
        return np.full((1, DEGREE + 1), -1, dtype=np.int64), 0
    batch = max(1, min(BATCH, SEEN_CELLS // n))
    graph[:, : degree // 2 + 1] = rng.integers(0, n, (n, degree // 2 + 1))
    centre = points.mean(axis=0)
    entry = int(((points - centre) ** 2).sum(axis=1).argmin())
    for beam, alpha in zip(BUILD_BEAMS, (1.0, ALPHA), strict=True):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            nodes = order[lo : lo + batch]
            pool, _ = beam_search(points, graph, entry, points[nodes], beam)
            graph[nodes] = robust_prune(points, nodes, np.concatenate([pool, graph[nodes]], axis=1), DEGREE, alpha)
            _add_reverse(points, graph, nodes, alpha)
    return np.column_stack([graph, _bridges(points, graph, entry)]), entry


def _bridges(points: np.ndarray, graph: np.ndarray, entry: int) -> np.ndarray:
    """One more edge for some nodes, so that every node can be reached from the entry (-1: none).

    A node that can't be reached gets its edge from the nearest free one of those that its own
    search finds, or else from the last node that was bridged to, which is always free.
    """
    extra = np.full(len(points), -1, dtype=np.int64)
    reached = np.zeros(len(points), dtype=bool)
    last = entry

    def spread(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            near = graph[front].ravel()
            front = np.unique(near[near >= 0])
            front = front[~reached[front]]

    spread(np.array([entry]))
    for node in np.flatnonzero(~reached).tolist():
        if not reached[node]:
            pool = beam_search(points, graph, entry, points[node : node + 1], BUILD_BEAMS[0])[0][0]
            free = pool[(pool >= 0) & (extra[pool] < 0)]
            extra[free[0] if len(free) else last] = node
            last = node
            spread(np.array([node]))
    return extra


def _add_reverse(points: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """An edge back from each new neighbour; where there is no room, the neighbour is pruned again."""
    to, back = graph[nodes].ravel(), np.repeat(nodes, graph.shape[1])
    to, back = to[to >= 0], back[to >= 0]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    heads, first, count = np.unique(to, return_index=True, return_counts=True)
    width = int(min(count.max(), 2 * DEGREE)) if len(count) else 0
    extra = np.full((len(heads), width), -1, dtype=np.int64)
    rank = np.arange(len(to)) - np.repeat(first, count)
    fits = rank < width
    extra[np.repeat(np.arange(len(heads)), count)[fits], rank[fits]] = back[fits]
    for lo in range(0, len(heads), BATCH):
        h = heads[lo : lo + BATCH]
        graph[h] = robust_prune(points, h, np.concatenate([graph[h], extra[lo : lo + BATCH]], axis=1), DEGREE, alpha)


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate that gives all vectors the greatest length."""
    square = (vectors * vectors).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(0, square.max() - square))])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _index_shard(table: pa.Table) -> pa.Table:
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], _matrix(table.column("embedding"), dim)[order]
    distinct, node_of = np.unique(vectors, axis=0, return_inverse=True)
    graph, entry = build_graph(_lifted(distinct))
    by_node = np.argsort(node_of.ravel(), kind="stable")  # ids of a node stay in order
    row = [dim, shard, len(distinct), node_of.ravel()[by_node].astype(np.int32).tobytes(), ids[by_node].tobytes(), distinct.tobytes(), graph.astype(np.int32).tobytes(), entry]
    names = [f.strip().split()[0] for f in INDEX.split(",")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
    return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)


def _searcher(k: int, beam: int) -> Callable:
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        if not index.num_rows or not queries.num_rows:
            return none
        row = {c: index.column(c)[0].as_py() for c in index.column_names}
        n, dim = row["n"], row["dim"]
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        graph = np.frombuffer(row["graph"], np.int32).reshape(n, DEGREE + 1).astype(np.int64)
        ids, node_of = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["node_of"], np.int32)
        starts = np.searchsorted(node_of, np.arange(n + 1))
        points = _lifted(vectors)
        query_ids = queries.column("vec_id").to_numpy().astype(np.int64)
        targets = _matrix(queries.column("embedding"), dim)
        scale = np.sqrt((points[0] ** 2).sum())
        unit = targets / np.sqrt((targets * targets).sum(axis=1))[:, None] * scale
        unit = np.column_stack([unit, np.zeros(len(unit))])
        out: list[tuple] = []
        batch = max(1, min(BATCH, SEEN_CELLS // n))
        for lo in range(0, len(query_ids), batch):
            pool, _ = beam_search(points, graph, row["entry"], unit[lo : lo + batch], beam)
            for r, nodes in enumerate(pool):
                q = query_ids[lo + r]
                nodes = nodes[nodes >= 0]
                score = (vectors[nodes] * targets[lo + r]).sum(axis=1)
                # of a node k + 1 ids are enough: the least ones, one of which may be the query's own
                take = [ids[starts[x] : min(starts[x + 1], starts[x] + k + 1)] for x in nodes]
                flat = np.concatenate(take)
                value = np.repeat(score, [len(t) for t in take])
                flat, value = flat[flat != q], value[flat != q]
                best = np.lexsort((flat, -value))[:k]
                out.append((np.full(len(best), q), flat[best], value[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return search


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, dim) without rows that take no part: id or vector null, zero,
    empty, or with null or non-finite components. Rows that agree in id and vector count once."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some)
    return rows.dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each query row.

    A query's own id is no candidate; ties go to the smaller vec_id; vectors of other dimensions
    don't meet. Fewer than k candidates give all of them; empty tables give no rows.
    """
    scratch = Scratch(embeddings.sparkSession)
    rows = scratch.keep(usable(embeddings), "rows")
    shards = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select(F.col("dim").alias("_dim"), F.ceil(F.col("n") / F.least(F.lit(MOST_ROWS), F.greatest(F.lit(shard_rows), F.col("n") / SHARDS))).cast("int").alias("shards"))
    asked = usable(queries)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dealt = rows.join(F.broadcast(shards), F.col("dim") == F.col("_dim")).withColumn("shard", F.pmod(stable_hash(21, "vec_id"), F.col("shards")).cast("int"))
    index = scratch.keep(dealt.select("dim", "shard", "vec_id", "embedding").groupBy("dim", "shard").applyInArrow(_index_shard, INDEX), "index")
    # every shard meets every block of queries: both sides name the pair
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = index.withColumn("block", every)
    right = asked.withColumn("block", F.pmod(stable_hash(22, "vec_id"), F.lit(blocks)).cast("int")).join(F.broadcast(shards), F.col("dim") == F.col("_dim"))
    right = right.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).select("dim", "shard", "block", "vec_id", "embedding")
    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searcher(k, beam), FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by 20, against all rows."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0), 20)
