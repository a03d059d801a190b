"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix (native).

Rows are dealt to P partitions by a hash of the row. If all rows were shuffled uniformly and cut
into S shards of fixed sizes, the numbers of rows that go from each partition to each shard would
be distributed as draws without replacement. Those P x S counts are drawn exactly; then every
partition permutes its rows locally and sends the drawn number to each shard, and every shard
permutes what it received. The result is distributed as a uniform shuffle cut at the shard sizes,
and the sizes are exact: any two differ by one row at most.

The main path has DataFrame functions only. The driver sees one count for each partition: P is
bounded by MAX_PARTITIONS, so the matrix (P x S integers, sent as one literal) is bounded too.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.common import Scratch, blocks_for, group_ranks, guarded, stable_hash

MAX_PARTITIONS = 4096
ROWS_PER_PARTITION = 250_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items drawn without replacement are good.

    Inversion outward from the mode with log-gamma weights: the expected number of steps is
    proportional to the standard deviation. The weights have the precision of doubles: relative
    errors of about 1e-10 for a million items, 3e-5 for ten thousand million.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(total, draws))
    u = rng.random() - p_mode
    up = down = mode
    p_up = p_down = p_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """counts[p][s], with row sums parts and column sums shards, as a uniform shuffle would give."""
    rng = random.Random(seed)
    free = list(shards)
    matrix = []
    for size in parts:
        left, pool, row = size, sum(free), []
        for s, room in enumerate(free):
            pool -= room
            take = hypergeometric(rng, room, pool, left)
            row.append(take)
            free[s] -= take
            left -= take
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, n_shards: int) -> list[int]:
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def shard(df: DataFrame, n_shards: int, row_hash: list[str], seed: int = 7) -> DataFrame:
    """Add shard (0 .. n_shards - 1) and slot (gapless from 0 in each shard) to every row.

    row_hash names the columns that tell rows apart; rows that agree in all of them are
    interchangeable, and which of them gets which place is then not defined, but every row is
    kept. Nulls hash like any value. An empty table gives an empty table. Existing columns
    shard or slot are replaced.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    df, inner, names = guarded(df, row_hash, ("shard", "slot"))
    keyed = df.withColumn("_h1", stable_hash(seed, *row_hash)).withColumn("_h2", stable_hash(seed + 1, *row_hash))
    keyed = scratch.keep(keyed, "keyed")
    rows = keyed.count()
    n_parts = min(MAX_PARTITIONS, max(16, -(-rows // ROWS_PER_PARTITION)))
    keyed = keyed.withColumn("_p", F.pmod(F.xxhash64(F.lit(seed + 2), "_h1"), F.lit(n_parts)).cast("int"))
    sizes = {r["_p"]: r["n"] for r in keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(n_parts)], shard_sizes(rows, n_shards), seed)
    # ends[p][s]: local ranks below it go to shard s or a lower one
    ends = []
    for row in matrix:
        total, line = 0, []
        for n in row:
            total += n
            line.append(total)
        ends.append(line)
    table = F.from_json(F.lit(str(ends)), "array<array<bigint>>")
    ranked = group_ranks(keyed, ["_p"], "_h1", ["_h2", *row_hash], blocks_for(rows // n_parts), "_r")
    line = F.element_at(table, F.col("_p") + 1)
    placed = ranked.withColumn("shard", F.size(F.filter(line, lambda end: end <= F.col("_r"))).cast("int"))
    blocks = blocks_for(-(-rows // n_shards), least=4)
    out = group_ranks(placed.drop("_r", "_p"), ["shard"], "_h2", ["_h1", *row_hash], blocks, "slot")
    return out.select(*inner, "shard", "slot").toDF(*names, "shard", "slot")


def shard_documents(documents: DataFrame, n_shards: int = 40, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """The digest of a sharding of documents by the law `rows`.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 the unsigned CRC-32 of those
    bytes (null: of none). Columns to carry tell rows apart too, and follow. Only these narrow
    columns move between executors; the texts stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), *carry)
    out = shard(narrow, n_shards, ["doc_id", "size", "text_crc32", *carry], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *carry)
