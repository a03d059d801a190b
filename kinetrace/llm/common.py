"""Shared parts of the corpus operators: scratch tables, byte-level text kernels, hash ranks.

Everything here works on bounded chunks of an Arrow batch, so the memory of a Python worker
depends on the chunk size (and the longest single text), never on the size of a partition.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (arithmetic is modulo 2**64).
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
NGRAM_BASE = U64(0xD6E8FEB86659FD93)
#: Texts are processed in chunks of about this many bytes.
CHUNK_BYTES = 1 << 20


class Scratch:
    """Tables in the folder that the cluster shares (spark.checkpoint.dir).

    A written table cuts lineage: a lost executor costs only the tasks of the current step.
    Only in local mode (tests, a laptop) a temporary folder stands in where the setting is absent.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _fallback_dir(spark)
        self.spark, self.root = spark, f"{base.rstrip('/')}/kinetrace-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df and read it back; shuffle files of the finished step are released."""
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def release(self) -> None:
        """Let the driver notice that finished shuffles are garbage, so executors delete them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


_FALLBACK: list[str] = []


def _fallback_dir(spark: SparkSession) -> str:
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="kinetrace-"))
    return _FALLBACK[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * CHUNK_BYTES), base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


class PrefixHash:
    """Hashes of any byte ranges of one chunk in constant time each."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        table = mix64(np.arange(256, dtype=U64) + U64(1 + 1000 * seed))
        self.sums = np.empty(len(data) + 1, dtype=U64)
        self.sums[0] = 0
        np.cumsum(table[data] * powers(len(data)), out=self.sums[1:])
        self.inverse = powers(len(data) + 1, BASE_INV)

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(U64))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of runs of rows of about limit bytes.

    Null counts as empty. Nothing is copied; a text over the limit is a chunk of its own.
    """
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    _, offset_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offset_buf, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """Maximal runs of word bytes in a chunk: starts, ends, hashes and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        n = len(data)
        inside = is_word[data]
        if n:
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            heads = offsets[:-1]
            heads = heads[heads < n]
            first[heads] = inside[heads]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            tails = offsets[1:] - 1
            tails = tails[tails >= 0]
            last[tails] = inside[tails]
            self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.starts, offsets)  # words of row r: bounds[r] .. bounds[r + 1]
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hashes = PrefixHash(data).ranges(self.starts, self.ends) if len(self.starts) else np.zeros(0, U64)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of n words within a row."""
        m = len(self.starts) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        total, weight = np.zeros(m, U64), U64(1)
        for j in range(n):
            total += self.hashes[j : j + m] * weight
            weight = U64((int(weight) * int(NGRAM_BASE)) & 0xFFFFFFFFFFFFFFFF)
        return at, mix64(total[at] + U64(n))


#: Code points from here on are no letters (none is assigned); the last one below stands for them.
CODE_POINTS = 0x34000
_LOWER_CASE = np.array([ord(c) if len(c := chr(i).lower()) == 1 and not 0xD800 <= i < 0xE000 else i for i in range(CODE_POINTS)], dtype=np.uint32)
#: Letters and digits; letters only.
_ALNUM = np.array([not 0xD800 <= i < 0xE000 and chr(i).isalnum() for i in range(CODE_POINTS)])
IS_LETTER = np.array([not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(CODE_POINTS)])


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points (below CODE_POINTS) and offsets in characters."""
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return _LOWER_CASE[np.minimum(cp, CODE_POINTS - 1)], heads[offsets]


def word_bounds(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (with an end mark)."""
    inside = _ALNUM[cp]
    if not len(cp):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1], offsets[1:] - 1
    heads, tails = heads[heads < len(cp)], tails[tails >= 0]
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def guarded(df: DataFrame, known: list[str], replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """df without the replaced columns and with all but the known ones renamed, so that names of a
    caller's columns can't clash with an operator's own; the inner names and the caller's."""
    names = [c for c in df.columns if c not in replaced]
    inner = [c if c in known else f"_c{i}" for i, c in enumerate(names)]
    return df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)]), inner, names


def stable_hash(seed: int, *cols: Column | str) -> Column:
    """A non-negative 63-bit hash of the columns, the same wherever a row is computed again."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 63) - 1))


def group_ranks(df: DataFrame, group: list[str], order: str, ties: list[str], blocks: int, rank: str) -> DataFrame:
    """Rank from 0 of each row in its group by a uniform 63-bit column, without one task per group.

    The hash range is cut into equal blocks. Counts of (group, block) become starting ranks, so
    the sort runs over (group, block): a group with a third of all rows is cut like any other.
    """
    width = ((1 << 63) - 1) // blocks + 1
    with_block = df.withColumn("_block", F.floor(F.col(order) / F.lit(width)).cast("int"))
    counts = with_block.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_s_{g}") for g in group], F.col("_block").alias("_s_block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_block").orderBy(order, *ties)
    ranked = with_block.withColumn("_rank", F.row_number().over(inside))
    match = [F.col(g).eqNullSafe(F.col(f"_s_{g}")) for g in group] + [F.col("_block") == F.col("_s_block")]
    joined = ranked.join(starts, on=_all(match), how="left")
    return joined.withColumn(rank, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_block", "_rank", "_start", "_s_block", *[f"_s_{g}" for g in group])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def blocks_for(rows: int, per_block: int = 250_000, least: int = 8) -> int:
    return max(least, -(-rows // per_block))
