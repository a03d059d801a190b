"""Mixing sources to target weights by Pfair scheduling of blocks.

The rows of a source, in a hashed order, are cut into blocks of block_rows. While a set of sources
is active, source s with the share w of the total weight may place its j-th block of the phase from
slot floor((j - 1) / w) (release) and must have placed it by slot ceil(j / w) (deadline). Every slot
takes the released block with the earliest deadline. After any number of slots t of a phase, each
source has placed between w t - 1 and w t + 1 blocks (strictly). When a source has no block left,
the phase ends and the others share the weight in proportion. Every row gets exactly one place.

Weights are taken exactly: floats are fractions, and releases and deadlines come from integers. The
blocks are scheduled on the driver one after another, in pieces of at most PIECE_SLOTS that are
written before the next one starts: its time grows with the blocks, its memory with the sources only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.llm.common import Scratch, blocks_for, group_ranks, guarded, stable_hash

BLOCK_ROWS = 16
#: The driver holds this many slots at once; a row of the plan has up to CHUNK blocks of a source.
PIECE_SLOTS, CHUNK = 250_000, 1024
#: The plan is broadcast up to this many slots; beyond, it is joined by a shuffle.
BROADCAST_SLOTS = 2_000_000
PLAN = pa.schema([("_plan_source", pa.string()), ("_plan_chunk", pa.int64()), ("_plan_first", pa.int64()), ("_plan_phase", pa.list_(pa.int32())), *((f"_plan_{c}", pa.list_(pa.int64())) for c in ("slot", "release", "deadline"))])


def whole(weights: Mapping[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def earliest_deadline(shares: Mapping[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """The schedule without an end: source, number from 1, release and deadline of each slot's block."""
    total = sum(shares.values())
    waiting = [(0, s, 1) for s in sorted(shares)]
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // shares[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, release, deadline
        heapq.heappush(waiting, (j * total // shares[s], s, j + 1))
        slot += 1


def period(shares: Mapping[str, int]) -> list[str]:
    """The source of each slot until the schedule of these shares repeats itself."""
    return [s for s, *_ in islice(earliest_deadline(shares), sum(shares.values()))]


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """Source, phase, block, slot, release and deadline of every block, in the order of slots."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    start = phase = 0
    while left:
        taken = dict.fromkeys(left, 0)
        for slot, (s, j, release, deadline) in enumerate(earliest_deadline(whole({s: weights[s] for s in left})), start):
            yield s, phase, used[s] + j - 1, slot, start + release, start + deadline
            taken[s] = j
            if j == left[s]:
                break
        for s, n in taken.items():
            used[s] += n
        left = {s: n - taken[s] for s, n in left.items() if n > taken[s]}
        start, phase = slot + 1, phase + 1


def plan_table(placed: Iterable[tuple]) -> pa.Table:
    """Rows of PLAN: consecutive blocks of a source, none across a multiple of CHUNK."""
    rows: dict[tuple[str, int], tuple] = {}
    for s, phase, block, *times in placed:
        row = rows.setdefault((s, block // CHUNK), (block, [], [], [], []))
        for values, x in zip(row[1:], (phase, *times)):
            values.append(x)
    columns = list(zip(*((*key, *row) for key, row in rows.items()))) or [()] * len(PLAN)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, PLAN)], schema=PLAN)


def tempered(rows: Mapping[str, int], exponent: float = 0.5) -> dict[str, float]:
    """Default weights: the square root of each source's rows, which lifts small sources."""
    return {s: n**exponent for s, n in rows.items()}


def mix(documents: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 5) -> DataFrame:
    """documents with block, phase, slot, in_block, release and deadline.

    Sorting by (slot, in_block) gives the mixture. Rows without a source are a source of their
    own, named in weights by None. weights need positive values for every source (the default is
    tempered row counts). Equal rows are interchangeable; an empty table gives an empty table;
    existing columns of these names are replaced. The driver holds one count for each source.
    """
    spark = documents.sparkSession
    names = ("block", "phase", "slot", "in_block", "release", "deadline")
    docs, inner, given = guarded(documents, ["doc_id", "source", "text"], names)
    # "=" before a name keeps a missing source apart from any that is named
    docs = docs.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    docs = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if "text" in docs.columns else F.lit(0).cast("long"))
    scratch = Scratch(spark)
    narrow = scratch.keep(docs.groupBy("_source").agg(F.count(F.lit(1)).alias("n")), "mix_counts")
    rows = {r["_source"]: r["n"] for r in narrow.collect()}
    wanted = tempered(rows) if weights is None else {"" if s is None else f"={s}": float(w) for s, w in weights.items()}
    missing = [s for s in rows if not 0 < wanted.get(s, 0) < math.inf]
    if missing:
        raise ValueError(f"no positive weight for the sources {missing[:5]}")
    blocks = {s: -(-n // block_rows) for s, n in rows.items()}
    table = _plan(scratch, schedule(blocks, wanted))
    if sum(blocks.values()) <= BROADCAST_SLOTS:
        table = F.broadcast(table)
    docs = docs.withColumn("_h", stable_hash(seed, "doc_id", "_key"))
    ranked = group_ranks(docs, ["_source"], "_h", ["doc_id", "_key"], blocks_for(max(rows.values(), default=0)), "_r")
    ranked = ranked.withColumn("block", F.floor(F.col("_r") / block_rows).cast("long")).withColumn("in_block", (F.col("_r") % block_rows).cast("int"))
    at = F.col("block") - F.col("_plan_first")
    chunk = F.floor(F.col("block") / CHUNK).cast("long")
    placed = ranked.join(table, (F.col("_source") == F.col("_plan_source")) & (chunk == F.col("_plan_chunk")) & (at >= 0) & (at < F.size("_plan_slot")))
    out = placed.select("*", *[F.element_at(f"_plan_{c}", (at + 1).cast("int")).alias(c) for c in ("phase", "slot", "release", "deadline")])
    return out.select(*inner, *names).toDF(*given, *names)


def _plan(scratch: Scratch, placed: Iterator[tuple]) -> DataFrame:
    """The table of PLAN; all but a single piece go to the scratch folder."""
    spark, path, piece = scratch.spark, f"{scratch.root}/mix_plan", list(islice(placed, PIECE_SLOTS))
    table = spark.createDataFrame(plan_table(piece))
    if len(piece) < PIECE_SLOTS:
        return table
    while piece:
        spark.createDataFrame(plan_table(piece)).write.mode("append").parquet(path)
        piece = list(islice(placed, PIECE_SLOTS))
    return spark.read.schema(table.schema).parquet(path)


def digest(documents: DataFrame) -> DataFrame:
    narrow = documents.select("doc_id", "source", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    return mix(narrow).drop("text_key")


def mixed_order(documents: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """documents, all rows and the same columns, in the order of the mixture.

    Once written, written_order() tells the order again.
    """
    docs, inner, names = guarded(documents, ["doc_id", "text", "source"])
    return mix(docs, weights).orderBy("slot", "in_block").select(*inner).toDF(*names)


def written_order(written: DataFrame, name: str = "mixture_slot") -> DataFrame:
    """written with each row's place (from 0) in the order in which its table was written.

    The files of a sorted table follow each other by name, and the rows in each file; one count a
    file tells where it starts. Null for a table that wasn't read from files. A column of this
    name is replaced.
    """
    if not written.inputFiles():
        return written.withColumn(name, F.lit(None).cast("long"))
    docs, inner, names = guarded(written, [], (name,))
    at = docs.select(*inner, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = at.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_start"))
    return at.join(starts, "_file").select(*inner, (F.col("_start") + F.col("_row")).alias(name)).toDF(*names, name)
