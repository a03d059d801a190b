"""A trajectory laid over the embeddings table: every vector is a frame of 21 atoms.

Atom i sits on a helix, displaced by 0.8 times the vector's numbers 3 i .. 3 i + 2. Constants and
names are fixed, and the same view is stated for Spark and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_ATOMS, BOX = 21, 12.0
NAMES, ELEMENTS, MASSES = ("N", "H", "O", "C", "CA"), ("N", "H", "O", "C", "C"), (14.01, 1.008, 16.0, 12.01, 12.01)
RESIDUES = ("ALA", "GLY", "SER", "WAT", "ALA")


def atoms(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    kind, residue = i % 5, F.floor(i / 5).cast("int")
    base = [F.round(6 * F.cos(0.2 * i), 3).alias("bx"), F.round(6 * F.sin(0.2 * i), 3).alias("by"), F.round(0.1 * i, 3).alias("bz")]
    return spark.range(N_ATOMS).select(i.alias("atom_idx"), pick(NAMES, kind).alias("atom_name"), pick(ELEMENTS, kind).alias("element"), (residue + 1).alias("residue_id"), pick(RESIDUES, residue).alias("residue_name"), pick(MASSES, kind).alias("mass"), *base)


def bonds(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(N_ATOMS - 1).where("id % 5 <> 4").select(i.alias("i"), (i + 1).alias("j"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("embedding").isNotNull())


def coords(spark: SparkSession, sf_dir: str, last_frame: int | None = None) -> DataFrame:
    v = vectors(spark, sf_dir)
    if last_frame is not None:
        v = v.where(F.col("vec_id") <= last_frame)
    base = [tuple(r) for r in atoms(spark).orderBy("atom_idx").select("atom_idx", "bx", "by", "bz").collect()]
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for i, x, y, z in base]))
    place = lambda k, a: (F.col(f"b.{a}") + 0.8 * F.element_at("embedding", 3 * F.col("b.i") + k).cast("double")).alias(a)
    return v.withColumn("b", table).select(F.col("label").cast("int").alias("system_id"), F.col("vec_id").alias("frame_id"), F.col("b.i").alias("atom_idx"), place(1, "x"), place(2, "y"), place(3, "z"))


def wrapped(spark: SparkSession, sf_dir: str, last_frame: int | None = None) -> DataFrame:
    """coords folded into the box, which splits molecules."""
    return coords(spark, sf_dir, last_frame).select("system_id", "frame_id", "atom_idx", *[(F.col(a) - BOX * F.floor(F.col(a) / BOX)).alias(a) for a in "xyz"])


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    diagonal = F.array(*[F.lit(BOX if k % 4 == 0 else 0.0) for k in range(9)])
    return vectors(spark, sf_dir).select(F.col("label").cast("int").alias("system_id"), F.col("vec_id").alias("frame_id"), diagonal.alias("box"))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("label").cast("int").alias("system_id"), F.col("vec_id").alias("frame_id"), (F.col("vec_id") * 2.0).alias("time_ps"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, x, y): the events of each type in order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return e.select(F.col("event_type").alias("system"), at.cast("double").alias("x"), F.col("value").alias("y"))


SQL = """
topo AS (SELECT CAST(i AS INTEGER) AS atom_idx, ['N','H','O','C','CA'][i % 5 + 1] AS atom_name, ['N','H','O','C','C'][i % 5 + 1] AS element,
  CAST(i // 5 + 1 AS INTEGER) AS residue_id, ['ALA','GLY','SER','WAT','ALA'][i // 5 + 1] AS residue_name,
  CAST([14.01, 1.008, 16.0, 12.01, 12.01][i % 5 + 1] AS DOUBLE) AS mass,
  round(6 * cos(CAST(0.2 AS DOUBLE) * i), 3) AS bx, round(6 * sin(CAST(0.2 AS DOUBLE) * i), 3) AS by_, round(CAST(0.1 AS DOUBLE) * i, 3) AS bz
  FROM range(21) t(i)),
bonds AS (SELECT CAST(i AS INTEGER) AS i, CAST(i + 1 AS INTEGER) AS j FROM range(20) t(i) WHERE i % 5 <> 4),
coords AS (SELECT CAST(label AS INTEGER) AS system_id, vec_id AS frame_id, atom_idx,
  bx + CAST(0.8 AS DOUBLE) * CAST(embedding[3 * atom_idx + 1] AS DOUBLE) AS x, by_ + CAST(0.8 AS DOUBLE) * CAST(embedding[3 * atom_idx + 2] AS DOUBLE) AS y,
  bz + CAST(0.8 AS DOUBLE) * CAST(embedding[3 * atom_idx + 3] AS DOUBLE) AS z
  FROM embeddings, topo WHERE embedding IS NOT NULL),
wrapped AS (SELECT system_id, frame_id, atom_idx, x - 12.0 * floor(x / 12.0) AS x, y - 12.0 * floor(y / 12.0) AS y, z - 12.0 * floor(z / 12.0) AS z FROM coords),
series AS (SELECT event_type AS system, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS DOUBLE) AS x, value AS y FROM events)
"""
