"""Operators on frames: layouts, slices, per-frame aggregates, time axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Topologies, references and other tables of one row an atom are broadcast up to so many rows.
BROADCAST_ROWS = 2_000_000
UNITS = {"ps": 1.0, "ns": 1e-3, "fs": 1e3, "us": 1e-6}


def small(df: DataFrame) -> DataFrame:
    """df marked for a broadcast, if it is counted and found small enough; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def system(table: DataFrame) -> list[str]:
    """["system_id"], or nothing: a table without that column holds for every system."""
    return ["system_id"] if "system_id" in table.columns else []


def atom_key(table: DataFrame) -> list[str]:
    """The columns that an atom of the table is known by."""
    return [*system(table), "atom_idx"]


def long_coords(frames: DataFrame) -> DataFrame:
    """One row for each frame and atom from wide frames (xyz of 3 numbers an atom)."""
    at = F.posexplode(F.sequence(F.lit(0), F.floor(F.size("xyz") / 3).cast("int") - 1))
    wide = frames.where(F.size("xyz") >= 3).select("system_id", "frame_id", "xyz", at.alias("atom_idx", "_i"))
    take = lambda k: F.element_at("xyz", 3 * F.col("atom_idx") + k).cast("double")
    return wide.select("system_id", "frame_id", F.col("atom_idx").cast("int").alias("atom_idx"), take(1).alias("x"), take(2).alias("y"), take(3).alias("z"))


def wide_frames(coords: DataFrame) -> DataFrame:
    """(system_id, frame_id, xyz): the atoms of a frame in order, as one array."""
    rows = F.sort_array(F.collect_list(F.struct("atom_idx", F.array("x", "y", "z").alias("p"))))
    return coords.groupBy("system_id", "frame_id").agg(F.flatten(F.transform(rows, lambda r: r["p"])).alias("xyz"))


def keep_atoms(coords: DataFrame, atoms: DataFrame) -> DataFrame:
    """coords of the atoms only."""
    return coords.join(small(atoms.select(*atom_key(atoms))), atom_key(atoms), "left_semi")


def info(atoms: DataFrame, bonds: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: n_atoms, n_residues, n_bonds, n_frames."""
    a = atoms.agg(F.count(F.lit(1)).alias("n_atoms"), F.count_distinct("residue_id").alias("n_residues"))
    return a.crossJoin(bonds.agg(F.count(F.lit(1)).alias("n_bonds"))).crossJoin(frames.agg(F.count_distinct("frame_id").alias("n_frames")))


def weighted(coords: DataFrame, atoms: DataFrame, use_mass: bool = True) -> DataFrame:
    """coords with a weight w: masses where those of the topology add up to more than 0, else 1."""
    if not use_mass:
        return keep_atoms(coords, atoms).withColumn("w", F.lit(1.0))
    total = F.sum(F.col("mass").cast("double")).over(Window.partitionBy(*(system(atoms) or [F.lit(0)])))
    weights = atoms.select(*atom_key(atoms), F.when(total > 0, F.col("mass").cast("double")).otherwise(1.0).alias("w"))
    return coords.join(small(weights), atom_key(atoms))


def centroid(coords: DataFrame) -> DataFrame:
    """cx, cy, cz of each frame by the weight w; all weights 0 count as 1."""
    return _by_weight(coords, lambda w: [(F.sum(w * F.col(a)) / F.sum(w)).alias(f"c{a}") for a in "xyz"])


def _by_weight(coords: DataFrame, aggregates) -> DataFrame:
    return coords.groupBy("system_id", "frame_id").agg(*aggregates(F.col("w")))


def radius_of_gyration(coords: DataFrame) -> DataFrame:
    """rg of each frame by the weight w: a second look after the centre, for the sake of precision."""
    centre = centroid(coords)
    square = sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    both = coords.join(centre, ["system_id", "frame_id"])
    return both.groupBy("system_id", "frame_id").agg(F.sqrt(F.sum(F.col("w") * square) / F.sum("w")).alias("rg"))


def frame_number(frames: DataFrame, index: int) -> int | None:
    """The frame_id at a position of the trajectory; negative positions count from the end."""
    order = F.col("frame_id").asc() if index >= 0 else F.col("frame_id").desc()
    rows = frames.select("frame_id").distinct().orderBy(order).limit(index + 1 if index >= 0 else -index).tail(1)
    return rows[0]["frame_id"] if rows else None


def reference(coords: DataFrame, frame_id: int) -> DataFrame:
    """(system_id, atom_idx, rx, ry, rz): the frame of this number of each system.

    Every system is compared with its own; without the column system_id, all with this one.
    """
    return coords.where(F.col("frame_id") == frame_id).select("system_id", "atom_idx", *[F.col(a).alias(f"r{a}") for a in "xyz"])


def first_reference(coords: DataFrame) -> DataFrame:
    """(system_id, atom_idx, rx, ry, rz) of each system's first frame."""
    first = coords.groupBy("system_id").agg(F.min("frame_id").alias("frame_id"))
    return coords.join(small(first), ["system_id", "frame_id"]).select("system_id", "atom_idx", *[F.col(a).alias(f"r{a}") for a in "xyz"])


def rmsd_unaligned(coords: DataFrame, ref: DataFrame) -> DataFrame:
    """rmsd of each frame to the reference as it lies, by the weight w."""
    square = sum(((F.col(a) - F.col(f"r{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    return coords.join(small(ref), atom_key(ref)).groupBy("system_id", "frame_id").agg(F.sqrt(F.sum(F.col("w") * square) / F.sum("w")).alias("rmsd"))


def slice_frames(frames: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames by position (as Python slices count), numbered anew from 0; source_frame keeps the old id."""
    place = frames.select("system_id", "frame_id").distinct()
    w = Window.partitionBy("system_id").orderBy("frame_id")
    place = place.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("system_id")))
    lo = _bound(start, F.lit(0))
    hi = _bound(stop, F.col("_n"))
    kept = place.where((F.col("_at") >= lo) & (F.col("_at") < hi) & ((F.col("_at") - lo) % step == 0)).withColumn("_new", F.row_number().over(w) - 1)
    out = frames.join(kept.select("system_id", "frame_id", "_new"), ["system_id", "frame_id"])
    return out.withColumn("source_frame", F.col("frame_id")).withColumn("frame_id", F.col("_new").cast("long")).drop("_new")


def _bound(value: int | None, default: Column) -> Column:
    if value is None:
        return default
    return F.lit(value) if value >= 0 else F.greatest(F.lit(0), F.col("_n") + value)


def pick_frames(frames: DataFrame, ids: list[int]) -> DataFrame:
    """The listed frames in list order, numbered anew."""
    order = F.array_position(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("frame_id").cast("long")) - 1
    return frames.where(F.col("frame_id").isin(ids)).withColumn("source_frame", F.col("frame_id")).withColumn("frame_id", order.cast("long"))


def time_axis(times: DataFrame, dt: float | None = None, unit: str = "ps") -> DataFrame:
    """(system_id, frame_id, t, label) from (system_id, frame_id, time_ps).

    With dt the time is dt * position; else the stored times are converted, unless they only
    count frames (0 .. n - 1, or all 0), which gives positions under the label Frame.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown time unit {unit!r}")
    if dt is not None and dt <= 0:
        raise ValueError("dt must be above 0")
    w = Window.partitionBy("system_id").orderBy("frame_id")
    every = Window.partitionBy("system_id")
    at = times.withColumn("_at", F.row_number().over(w) - 1)
    if dt is not None:
        return at.select("system_id", "frame_id", (F.col("_at") * dt).alias("t"), F.lit(f"Time ({unit})").alias("label"))
    counts = (F.min(F.col("time_ps") == F.col("_at")).over(every) & (F.count(F.lit(1)).over(every) >= 2)) | F.min(F.col("time_ps") == 0).over(every)
    flagged = at.withColumn("_plain", counts)
    return flagged.select("system_id", "frame_id", F.when(F.col("_plain"), F.col("_at").cast("double")).otherwise(F.col("time_ps") * UNITS[unit]).alias("t"), F.when(F.col("_plain"), "Frame").otherwise(f"Time ({unit})").alias("label"))
