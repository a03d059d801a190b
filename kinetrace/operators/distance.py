"""Distance joins: grid-cell equi-joins with a residual distance test; hydrogen bonds and surfaces."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.functions.selection import vdw_radius
from kinetrace.operators.frames import atom_key, small, system

KEY = ["system_id", "frame_id"]
PROBE, SPHERE_POINTS = 1.4, 96


def _cell(axis: str, size: float) -> Column:
    return F.floor(F.col(axis) / F.lit(size)).cast("long")


def radius_join(left: DataFrame, right: DataFrame, radius: float, inclusive: bool = True, once: str | None = None) -> DataFrame:
    """Pairs of points of one frame within a radius, as columns a_* and b_* with the distance d.

    Points fall into cubes of the radius' size; each left point is copied to its 27 neighbour
    cubes, so the join has equality keys only, whatever the number of points. With `once`, for a
    table joined with itself, 14 cubes do: two points meet one way round, in one cube the one with
    the smaller `once` first. The sides are larger than their files let Spark expect, so neither is
    ever broadcast.
    """
    keys = [*KEY, "_cx", "_cy", "_cz"]
    shifts = [s for s in product((-1, 0, 1), repeat=3) if not once or s >= (0, 0, 0)]
    shift = F.explode(F.array(*[F.struct(*[F.lit(k).alias(x) for x, k in zip("xyz", s, strict=True)]) for s in shifts]))
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns if c not in KEY], *KEY, *[_cell(x, radius).alias(f"_c{x}") for x in "xyz"])
    a = a.withColumn("_s", shift).withColumns({f"_c{x}": F.col(f"_c{x}") + F.col(f"_s.{x}") for x in "xyz"})
    a = a.withColumn("_own", (F.col("_s.x") == 0) & (F.col("_s.y") == 0) & (F.col("_s.z") == 0)).drop("_s") if once else a.drop("_s")
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns if c not in KEY], *KEY, *[_cell(x, radius).alias(f"_c{x}") for x in "xyz"])
    d = F.sqrt(sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) * (F.col(f"a_{x}") - F.col(f"b_{x}")) for x in "xyz"), F.lit(0.0)))
    near = a.join(b.hint("merge"), keys).withColumn("d", d)
    near = near.where(~F.col("_own") | (F.col(f"a_{once}") < F.col(f"b_{once}"))).drop("_own") if once else near
    return near.where(F.col("d") <= radius if inclusive else F.col("d") < radius).drop("_cx", "_cy", "_cz")


def contacts(coords: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of different atoms (i < j) of a frame within the cutoff."""
    points = coords.select(*KEY, "atom_idx", "x", "y", "z")
    pairs = radius_join(points, points, cutoff, once="atom_idx").where("a_atom_idx <> b_atom_idx")
    return pairs.select(*KEY, F.least("a_atom_idx", "b_atom_idx").alias("i"), F.greatest("a_atom_idx", "b_atom_idx").alias("j"), "d")


def donors(coords: DataFrame, atoms: DataFrame, frame_id: int = 0, xh_cutoff: float = 1.3) -> DataFrame:
    """(system_id, donor, hydrogen): N or O and H atoms within the cutoff in one frame of a system.

    Without the column system_id they hold for every system.
    """
    frame = coords.where(F.col("frame_id") == frame_id).join(small(atoms.select(*atom_key(atoms), "element")), atom_key(atoms)).select(*KEY, "atom_idx", "element", "x", "y", "z")
    pairs = radius_join(frame.where(F.col("element").isin("N", "O")), frame.where("element = 'H'"), xh_cutoff)
    return pairs.select("system_id", F.col("a_atom_idx").alias("donor"), F.col("b_atom_idx").alias("hydrogen"))


def hydrogen_bonds(coords: DataFrame, atoms: DataFrame, bonded: DataFrame, cutoff: float = 3.5, angle: float = 150.0) -> DataFrame:
    """n_hbonds of each frame (0 included): donor-acceptor distance below the cutoff, the angle at
    the hydrogen above `angle`; each hydrogen counts. Distance first, the angle on what is left."""
    points = coords.select(*KEY, "atom_idx", "x", "y", "z")
    heavy = points.join(small(atoms.where(F.col("element").isin("N", "O")).select(*atom_key(atoms))), atom_key(atoms)).select(*KEY, "atom_idx", "x", "y", "z")
    given = small(bonded.select(*system(bonded), F.col("donor").alias("a_atom_idx"), "hydrogen"))
    is_donor = heavy.join(small(bonded.select(*system(bonded), F.col("donor").alias("atom_idx")).distinct()), atom_key(bonded), "left_semi")
    near = radius_join(is_donor, heavy, cutoff, inclusive=False).where("a_atom_idx <> b_atom_idx AND d > 1e-6")
    with_h = near.join(given, [*system(bonded), "a_atom_idx"])
    h = points.select(*KEY, F.col("atom_idx").alias("hydrogen"), *[F.col(x).alias(f"h_{x}") for x in "xyz"])
    full = with_h.join(h, [*KEY, "hydrogen"])
    u = {x: F.col(f"a_{x}") - F.col(f"h_{x}") for x in "xyz"}
    v = {x: F.col(f"b_{x}") - F.col(f"h_{x}") for x in "xyz"}
    dot = lambda p, q: sum((p[x] * q[x] for x in "xyz"), F.lit(0.0))
    cos = dot(u, v) / F.greatest(F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)), F.lit(1e-12))
    found = full.where(cos < math.cos(math.radians(angle))).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    frames = coords.select(*KEY).distinct()
    return frames.join(found, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).cast("long").alias("n_hbonds"))


def sphere_points(n: int = SPHERE_POINTS) -> list[tuple[float, float, float]]:
    """Points spread evenly on the unit sphere along a golden-angle spiral."""
    out = []
    for i in range(n):
        phi, theta = math.acos(1 - 2 * (i + 0.5) / n), math.pi * (1 + math.sqrt(5)) * (i + 0.5)
        out.append((math.sin(phi) * math.cos(theta), math.sin(phi) * math.sin(theta), math.cos(phi)))
    return out


def sasa_atoms(coords: DataFrame, atoms: DataFrame, probe: float = PROBE, n_points: int = SPHERE_POINTS) -> DataFrame:
    """Solvent-accessible area of each atom and frame: relational form of the rolling-probe count.

    A point on an atom's expanded sphere is buried when it lies strictly inside another atom's.
    Only the given atoms occlude.
    """
    radius = atoms.select(*atom_key(atoms), (vdw_radius() + probe).alias("r"))
    points = coords.join(small(radius), atom_key(atoms)).select(*KEY, "atom_idx", "x", "y", "z", "r")
    reach = 2 * (max([1.98, 2.75, 2.31]) + probe)
    pairs = radius_join(points, points, reach, inclusive=False).where("a_atom_idx <> b_atom_idx AND d < a_r + b_r")
    sphere = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.lit(x).alias("sx"), F.lit(y).alias("sy"), F.lit(z).alias("sz")) for i, (x, y, z) in enumerate(sphere_points(n_points))]))
    tested = pairs.withColumn("s", sphere)
    inside = sum(((F.col(f"a_{x}") + F.col("a_r") * F.col(f"s.s{x}") - F.col(f"b_{x}")) ** 2 for x in "xyz"), F.lit(0.0)) < F.col("b_r") * F.col("b_r")
    buried = tested.where(inside).select(*KEY, F.col("a_atom_idx").alias("atom_idx"), "s.p").distinct().groupBy(*KEY, "atom_idx").agg(F.count(F.lit(1)).alias("hidden"))
    area = 4 * math.pi * F.col("r") * F.col("r") * (n_points - F.coalesce("hidden", F.lit(0))) / n_points
    return points.join(buried, [*KEY, "atom_idx"], "left").select(*KEY, "atom_idx", area.alias("sasa"))


def sasa_frames(per_atom: DataFrame) -> DataFrame:
    return per_atom.groupBy(*KEY).agg(F.sum("sasa").alias("sasa"))


def sasa_kernel(frames: DataFrame, radii: list[float], probe: float = PROBE, n_points: int = SPHERE_POINTS) -> DataFrame:
    """(system_id, frame_id, sasa) from wide frames: one narrow stage, a cell list in each frame."""
    sphere, reach = np.array(sphere_points(n_points)), np.array(radii) + probe

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"system_id": part["system_id"], "frame_id": part["frame_id"], "sasa": [_frame_area(np.asarray(x, float).reshape(-1, 3), reach, sphere) for x in part["xyz"]]})

    return frames.select(*KEY, "xyz").mapInPandas(run, "system_id int, frame_id bigint, sasa double")


def _frame_area(xyz: np.ndarray, reach: np.ndarray, sphere: np.ndarray) -> float:
    size = 2 * reach.max()
    cells: dict[tuple, list[int]] = {}
    place = np.floor(xyz / size).astype(int)
    for i, c in enumerate(map(tuple, place)):
        cells.setdefault(c, []).append(i)
    total = 0.0
    for i in range(len(xyz)):
        near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for j in cells.get((place[i, 0] + dx, place[i, 1] + dy, place[i, 2] + dz), ()) if j != i]
        exposed = len(sphere)
        if near:
            points = xyz[i] + reach[i] * sphere
            d2 = ((points[:, None, :] - xyz[near][None]) ** 2).sum(axis=2)
            exposed = int((~(d2 < (reach[near] ** 2)[None]).any(axis=1)).sum())
        total += 4 * math.pi * reach[i] ** 2 * exposed / len(sphere)
    return total
