"""Optimal superposition: moments are aggregated, the RMSD is a closed form, rotations a small kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions import geometry as G
from kinetrace.operators.frames import atom_key, small, system

KEY = ["system_id", "frame_id"]


def moments(coords: DataFrame, ref: DataFrame) -> DataFrame:
    """The centred moments of each frame with the reference, by the weight w.

    The reference's centroid is taken off both sides before summing, so that large distances from
    the origin cost no digits.
    """
    centre = [F.avg(f"r{a}").over(Window.partitionBy(*(system(ref) or [F.lit(0)]))).alias(f"o{a}") for a in "xyz"]
    near = ref.select("*", *centre)
    both = coords.join(small(near), atom_key(ref))
    p = {a: F.col(a) - F.col(f"o{a}") for a in "xyz"}
    q = {a: F.col(f"r{a}") - F.col(f"o{a}") for a in "xyz"}
    w = F.col("w")
    sums = [F.sum(w).alias("w"), F.sum(w * sum((p[a] * p[a] for a in "xyz"), F.lit(0.0))).alias("spp"), F.sum(w * sum((q[a] * q[a] for a in "xyz"), F.lit(0.0))).alias("sqq")]
    sums += [F.sum(w * p[a]).alias(f"p{a}") for a in "xyz"] + [F.sum(w * q[a]).alias(f"q{a}") for a in "xyz"]
    sums += [F.sum(w * p[a] * q[b]).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"]
    sums += [F.first(f"o{a}").alias(f"o{a}") for a in "xyz"]
    total = both.groupBy(*KEY).agg(*sums)
    square = lambda s: F.expr(f"({s}x * {s}x + {s}y * {s}y + {s}z * {s}z) / w")
    out = total.select(
        *KEY, "w", (F.col("spp") - square("p")).alias("ga"), (F.col("sqq") - square("q")).alias("gb"),
        *[F.expr(f"s{a}{b} - p{a} * q{b} / w").alias(f"m{a}{b}") for a in "xyz" for b in "xyz"],
        *[F.expr(f"p{a} / w + o{a}").alias(f"pc{a}") for a in "xyz"], *[F.expr(f"q{a} / w + o{a}").alias(f"qc{a}") for a in "xyz"],
    )
    out = out.select("*", F.expr(G.spark(G.C2)).alias("c2"), F.expr(G.spark(G.C1)).alias("c1"), F.expr(G.spark(G.C0)).alias("c0"))
    return out.withColumn("root", F.expr(G.SPARK_ROOT))


def rmsd(coords: DataFrame, ref: DataFrame) -> DataFrame:
    """rmsd of each frame after optimal superposition on the reference."""
    return moments(coords, ref).select(*KEY, F.expr(G.spark(G.RMSD)).alias("rmsd"))


def rotations(coords: DataFrame, ref: DataFrame) -> DataFrame:
    """The moments with the unit quaternion q0..q3 (q0 >= 0) of each frame.

    One small row a frame goes through a vectorised kernel: eigenvectors are also right where the
    closed form breaks down (few, collinear or symmetric atoms).
    """
    m = moments(coords, ref).drop("c0", "c1", "c2", "root")
    names = [f"m{a}{b}" for a in "xyz" for b in "xyz"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**dict(zip(("q0", "q1", "q2", "q3"), quaternions(part[names].to_numpy(float)).T, strict=True)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema.fields)
    return m.mapInPandas(run, f"{fields}, q0 double, q1 double, q2 double, q3 double")


def quaternions(m: np.ndarray) -> np.ndarray:
    """Unit quaternions (n x 4) of rows of nine moments: the eigenvectors of the largest roots."""
    xx, xy, xz, yx, yy, yz, zx, zy, zz = np.where(np.isfinite(m), m, 0.0).T
    k = np.empty((len(m), 4, 4))
    k[:, 0, 0], k[:, 1, 1], k[:, 2, 2], k[:, 3, 3] = xx + yy + zz, xx - yy - zz, yy - xx - zz, zz - xx - yy
    for i, j, value in ((0, 1, yz - zy), (0, 2, zx - xz), (0, 3, xy - yx), (1, 2, xy + yx), (1, 3, zx + xz), (2, 3, yz + zy)):
        k[:, i, j] = k[:, j, i] = value
    q = np.linalg.eigh(k)[1][:, :, -1]
    return q * np.where(q[:, :1] < 0, -1.0, 1.0)


def align(coords: DataFrame, ref: DataFrame, on: DataFrame | None = None) -> DataFrame:
    """coords rotated and moved onto the reference; the fit is made on `on` (default: coords, with w)."""
    turn = rotations(coords if on is None else on, ref)
    turn = turn.select(*KEY, *[F.expr(G.spark(e)).alias(n) for n, e in G.rotation().items()], *[f"pc{a}" for a in "xyz"], *[f"qc{a}" for a in "xyz"])
    both = coords.join(turn, KEY)
    new = [F.expr(" + ".join(f"r{a}{b} * ({b} - pc{b})" for b in "xyz") + f" + qc{a}").alias(a) for a in "xyz"]
    return both.select(*[c for c in coords.columns if c not in ("x", "y", "z")], *new)


def mean_structure(coords: DataFrame) -> DataFrame:
    """(system_id, atom_idx, rx, ry, rz): the mean of each system's frames as they lie."""
    return coords.groupBy("system_id", "atom_idx").agg(*[F.avg(a).alias(f"r{a}") for a in "xyz"])


def rmsf(coords: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """rmsf of each system's atoms: frames are superposed (by w) on the reference, by default the unaligned
    mean of the system; the fluctuation itself is unweighted, over all its frames."""
    aligned = align(coords, mean_structure(coords) if ref is None else ref)
    return aligned.groupBy("system_id", "atom_idx").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def by_residue(values: DataFrame, atoms: DataFrame, column: str = "rmsf") -> DataFrame:
    """Mass-weighted mean of each residue (plain where its atoms or all atoms have no mass); first_atom orders."""
    joined = values.join(small(atoms.select(*atom_key(atoms), "residue_id", F.col("mass").cast("double").alias("m"))), atom_key(atoms))
    mean = F.when(F.sum("m") > 0, F.sum(F.col("m") * F.col(column)) / F.sum("m")).otherwise(F.avg(column))
    return joined.groupBy(*system(values), "residue_id").agg(mean.alias(column), F.min("atom_idx").alias("first_atom"))


def kabsch(mobile: np.ndarray, reference: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, translation, moved) of one small pair of point sets, by singular values."""
    p, q = np.asarray(mobile, float), np.asarray(reference, float)
    if p.shape != q.shape or p.ndim != 2 or p.shape[1] != 3:
        raise ValueError(f"shapes differ or are not (n, 3): {p.shape} and {q.shape}")
    w = np.ones(len(p)) if weights is None else np.asarray(weights, float)
    if w.shape != (len(p),):
        raise ValueError("one weight for each point is needed")
    pc, qc = w @ p / w.sum(), w @ q / w.sum()
    u, _, vt = np.linalg.svd(((p - pc) * w[:, None]).T @ (q - qc))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ flip @ u.T
    return r, qc - r @ pc, (p - pc) @ r.T + qc
