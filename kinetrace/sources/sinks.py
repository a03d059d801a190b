"""Text files of results: series tables (.dat, .xvg, .csv) and structures (.pdb).

These are small results, written by the driver in the order of x.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from kinetrace.operators.frames import keep_atoms


def write_series(series: DataFrame, path: str, headers: tuple[str, str] = ("x", "y"), title: str = "") -> None:
    rows = [(r["x"], r["y"]) for r in series.select("x", "y").orderBy("x").collect()]
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        lines = [",".join(headers), *(f"{x:.6g},{y:.6g}" for x, y in rows)]
    elif kind == ".xvg":
        lines = ["# kinetrace", f'@ title "{title}"', f'@ xaxis label "{headers[0]}"', f'@ yaxis label "{headers[1]}"', "@TYPE xy", *(f"{x:14.6f}  {y:14.6f}" for x, y in rows)]
    else:
        lines = ["# " + "  ".join(headers), *(f"{x:14.6f} {y:14.6f}" for x, y in rows)]
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")


def write_pdb_models(coords: DataFrame, atoms: DataFrame, frame_ids: list[int], path: str) -> None:
    """The chosen frames as numbered models; -1 (a cluster without members) is left out."""
    few = keep_atoms(coords.where(coords["frame_id"].isin([f for f in frame_ids if f >= 0])), atoms).join(atoms.select("atom_idx", "atom_name", "residue_name", "residue_id"), "atom_idx")
    by_frame: dict[int, list] = {}
    for r in few.orderBy("frame_id", "atom_idx").collect():
        by_frame.setdefault(r["frame_id"], []).append(r)
    lines = []
    for model, f in enumerate(frame_ids, 1):
        if f < 0:
            continue
        lines.append(f"MODEL     {model:4d}")
        lines += [f"ATOM  {i:5d} {r['atom_name']:<4s} {r['residue_name']:>3s}  {r['residue_id']:4d}    {r['x']:8.3f}{r['y']:8.3f}{r['z']:8.3f}  1.00  0.00" for i, r in enumerate(by_frame.get(f, []), 1)]
        lines.append("ENDMDL")
    with open(path, "w") as out:
        out.write("\n".join([*lines, "END"]) + "\n")
