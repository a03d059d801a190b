"""Command line: python -m kinetrace.cli {info,rmsd,rmsf,rg,pca,cluster} -p topology -t trajectory ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinetrace.functions.selection import select
from kinetrace.operators import frames, modes, superposition
from kinetrace.sources.readers import Universe
from kinetrace.sources.sinks import write_pdb_models, write_series


def _arguments(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="kinetrace")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, selection, out in (("info", None, None), ("rmsd", "name CA", "rmsd.dat"), ("rmsf", "protein", "rmsf.dat"), ("rg", "protein", "rg.dat"), ("pca", "name CA", "pca"), ("cluster", "name CA", "clusters.dat")):
        p = commands.add_parser(name)
        p.add_argument("-p", "--topology", required=True)
        p.add_argument("-t", "--trajectory", required=True)
        if selection:
            p.add_argument("-s", "--selection", default=selection)
            p.add_argument("-o", "--output", default=out)
        if name in ("rmsd", "rg"):
            p.add_argument("--dt", type=float)
            p.add_argument("--time-unit", default="ps", choices=sorted(frames.UNITS))
        if name == "rmsd":
            p.add_argument("--reference", type=int, default=0)
        if name == "rmsf":
            p.add_argument("--per-atom", action="store_true")
        if name in ("pca", "cluster"):
            p.add_argument("--n-components", type=int, default=10)
        if name == "cluster":
            p.add_argument("--k", type=int, default=5)
            p.add_argument("--seed", type=int, default=0)
            p.add_argument("--rep-pdb")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    a = _arguments(args)
    spark = SparkSession.builder.appName("kinetrace").getOrCreate()
    u = Universe.load(spark, a.topology, a.trajectory)
    if a.command == "info":
        for name, value in frames.info(u.atoms, u.bonds, u.frames).first().asDict().items():
            print(f"{name}: {value}")
        return
    atoms = select(u.atoms, a.selection)
    if not atoms.limit(1).count():
        raise SystemExit("the selection names no atoms")
    coords = frames.weighted(frames.long_coords(u.frames), atoms)
    key = ["system_id", "frame_id"]
    if a.command == "rmsf":
        values = superposition.rmsf(coords)
        series = values.select(F.col("atom_idx").alias("x"), F.col("rmsf").alias("y")) if a.per_atom else superposition.by_residue(values, atoms).select(F.col("residue_id").alias("x"), F.col("rmsf").alias("y"))
        write_series(series, a.output, ("Atom" if a.per_atom else "Residue", "RMSF"), "RMSF")
        return
    if a.command in ("rmsd", "rg"):
        if a.command == "rmsd":
            values = superposition.rmsd(coords, frames.reference(coords, frames.frame_number(u.frames, a.reference)))
        else:
            values = frames.radius_of_gyration(coords)
        axis = frames.time_axis(u.frames.select(*key, "time_ps"), a.dt, a.time_unit)
        label = axis.select("label").first()["label"]
        name = a.command if a.command == "rg" else "rmsd"
        write_series(values.join(axis, key).select(F.col("t").alias("x"), F.col(name).alias("y")), a.output, (label, name.upper()), name.upper())
        return
    pca = modes.PCA(frames.wide_frames(superposition.align(coords, frames.reference(coords, frames.frame_number(u.frames, 0)))), a.n_components)
    if a.command == "pca":
        pca.scree().write.mode("overwrite").parquet(f"{a.output}/scree")
        pca.project().write.mode("overwrite").parquet(f"{a.output}/projections")
        return
    points = pca.project().groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pc", "value"))), lambda p: p["value"]).alias("features"))
    labels, centres = modes.kmeans(points, a.k, a.seed)
    write_series(labels.select(F.col("frame_id").alias("x"), F.col("cluster").alias("y")), a.output, ("Frame", "Cluster"))
    if a.rep_pdb:
        best = modes.representatives(modes.assign(points, centres), centres).orderBy("cluster").collect()
        write_pdb_models(frames.long_coords(u.frames), u.atoms, [r["frame_id"] for r in best], a.rep_pdb)


if __name__ == "__main__":
    main()
