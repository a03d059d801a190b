"""Molecules, periodic images, stripping of solvent, and the preparation of trajectories."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.selection import not_solvent
from kinetrace.operators.frames import atom_key, small, system

KEY = ["system_id", "frame_id"]


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's checkpoint folder (a temporary one only on one machine)."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kinetrace-"))
    return df.checkpoint()


def molecules(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(atom_idx, molecule), by system_id if atoms has it: connected components by bonds, named by their first atom.

    Labels spread over bonds and jump to the label's own label, so long chains take few rounds.
    Without any bond all atoms are one molecule; atoms without a bond are molecules of their own.
    """
    s = system(atoms)
    if s and not system(bonds):
        bonds = bonds.crossJoin(small(atoms.select(*s).distinct()))  # one set of bonds holds for every system
    ends = bonds.select(*s, F.col("i").alias("u"), F.col("j").alias("v"))
    both = ends.union(bonds.select(*s, "j", "i")).distinct()
    bonded = ends.select(*(s or [F.lit(0).alias("_all")])).distinct().withColumn("_bonded", F.lit(True))
    every = Window.partitionBy(*(s or [F.lit(0)]))
    marked = atoms.join(bonded, s, "left") if s else atoms.crossJoin(F.broadcast(bonded.agg(F.max("_bonded").alias("_bonded"))))
    labels = marked.select(*s, "atom_idx", F.when(F.col("_bonded"), F.col("atom_idx")).otherwise(F.min("atom_idx").over(every)).alias("molecule"))
    while True:
        near = both.join(labels.withColumnRenamed("atom_idx", "v"), [*s, "v"]).groupBy(*s, F.col("u").alias("atom_idx")).agg(F.min("molecule").alias("m"))
        spread = labels.join(near, [*s, "atom_idx"], "left").select(*s, "atom_idx", F.col("molecule").alias("old"), F.least("molecule", F.coalesce("m", "molecule")).alias("molecule"))
        jump = spread.select(*s, F.col("atom_idx").alias("molecule"), F.col("molecule").alias("to"))
        new = _checkpointed(spread.join(jump, [*s, "molecule"]).select(*s, "atom_idx", "old", F.least("molecule", "to").alias("molecule")))
        changed = new.where("molecule <> old").limit(1).count()
        labels = new.select(*s, "atom_idx", "molecule")
        if not changed:
            return labels


def cell_vectors(lengths: list[str], angles: list[str]):
    """The nine numbers (rows a, b, c) of a cell from lengths and angles in degrees."""
    a, b, c = (F.col(x) for x in lengths)
    ca, cb, cg = (F.cos(F.radians(x)) for x in angles)
    sg = F.sin(F.radians(angles[2]))
    cy = c * (ca - cb * cg) / sg
    zero = F.lit(0.0)
    return F.array(a, zero, zero, b * cg, b * sg, zero, c * cb, cy, F.sqrt(F.greatest(zero, c * c - c * cb * c * cb - cy * cy)))


def cell_lengths_angles(frames: DataFrame) -> DataFrame:
    """Lengths and angles of each box; angles are 90 unless an off-diagonal exceeds 1e-4; no box: 0 and 90."""
    e = lambda i: F.element_at("box", i + 1)
    norm = [F.sqrt(e(3 * r) * e(3 * r) + e(3 * r + 1) * e(3 * r + 1) + e(3 * r + 2) * e(3 * r + 2)) for r in range(3)]
    dot = lambda r, s: e(3 * r) * e(3 * s) + e(3 * r + 1) * e(3 * s + 1) + e(3 * r + 2) * e(3 * s + 2)
    skewed = F.greatest(*[F.abs(e(i)) for i in (1, 2, 3, 5, 6, 7)]) > 1e-4
    angle = lambda r, s: F.when(skewed, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(r, s) / (norm[r] * norm[s])))))).otherwise(90.0)
    lengths = [F.coalesce(n, F.lit(0.0)).alias(x) for n, x in zip(norm, "abc", strict=True)]
    return frames.select(*KEY, *lengths, *[F.coalesce(angle(r, s), F.lit(90.0)).alias(n) for n, r, s in (("alpha", 1, 2), ("beta", 0, 2), ("gamma", 0, 1))])


def _inverse_rows(df: DataFrame) -> DataFrame:
    """Adds i11..i33: the inverse of the box (rows are cell vectors), for fractional = cartesian * inverse."""
    b = [[f"element_at(box, {3 * r + c + 1})" for c in range(3)] for r in range(3)]
    det = " + ".join(f"{b[0][c]} * ({b[1][(c + 1) % 3]} * {b[2][(c + 2) % 3]} - {b[1][(c + 2) % 3]} * {b[2][(c + 1) % 3]})" for c in range(3))
    out = df.withColumn("_det", F.expr(det))
    for r in range(3):
        for c in range(3):
            p, q, u, v = (c + 1) % 3, (c + 2) % 3, (r + 1) % 3, (r + 2) % 3
            out = out.withColumn(f"i{r + 1}{c + 1}", F.expr(f"({b[p][u]} * {b[q][v]} - {b[p][v]} * {b[q][u]}) / nullif(_det, 0.0D)"))
    return out.drop("_det")


def _to_fractions(names: dict[str, str]) -> list[str]:
    x, y, z = names["x"], names["y"], names["z"]
    return [f"({x}) * i1{c} + ({y}) * i2{c} + ({z}) * i3{c}" for c in (1, 2, 3)]


def _cells(counts: list[str]) -> dict[str, str]:
    """Cartesian shift of whole (or fractional) numbers of cells."""
    return {axis: " + ".join(f"({n}) * element_at(box, {3 * r + k + 1})" for r, n in enumerate(counts)) for k, axis in enumerate("xyz")}


def restitch(coords: DataFrame, mols: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each molecule made whole: along its atoms, every step is taken to the nearest image.

    boxes is (system_id, frame_id, box); frames without a box (or with one of no volume) stay.
    """
    full = _inverse_rows(coords.join(small(mols), atom_key(mols)).join(boxes, KEY, "left"))
    w = Window.partitionBy(*KEY, "molecule").orderBy("atom_idx")
    for a in "xyz":
        full = full.withColumn(f"d{a}", F.col(a) - F.lag(a).over(w)).withColumn(f"f{a}", F.first(a).over(w))
    for k, e in enumerate(_to_fractions({a: f"d{a}" for a in "xyz"})):
        full = full.withColumn(f"g{k}", F.expr(e))
    wrapped = _cells([f"g{k} - rint(g{k})" for k in range(3)])
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for a in "xyz":
        full = full.withColumn(f"s{a}", F.coalesce(F.expr(wrapped[a]), F.lit(0.0)))
    has_box = F.col("i11").isNotNull()
    new = [F.when(has_box, F.col(f"f{a}") + F.sum(f"s{a}").over(running)).otherwise(F.col(a)).alias(a) for a in "xyz"]
    return full.select(*KEY, "atom_idx", "molecule", *new)


def autoimage(coords: DataFrame, mols: DataFrame, boxes: DataFrame, anchor: DataFrame, center: bool = True) -> DataFrame:
    """Whole molecules around the anchor: the largest molecule that holds an anchor atom (the first
    one, if several are as large) moves its anchor atoms' centre to the box centre; every other
    molecule moves by whole cells next to it. Frames without a box or anchor stay as stitched."""
    whole = restitch(coords, mols, boxes)
    s = system(mols)
    marks = mols.join(anchor.select(*atom_key(anchor), F.lit(True).alias("is_anchor")), atom_key(anchor), "left")
    sizes = marks.groupBy(*s, "molecule").agg(F.count(F.lit(1)).alias("n"), F.max("is_anchor").alias("anchored"))
    primary = sizes.where("anchored").groupBy(*s).agg(F.max_by("molecule", F.struct("n", -F.col("molecule"))).alias("primary"))
    known = marks.join(primary, s, "left") if s else marks.crossJoin(F.broadcast(primary))  # one row without groups
    placed = _inverse_rows(whole.join(small(known.select(*s, "atom_idx", "is_anchor", "primary")), atom_key(mols)).join(boxes, KEY, "left"))
    is_primary = F.col("molecule").eqNullSafe(F.col("primary"))
    centre = placed.groupBy(*KEY).agg(*[F.avg(F.when(is_primary & F.col("is_anchor"), F.col(a))).alias(f"a{a}") for a in "xyz"])
    middle = placed.groupBy(*KEY, "molecule").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    full = placed.join(centre, KEY).join(middle, [*KEY, "molecule"])
    half = {a: F.expr(f"0.5D * (element_at(box, {k + 1}) + element_at(box, {k + 4}) + element_at(box, {k + 7}))") for k, a in enumerate("xyz")}
    for a in "xyz":
        full = full.withColumn(f"t{a}", half[a] if center else F.col(f"a{a}"))
    for k, e in enumerate(_to_fractions({a: f"m{a} - t{a}" for a in "xyz"})):
        full = full.withColumn(f"n{k}", F.expr(f"rint({e})"))
    shift = _cells([f"n{k}" for k in range(3)])
    new = []
    for a in "xyz":
        moved = F.when(is_primary, F.col(a) + F.col(f"t{a}") - F.col(f"a{a}")).otherwise(F.col(a) - F.expr(shift[a]))
        new.append(F.coalesce(moved, F.col(a)).alias(a))
    return full.select(*KEY, "atom_idx", "molecule", *new)


def strip(atoms: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """The kept atoms with new_idx (their position) and new_residue_id (order of first appearance,
    by runs of a residue, so that chains which use the same numbers stay apart)."""
    kept = atoms.where(not_solvent(names))
    if kept.limit(1).count() == 0:
        raise ValueError("no atoms are left after stripping")
    w = Window.partitionBy(*(system(atoms) or [F.lit(0)])).orderBy("atom_idx")  # as many rows as a topology has atoms
    same = F.lag("residue_id").over(w).eqNullSafe(F.col("residue_id")) & F.lag("residue_name").over(w).eqNullSafe(F.col("residue_name"))
    out = kept.withColumn("new_idx", F.row_number().over(w) - 1).withColumn("_first", F.when(same, 0).otherwise(1))
    return out.withColumn("new_residue_id", F.sum("_first").over(w).cast("int")).drop("_first")


def prepare(coords: DataFrame, atoms: DataFrame, bonds: DataFrame, boxes: DataFrame, anchor: DataFrame, names: tuple[str, ...] | None = None, image: bool = True) -> DataFrame:
    """Solvent stripped, then imaged (in that order: the expensive step sees few atoms), renumbered."""
    kept = strip(atoms, names)
    key = atom_key(kept)
    numbers = small(kept.select(*key, "new_idx"))
    few = coords.join(numbers, key)
    if image:
        mols = molecules(atoms, bonds).join(kept.select(*key), key)
        there = anchor.join(kept.select(*key), atom_key(anchor) if system(kept) else ["atom_idx"], "left_semi")
        used = there if there.limit(1).count() else kept
        imaged = autoimage(few.drop("new_idx"), mols, boxes, used.select(*atom_key(used)))
        few = imaged.join(numbers, key)
    return few.select(*KEY, F.col("new_idx").alias("atom_idx"), F.col("atom_idx").alias("source_atom"), "x", "y", "z")


def kept_bonds(bonds: DataFrame, kept: DataFrame) -> DataFrame:
    """Bonds between kept atoms in their new numbers."""
    s = system(kept)
    end = lambda x: kept.select(*s, F.col("atom_idx").alias(x), F.col("new_idx").alias(f"new_{x}"))
    by = system(bonds) if s else []
    out = bonds.select(*by, "i", "j").join(end("i"), [*by, "i"]).join(end("j"), [*s, "j"])
    return out.select(*s, F.col("new_i").alias("i"), F.col("new_j").alias("j"))

