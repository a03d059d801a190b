import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions.selection import SelectionError, predicate, select
from kinetrace.operators import distance, frames, imaging, modes, series, superposition
from kinetrace.plans import fixture, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(i, n, "N" if n == "N" else "C", i // 3 + 1, r, m) for i, (n, r, m) in enumerate([("N", "ALA", 14.0), ("CA", "ALA", 12.0), ("C", "ALA", 12.0), ("N", "GLY", 14.0), ("CA", "GLY", 12.0), ("C", "GLY", 12.0)])]
    return spark.createDataFrame(rows, "atom_idx int, atom_name string, element string, residue_id int, residue_name string, mass double").cache()


@pytest.mark.parametrize(("query", "want"), [("all", range(6)), ("protein", range(6)), ("backbone", range(6)), ("name CA", [1, 4]), ("name CA C", [1, 2, 4, 5]), ("resname ALA", [0, 1, 2]), ("resid 1-1", [0, 1, 2]), ("index 0-2", [0, 1, 2]), ("name CA AND resname GLY", [4]), ("name N or name C", [0, 2, 3, 5]), ("not name CA", [0, 2, 3, 5]), ("(name CA or name C) and resname ALA", [1, 2]), ("index -3", [3]), ("name CA resname ALA", [1, 4])])
def test_selection(atoms, query, want):
    assert [r[0] for r in select(atoms, query).orderBy("atom_idx").select("atom_idx").collect()] == list(want)


@pytest.mark.parametrize("query", ["", "nonsense 3", "name", "name CA)", "(all", "name O5'", "not"])
def test_selection_errors(spark, query):
    with pytest.raises(SelectionError):
        predicate(query)


def _frames(spark, cubes):
    rows = [(0, f, a, *map(float, p), 1.0) for f, cube in enumerate(cubes) for a, p in enumerate(cube)]
    return spark.createDataFrame(rows, "system_id int, frame_id long, atom_idx int, x double, y double, z double, w double")


def test_superposition(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(7, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    line = np.outer(np.arange(7.0), [1, 2, 3])
    cubes = [base, base @ turn.T + 5, base + rng.normal(scale=0.2, size=(7, 3)), line]
    coords = _frames(spark, cubes)
    ref = frames.reference(coords, 0)
    got = {r["frame_id"]: r["rmsd"] for r in superposition.rmsd(coords, ref).collect()}
    for k, cube in enumerate(cubes):
        moved = superposition.kabsch(cube, base)[2]
        assert got[k] == pytest.approx(np.sqrt(((moved - base) ** 2).sum() / 7), abs=1e-5)
    aligned = {(r["frame_id"], r["atom_idx"]): (r["x"], r["y"], r["z"]) for r in superposition.align(coords, ref).collect()}
    assert np.allclose([aligned[1, a] for a in range(7)], base, atol=1e-7)
    with pytest.raises(ValueError):
        superposition.kabsch(base, base[:5])


def test_autoimage_triclinic(spark):
    box = np.array([[10.0, 0, 0], [3, 9, 0], [1, 2, 8]])
    inside = np.array([[5.0, 5, 4], [6, 5, 4], [7, 5, 4]])
    split = inside + np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0]]) @ box
    coords = _frames(spark, [split]).drop("w")
    mols = spark.createDataFrame([(a, 0) for a in range(3)], "atom_idx int, molecule int")
    boxes = spark.createDataFrame([(0, 0, box.ravel().tolist())], "system_id int, frame_id long, box array<double>")
    rows = imaging.restitch(coords, mols, boxes).orderBy("atom_idx").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in rows], inside)
    none = boxes.withColumn("box", boxes["box"].cast("array<double>")).where("false")
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in imaging.restitch(coords, mols, none).orderBy("atom_idx").collect()], split)


def test_surface_of_one_atom():
    assert distance._frame_area(np.zeros((1, 3)), np.array([3.1]), np.array(distance.sphere_points())) == pytest.approx(4 * np.pi * 3.1**2)


def test_surface_of_all_frames(spark):
    """Every frame by brute force over atoms and points; the SQL on the frames that it states."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    coords = fixture.coords(spark, SF).toPandas().sort_values(["frame_id", "atom_idx"])
    radius = np.array([{"H": 1.2, "N": 1.55, "O": 1.52, "C": 1.7}[fixture.ELEMENTS[i % 5]] + 1.4 for i in range(fixture.N_ATOMS)])
    sphere, want = np.array(distance.sphere_points()), {}
    for (system, frame), g in coords.groupby(["system_id", "frame_id"]):
        xyz = g[["x", "y", "z"]].to_numpy()
        points = xyz[:, None] + radius[:, None, None] * sphere
        inside = ((points[:, :, None] - xyz) ** 2).sum(axis=3) < radius**2
        inside[np.arange(len(xyz)), :, np.arange(len(xyz))] = False
        want[system, frame] = 4 * np.pi * radius**2 * (~inside.any(axis=2)).mean(axis=1)
    atom = registry.QUERIES["sasa_atom"](spark, SF).toPandas()
    assert len(atom) == fixture.N_ATOMS * len(want) == len(coords)
    assert np.allclose(atom["sasa"], [want[s, f][a] for s, f, a in zip(atom["system_id"], atom["frame_id"], atom["atom_idx"])], atol=2e-6)
    for name in ("sasa_frame", "sasa_kernel"):
        got = registry.QUERIES[name](spark, SF).toPandas()
        assert {*zip(got["system_id"], got["frame_id"])} == {*want} and len(got) == len(want)
        assert np.allclose(got["sasa"], [want[k].sum() for k in zip(got["system_id"], got["frame_id"])], atol=2e-6)
        sql = {(r[0], r[1]): r[2] for r in con.sql(f"SELECT system_id, frame_id, sasa FROM ({registry.ORACLES[name]})").fetchall()}
        got = {(r.system_id, r.frame_id): r.sasa for r in got.itertuples() if r.frame_id <= max(f for _, f in sql)}
        assert got == pytest.approx(sql, abs=2e-6)


def test_pca_driven_mode(spark):
    rng = np.random.default_rng(1)
    cubes = rng.normal(scale=0.02, size=(60, 3, 3))
    cubes[:, 1, 0] += rng.normal(size=60)
    pca = modes.PCA(frames.wide_frames(_frames(spark, cubes)), 3)
    assert pca.scree().orderBy("pc").first()["fraction"] > 0.9
    assert np.allclose(pca.eigenvalues, np.linalg.eigvalsh(np.cov(cubes.reshape(60, 9).T))[::-1][:3])


def test_kmeans_and_time(spark):
    points = spark.createDataFrame([(0, i, [float(10 * (i % 2)), 0.1 * i]) for i in range(20)], "system_id int, frame_id long, features array<double>")
    labels, centres = modes.kmeans(points, 2)
    assert sorted(r["n"] for r in labels.groupBy("cluster").count().withColumnRenamed("count", "n").collect()) == [10, 10]
    times = spark.createDataFrame([(0, i, float(i)) for i in range(4)], "system_id int, frame_id long, time_ps double")
    assert {r["label"] for r in frames.time_axis(times, unit="ns").collect()} == {"Frame"}
    with pytest.raises(ValueError):
        frames.time_axis(times, unit="h")
    widths = spark.range(1).select(*[series.smoothing_width(F.lit(n), r).alias(f"w{k}") for k, (n, r) in enumerate(((100, 0), (4, 10), (1000, 0), (3, 0), (50, 8), (1, 0)))]).first()
    assert tuple(widths) == (5, 4, 51, 3, 9, 1)


@pytest.mark.parametrize("name", ["rmsd_qcp", "rmsf_residue", "hbond_count", "autoimage_ortho", "robust_ylim", "molecules"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    order = [c for c in columns if got[c].dtype.kind in "iO"]
    a, b = (x[columns].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert np.allclose(a[c], b[c], atol=2e-6) if a[c].dtype.kind == "f" else (a[c] == b[c]).all()


def test_systems_are_kept_apart(spark):
    """Two systems that share frame and atom numbers, and never move: each is its own reference."""
    rng = np.random.default_rng(3)
    shapes = {s: rng.normal(size=(6, 3)) * 3 for s in (1, 2)}
    rows = [(s, f, a, *map(float, p)) for s, shape in shapes.items() for f in range(4) for a, p in enumerate(shape)]
    coords = spark.createDataFrame(rows, "system_id int, frame_id long, atom_idx int, x double, y double, z double")
    names = {1: "NHOHCC", 2: "CCNHNH"}
    atoms = spark.createDataFrame([(s, a, e, e, 1 + a // 3, "ALA", float(s * (a + 1))) for s, n in names.items() for a, e in enumerate(n)], "system_id int, atom_idx int, atom_name string, element string, residue_id int, residue_name string, mass double")
    whole = frames.weighted(coords, atoms)
    assert whole.count() == len(rows)
    assert {round(r["rmsd"], 5) for r in frames.rmsd_unaligned(whole, frames.reference(coords, 0)).collect()} == {0.0}
    assert all(r["rmsd"] < 1e-3 for r in superposition.rmsd(whole, frames.first_reference(coords)).collect())
    fluct = superposition.rmsf(whole)
    assert fluct.count() == 12 and all(r["rmsf"] < 1e-6 for r in fluct.collect())
    assert superposition.by_residue(fluct, atoms).count() == 4
    found = {tuple(r) for r in distance.donors(coords, atoms, 0, 9.0).collect()}
    want = {(s, i, j) for s, n in names.items() for i in range(6) for j in range(6) if n[i] in "NO" and n[j] == "H" and np.linalg.norm(shapes[s][i] - shapes[s][j]) <= 9.0}
    assert found == want and {s for s, _, _ in want} == {1, 2}
    bonds = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 4, 5)], "system_id int, i int, j int")
    mols = {(r["system_id"], r["atom_idx"]): r["molecule"] for r in imaging.molecules(atoms, bonds).collect()}
    assert [mols[1, a] for a in range(6)] == [0, 0, 0, 3, 4, 5] and [mols[2, a] for a in range(6)] == [0, 1, 2, 3, 4, 4]
    boxes = coords.select("system_id", "frame_id").distinct().withColumn("box", F.array(*[F.lit(20.0 if k % 4 == 0 else 0.0) for k in range(9)]))
    out = imaging.prepare(coords, atoms, bonds, boxes, atoms.where("element = 'C'"))
    assert out.count() == len(rows) and out.select("system_id", "frame_id", "atom_idx").distinct().count() == len(rows)


def test_contacts_are_joined_without_broadcasts(spark):
    """Every pair by brute force, on a lattice whose points lie on faces of cubes; no side is held whole in memory."""
    rng = np.random.default_rng(5)
    shapes = [rng.integers(-4, 5, size=(60, 3)) * 1.0, rng.normal(scale=4, size=(60, 3))]
    rows = [(1, f, int(a), *map(float, p)) for f, shape in enumerate(shapes) for a, p in zip(rng.permutation(60), shape, strict=True)]
    rows += [(1, 0, 60, *rows[0][3:]), (1, 0, 60, *rows[1][3:])]  # an atom that is there twice
    coords = spark.createDataFrame(rows, "system_id int, frame_id long, atom_idx int, x double, y double, z double")
    got = sorted(tuple(r) for r in distance.contacts(coords, 2.0).collect())
    d = lambda p, q: np.sqrt(sum((p[k] - q[k]) * (p[k] - q[k]) for k in (3, 4, 5)))
    want = sorted((1, p[1], p[2], q[2], d(p, q)) for p in rows for q in rows if p[1] == q[1] and p[2] < q[2] and d(p, q) <= 2.0)
    assert [r[:4] for r in got] == [r[:4] for r in want] and np.allclose([r[4] for r in got], [r[4] for r in want])
    assert "Broadcast" not in registry.QUERIES["contact_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_running_mean_adds_only_its_window(spark, tmp_path):
    """Null names and values, values that swamp others, series of few points: all as the SQL has it."""
    rng, rows = np.random.default_rng(7), []
    for k, (name, n) in enumerate([(None, 9), *[(f"n{n}", n) for n in range(1, 13)], ("huge", 150), ("inf", 150), ("nulls", 330)]):
        y = [float(v) for v in rng.integers(0, 9999, n) / 100]
        y[:1] = {"huge": [1e17], "inf": [float("inf")], "nulls": [None]}.get(name, y[:1])
        y = [None if name == "nulls" and (i % 3 or i > 290) else v for i, v in enumerate(y)]
        rows += [(1000 * k + i, 1000 * k + int(j), name, v) for (i, v), j in zip(enumerate(y), rng.permutation(n), strict=True)]
    spark.createDataFrame(rows, "event_id long, s long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(s) AS ts", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for name in ("running_average", "running_average_auto"):
        got, want = ({(r[0], r[1]): r[2] for r in x} for x in (registry.QUERIES[name](spark, str(tmp_path)).collect(), con.sql(registry.ORACLES[name]).fetchall()))
        assert len(got) == len(want) == len(rows)
        if name == "running_average":  # its SQL takes 21 points where a series has fewer
            got, want = ({k: v for k, v in x.items() if k[0] in ("huge", "inf", "nulls")} for x in (got, want))
        assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, rel=1e-14, abs=0)


def test_running_mean_in_the_middle_of_two_digits(spark):
    """Means of 4 digits over every window of sf0.1, added from left to right; some are ties but for the noise of adding."""
    d = "/root/testdata/sf0.1"
    got = registry.QUERIES["running_average_auto"](spark, d).toPandas().sort_values(["system", "x"])
    given = fixture.series(spark, d).toPandas().sort_values(["system", "x"])
    want = []
    for _, g in given.groupby("system"):
        y, n = g["y"].to_numpy(), len(g)
        half = (n // 20 + (n // 20 % 2 == 0)) // 2
        means = [np.cumsum(v)[-1] / len(v) for v in (y[max(i - half, 0) : i + half + 1] for i in range(n))]
        want += [np.floor(m * 10000 + 0.5) / 10000 for m in means]
    assert (got["smooth"].to_numpy() == np.array(want)).all()
