import numpy as np

from kinetrace import cli


def test_commands(spark, tmp_path, capsys):
    rng, text = np.random.default_rng(3), ""
    for _ in range(8):
        xyz = np.outer(np.arange(6), [0.15, 0.05, 0.0]) + 0.5 + rng.normal(scale=0.01, size=(6, 3))
        text += "demo\n6\n" + "".join(f"{i // 3 + 1:5d}{'ALA':<5s}{('N', 'CA', 'C')[i % 3]:>5s}{i + 1:5d}" + "".join(f"{v:8.3f}" for v in p) + "\n" for i, p in enumerate(xyz)) + "2.0 2.0 2.0\n"
    file = tmp_path / "demo.gro"
    file.write_text(text)
    both = ["-p", str(file), "-t", str(file)]
    cli.main(["info", *both])
    assert "n_frames: 8" in capsys.readouterr().out
    cli.main(["rmsd", *both, "-s", "all", "-o", str(tmp_path / "r.dat"), "--dt", "2"])
    rows = [tuple(map(float, x.split())) for x in (tmp_path / "r.dat").read_text().splitlines()[1:]]
    assert [r[0] for r in rows] == [2.0 * i for i in range(8)] and rows[0][1] < 1e-5 and all(r[1] > 0 for r in rows[1:])
    cli.main(["rmsf", *both, "-o", str(tmp_path / "f.csv")])
    assert len((tmp_path / "f.csv").read_text().splitlines()) == 3
    cli.main(["cluster", *both, "-s", "all", "--k", "2", "-o", str(tmp_path / "c.xvg"), "--rep-pdb", str(tmp_path / "c.pdb")])
    assert (tmp_path / "c.pdb").read_text().count("ENDMDL") == 2
