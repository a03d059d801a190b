import struct

import numpy as np
import pytest

from kinetrace.sources import formats as f

XYZ = np.arange(9, dtype=float).reshape(3, 3) / 10


def test_gro_two_frames():
    atoms = "".join(f"{1:5d}{'ALA':<5s}{n:>5s}{i:5d}{0.1 * i:8.3f}{0.2:8.3f}{0.3:8.3f}\n" for i, n in enumerate(("N", "1HB", "CA")))
    text = (f"t\n3\n{atoms}2.0 2.0 2.0\n" + f"t\n3\n{atoms}2 2 2 0 0 1 0 0.5 0.5\n").encode()
    frames = list(f.gro_frames(text, 3))
    assert [x[0] for x in frames] == [0, 1] and np.allclose(frames[0][2], np.eye(3) * 20) and np.allclose(frames[1][2], [[20, 0, 0], [10, 20, 0], [5, 5, 20]])
    assert np.allclose(frames[0][3][2], [2.0, 2.0, 3.0])
    assert [a[2] for a in f.gro_topology(text)[0]] == ["N", "H", "C"]
    with pytest.raises(ValueError):
        list(f.gro_frames(text, 4))


def test_pdb():
    line = "ATOM      1  CA  ALA A  xx      11.000  12.000  13.000  1.00  0.00\nHETATM    2  O   HOH A   7      11.000  12.000  13.000  1.00  0.00           O\n"
    atoms, _ = f.pdb_topology(line.encode())
    assert atoms == [(0, "CA", "C", 0, "ALA", 0.0, 0.0), (1, "O", "O", 7, "HOH", 0.0, 0.0)]


def test_prmtop():
    pointers = [4] + [0] * 10 + [2] + [0] * 20
    text = "%VERSION\n%FLAG POINTERS\n%FORMAT(10I8)\n" + "\n".join("".join(f"{v:8d}" for v in pointers[k : k + 10]) for k in range(0, 32, 10))
    text += "\n%FLAG ATOM_NAME\n%FORMAT(20a4)\nN   H   C   O   \n%FLAG CHARGE\n%FORMAT(5E16.8)\n" + "".join(f"{v:16.8E}" for v in (18.2223, 0, 0, 0)) + "\n%FLAG ATOMIC_NUMBER\n%FORMAT(10I8)\n" + "".join(f"{v:8d}" for v in (7, 1, 6, 8))
    text += "\n%FLAG RESIDUE_LABEL\n%FORMAT(20a4)\nALA GLY \n%FLAG RESIDUE_POINTER\n%FORMAT(10I8)\n" + f"{1:8d}{3:8d}" + "\n%FLAG BONDS_INC_HYDROGEN\n%FORMAT(10I8)\n" + f"{0:8d}{3:8d}{1:8d}" + "\n%FLAG BONDS_WITHOUT_HYDROGEN\n%FORMAT(10I8)\n" + f"{6:8d}{9:8d}{1:8d}\n"
    atoms, bonds = f.prmtop_topology(text.encode())
    assert [a[3] for a in atoms] == [1, 1, 2, 2] and atoms[0][6] == pytest.approx(1.0) and atoms[3][2] == "O" and bonds == [(0, 1), (2, 3)]


def test_mdcrd_box_rule():
    cells = lambda v: "\n".join("".join(f"{x:8.3f}" for x in v[k : k + 10]) for k in range(0, len(v), 10))
    boxed = list(f.mdcrd_frames(("t\n" + cells([1.0] * 9 + [5.0] * 3)).encode(), 3))
    plain = list(f.mdcrd_frames(("t\n" + cells([1.0] * 9)).encode(), 3))
    assert np.allclose(boxed[0][2], np.eye(3) * 5) and plain[0][2] is None


def test_netcdf_with_double_cells():
    def name(s):
        return struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    dims = [("frame", 0), ("spatial", 3), ("atom", 3), ("cell", 3)]
    specs = [("coordinates", [0, 2, 1], 5, 36), ("time", [0], 5, 4), ("cell_lengths", [0, 3], 6, 24)]
    head = b"CDF\x01" + struct.pack(">i", 2) + struct.pack(">ii", 10, len(dims)) + b"".join(name(n) + struct.pack(">i", k) for n, k in dims) + struct.pack(">ii", 0, 0)
    size = len(head) + 8 + sum(len(name(n)) + 4 + 4 * len(i) + 8 + 12 for n, i, _, _ in specs)
    at, table = size, b""
    for n, ids, kind, width in specs:
        table += name(n) + struct.pack(">i", len(ids)) + struct.pack(f">{len(ids)}i", *ids) + struct.pack(">ii", 0, 0) + struct.pack(">iii", kind, width, at)
        at += width
    record = lambda t: XYZ.astype(">f4").tobytes() + struct.pack(">f", t) + struct.pack(">3d", 10, 11, 12)
    data = head + struct.pack(">ii", 11, len(specs)) + table + record(0.5) + record(1.5)
    frames = list(f.netcdf_frames(data, 3))
    assert [x[1] for x in frames] == [0.5, 1.5] and np.allclose(frames[1][3], XYZ, atol=1e-6) and np.allclose(frames[0][2], np.diag([10, 11, 12]))


@pytest.mark.parametrize("real", ["f", "d"])
def test_trr(real):
    n, size = 3, 4 if real == "f" else 8
    head = struct.pack(">ii", 1993, 13) + struct.pack(">I", 12) + b"GMX_trn_file" + struct.pack(">13i", 0, 0, 9 * size, 0, 0, 0, 0, 3 * n * size, 0, 0, n, 0, 0)
    data = head + struct.pack(f">2{real}", 2.0, 0) + struct.pack(f">9{real}", *np.eye(3).ravel() * 2) + struct.pack(f">9{real}", *XYZ.ravel())
    (frame,) = f.trr_frames(data, n)
    assert frame[1] == 2.0 and np.allclose(frame[3], XYZ * 10, atol=1e-5) and np.allclose(frame[2], np.eye(3) * 20)


def test_packed_bits():
    assert [f.packed_bits([k] * 3) for k in (15696, 8, 256)] == [42, 10, 25]


class _Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def triple(self, values, sizes, n):
        packed = (values[0] * sizes[1] + values[1]) * sizes[2] + values[2]
        while n > 0:
            self.put(packed & 0xFF if n >= 8 else packed, min(8, n))
            packed, n = packed >> 8, n - 8

    def data(self):
        bits = self.bits + "0" * (-len(self.bits) % 8)
        raw = int(bits, 2).to_bytes(len(bits) // 8, "big")
        return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def test_xtc_with_a_run():
    ints = [[100, 200, 300], [103, 198, 301], [101, 199, 299], *[[10 * k, 500 - k, 7 * k] for k in range(9)]]
    low, high = [min(c) for c in zip(*ints)], [max(c) for c in zip(*ints)]
    sizes, index = [h - l + 1 for l, h in zip(low, high)], 12
    half, w = f.MAGIC[index] // 2, _Writer()
    width = f.packed_bits(sizes)
    w.triple([v - l for v, l in zip(ints[1], low)], sizes, width)  # a run writes its second atom first
    w.put(1, 1)
    w.put(2 * 3 + 1, 5)  # two small steps, size unchanged
    w.triple([a - b + half for a, b in zip(ints[0], ints[1])], [f.MAGIC[index]] * 3, index)
    w.triple([a - b + half for a, b in zip(ints[2], ints[0])], [f.MAGIC[index]] * 3, index)
    for k, atom in enumerate(ints[3:]):
        w.triple([v - l for v, l in zip(atom, low)], sizes, width)
        w.put(1 if k == 0 else 0, 1)
        if k == 0:
            w.put(1, 5)  # the run ends
    data = struct.pack(">3if9f", 1995, 12, 0, 3.0, *[0.0] * 9) + struct.pack(">if7i", 12, 100.0, *low, *high, index) + w.data()
    (frame,) = f.xtc_frames(data, 12)
    assert frame[1] == 3.0 and frame[2] is None and np.allclose(frame[3], np.array(ints) / 100 * 10)


def test_xtc_few_atoms():
    data = struct.pack(">3if9f", 1995, 3, 0, 1.0, *np.eye(3).ravel()) + struct.pack(">i9f", 3, *XYZ.ravel())
    assert np.allclose(next(f.xtc_frames(data, 3))[3], XYZ * 10, atol=1e-5)


def test_xy_table():
    assert f.xy_table("# c\n@ x\n1, 2 3\nbad row\n4 5\n") == [(1.0, 2.0), (4.0, 5.0)]
    assert f.xy_table("7\n8 9\n") == [(0.0, 7.0), (1.0, 8.0)]
    with pytest.raises(ValueError):
        f.xy_table("# only\n")
