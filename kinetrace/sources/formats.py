"""Readers of trajectory and topology formats, from the bytes of one file.

Topologies give (atoms, bonds): atoms as tuples (atom_idx, atom_name, element, residue_id,
residue_name, mass, charge), bonds as pairs. Trajectories give frames (frame_id, time_ps, box or
None, coordinates n x 3); lengths are in angstroms, boxes have cell vectors as rows.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np

from kinetrace import schema

Frame = tuple[int, float, np.ndarray | None, np.ndarray]
NM = 10.0


def _int(text: str, default: int = 0) -> int:
    try:
        return int(text)
    except ValueError:
        return default


def _letter(name: str) -> str:
    """First letter of an atom name after at most one digit."""
    rest = name[1:] if name[:1].isdigit() else name
    return rest[:1].upper() or "X"


def pdb_topology(data: bytes) -> tuple[list[tuple], list[tuple]]:
    atoms = []
    for line in data.decode("utf-8", "replace").splitlines():
        if line.startswith(("ATOM", "HETATM")):
            name = line[12:16].strip()
            element = line[76:78].strip() or name[:1] or "X"
            atoms.append((len(atoms), name[:4], element[:2], _int(line[22:26]), line[17:20].strip()[:4], 0.0, 0.0))
    return atoms, []


def gro_topology(data: bytes) -> tuple[list[tuple], list[tuple]]:
    lines = data.decode("utf-8", "replace").splitlines()
    rows = lines[2 : 2 + int(lines[1])]
    return [(i, r[10:15].strip()[:4], _letter(r[10:15].strip()), _int(r[0:5]), r[5:10].strip()[:4], 0.0, 0.0) for i, r in enumerate(rows)], []


def gro_frames(data: bytes, n_atoms: int) -> Iterator[Frame]:
    lines, at, number = data.decode("utf-8", "replace").splitlines(), 0, 0
    while at + 1 < len(lines) and (lines[at].strip() or lines[at + 1].strip()):
        n = int(lines[at + 1])
        if n != n_atoms:
            raise ValueError(f"frame {number} has {n} atoms, the topology {n_atoms}")
        xyz = np.array([[float(r[c : c + 8]) for c in (20, 28, 36)] for r in lines[at + 2 : at + 2 + n]]).reshape(-1, 3)
        cell = [float(v) * NM for v in lines[at + 2 + n].split()]
        if len(cell) == 3:
            box = np.diag(cell)
        elif len(cell) == 9:  # xx yy zz xy xz yx yz zx zy
            box = np.array([[cell[0], cell[3], cell[4]], [cell[5], cell[1], cell[6]], [cell[7], cell[8], cell[2]]])
        elif cell:
            raise ValueError(f"a box has 3 or 9 numbers, not {len(cell)}")
        else:
            box = None
        yield number, float(number), box if box is not None and box.any() else None, xyz * NM
        at, number = at + 3 + n, number + 1


def mdcrd_frames(data: bytes, n_atoms: int, boxed: bool | None = None) -> Iterator[Frame]:
    values = []
    for line in data.decode("utf-8", "replace").splitlines()[1:]:
        for c in range(0, len(line), 8):
            try:
                values.append(float(line[c : c + 8]))
            except ValueError:
                continue
    if boxed is None:
        boxed = len(values) % (3 * n_atoms + 3) == 0
    width = 3 * n_atoms + 3 * boxed
    for k in range(len(values) // width):
        row = np.array(values[k * width : (k + 1) * width])
        cell = row[3 * n_atoms :]
        yield k, float(k), np.diag(cell) if boxed and cell.any() else None, row[: 3 * n_atoms].reshape(-1, 3)


def prmtop_topology(data: bytes) -> tuple[list[tuple], list[tuple]]:
    sections: dict[str, list] = {}
    name, kind, width = "", "a", 1
    for line in data.decode("utf-8", "replace").splitlines():
        if line.startswith("%FLAG"):
            name = line[5:].strip()
            sections[name] = []
        elif line.startswith("%FORMAT"):
            m = re.search(r"\(\s*\d*\s*([aAiIeEfF])\s*(\d+)", line)
            if m is None:
                raise ValueError(f"unreadable format {line!r}")
            kind, width = m[1].lower(), int(m[2])
        elif name and not line.startswith("%"):
            cells = [line[c : c + width].strip() for c in range(0, len(line.rstrip("\n")), width)]
            sections[name] += [c if kind == "a" else int(c) if kind == "i" else float(c) for c in cells if c]
    if len(sections.get("POINTERS", ())) < 12:
        raise ValueError("POINTERS are missing")
    n, residues = sections["POINTERS"][0], sections["POINTERS"][11]
    names = sections.get("ATOM_NAME") or [f"X{i}" for i in range(n)]
    if len(names) != n:
        raise ValueError(f"{len(names)} atom names for {n} atoms")
    labels, first = sections.get("RESIDUE_LABEL", []), sections.get("RESIDUE_POINTER", [])
    residue = np.searchsorted(np.array(first[:residues]) - 1, np.arange(n), side="right") if first else np.ones(n, int)
    numbers, masses, charges = (sections.get(s) or [0] * n for s in ("ATOMIC_NUMBER", "MASS", "CHARGE"))
    atoms = [(i, names[i][:4], schema.ELEMENTS.get(numbers[i], "X"), int(residue[i]), (labels[residue[i] - 1] if labels else "UNK")[:4], float(masses[i]), charges[i] / schema.AMBER_CHARGE) for i in range(n)]
    bonds = []
    for part in ("BONDS_INC_HYDROGEN", "BONDS_WITHOUT_HYDROGEN"):
        b = sections.get(part, [])
        bonds += [(b[k] // 3, b[k + 1] // 3) for k in range(0, len(b) - 2, 3)]
    return atoms, bonds


def cell_matrix(lengths: list[float], angles: list[float]) -> np.ndarray:
    a, b, c = lengths
    ca, cb, cg = (math.cos(math.radians(x)) for x in angles)
    sg = math.sin(math.radians(angles[2]))
    cy = c * (ca - cb * cg) / sg
    return np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, cy, math.sqrt(max(0.0, c * c - (c * cb) ** 2 - cy * cy))]])


class _Bytes:
    """A big-endian reader that fails on a short read."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError("the file ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, code: str):
        values = struct.unpack(f">{code}", self.take(struct.calcsize(f">{code}")))
        return values[0] if len(values) == 1 else values

    def opaque(self) -> bytes:
        n = self.read("I")
        out = self.take(n)
        self.take(-n % 4)
        return out

    @property
    def done(self) -> bool:
        return self.at >= len(self.data)


_NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf_frames(data: bytes, n_atoms: int) -> Iterator[Frame]:
    """AMBER NetCDF 3 (classic and 64-bit offsets); cells may be float or double."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a NetCDF 3 file")
    r, wide = _Bytes(data, 4), data[3] == 2
    records = r.read("i")

    def entries(read) -> list:
        _, n = r.read("ii")
        return [read() for _ in range(n)]

    def name() -> str:
        return r.opaque().decode()

    def attribute() -> None:
        name()
        kind, n = r.read("ii")
        r.take(-(-n * np.dtype(_NC_TYPES[kind]).itemsize // 4) * 4)

    dims = entries(lambda: (name(), r.read("i")))
    entries(attribute)

    def variable() -> tuple:
        label, ids = name(), [r.read("i") for _ in range(r.read("i"))]
        entries(attribute)
        kind, size = r.read("ii")
        return label, (ids, kind, size, r.read("q" if wide else "i"))

    variables = dict(entries(variable))
    if dict(dims).get("atom") != n_atoms or "coordinates" not in variables:
        raise ValueError("the atoms of the file and of the topology differ")
    moving = {k: v for k, v in variables.items() if v[0] and dims[v[0][0]][1] == 0}
    step = sum(v[2] for v in moving.values())
    if records < 0:
        records = (len(data) - min(v[3] for v in moving.values())) // step

    def value(label: str, k: int) -> np.ndarray | None:
        if label not in moving:
            return None
        ids, kind, _, begin = moving[label]
        n = int(np.prod([dims[i][1] for i in ids[1:]], dtype=int))
        return np.frombuffer(data, _NC_TYPES[kind], n, begin + k * step).astype(float)

    for k in range(records):
        lengths, angles, time = value("cell_lengths", k), value("cell_angles", k), value("time", k)
        box = None
        if lengths is not None and (lengths > 0).all():
            angles = np.full(3, 90.0) if angles is None else angles
            box = np.diag(lengths) if (np.abs(angles - 90) < 0.5).all() else cell_matrix(list(lengths), list(angles))
        yield k, 0.0 if time is None else float(time[0]), box, value("coordinates", k).reshape(-1, 3)


def trr_frames(data: bytes, n_atoms: int) -> Iterator[Frame]:
    r, number = _Bytes(data), 0
    while not r.done:
        if r.read("i") != 1993:
            raise ValueError("not a TRR frame")
        r.read("i")
        r.opaque()
        _, _, box_size, vir, pres, _, _, x_size, v_size, f_size, n, _, _ = r.read("13i")
        if n != n_atoms or not x_size:
            raise ValueError("a frame without coordinates, or with another number of atoms")
        real = "d" if x_size == 24 * n else "f"
        time, _ = r.read(f"2{real}")
        box = np.array(r.read(f"9{real}")).reshape(3, 3) * NM if box_size else None
        r.take(vir + pres)
        xyz = np.frombuffer(r.take(x_size), ">f8" if real == "d" else ">f4").astype(float).reshape(-1, 3) * NM
        r.take(v_size + f_size)
        yield number, float(time), box if box is not None and box.any() else None, xyz
        number += 1


# The steps of the small-number sizes of the XTC format, and its first used index.
MAGIC = [0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216]
FIRST = 9


def packed_bits(sizes: list[int]) -> int:
    """Bits that a number below the product of the sizes takes."""
    return math.prod(sizes).bit_length()


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)

    def triple(self, n: int, sizes: list[int]) -> list[int]:
        """Three numbers packed in mixed radix; whole bytes come least significant first."""
        value, shift = 0, 0
        while n > 0:
            value |= self.read(min(8, n)) << shift
            shift, n = shift + 8, n - 8
        value, c = divmod(value, sizes[2])
        a, b = divmod(value, sizes[1])
        return [a, b, c]


def xtc_coordinates(r: _Bytes, n_atoms: int) -> np.ndarray:
    """Coordinates of one frame, in nanometres."""
    n = r.read("i")
    if n != n_atoms:
        raise ValueError(f"a frame has {n} atoms, the topology {n_atoms}")
    if n <= 9:
        return np.array(r.read(f"{3 * n}f"), dtype=float).reshape(-1, 3)
    precision, *numbers = r.read("f7i")
    low, high, index = numbers[:3], numbers[3:6], numbers[6]
    sizes = [h - l + 1 for l, h in zip(low, high, strict=True)]
    apart = [s.bit_length() for s in sizes] if max(sizes) > 0xFFFFFF else None
    bits, width = _Bits(r.opaque()), packed_bits(sizes)
    out: list[list[int]] = []
    run = 0
    while len(out) < n:
        first = [bits.read(b) for b in apart] if apart else bits.triple(width, sizes)
        first = [v + l for v, l in zip(first, low, strict=True)]
        change = 0
        if bits.read(1):
            run = bits.read(5)
            change = run % 3 - 1
            run -= run % 3
        half, previous = MAGIC[index] // 2, first
        for k in range(0, run, 3):
            step = [v + p - half for v, p in zip(bits.triple(index, [MAGIC[index]] * 3), previous, strict=True)]
            if k == 0:  # the first two atoms of a run stand swapped
                out += [step, first]
            else:
                out.append(step)
            previous = step
        if not run:
            out.append(first)
        index += change
    return np.array(out[:n], dtype=float) / precision


def xtc_frames(data: bytes, n_atoms: int) -> Iterator[Frame]:
    r, number = _Bytes(data), 0
    while not r.done:
        magic, n, _, time = r.read("3if")
        if magic != 1995 or n != n_atoms:
            raise ValueError("not an XTC frame of this topology")
        box = np.array(r.read("9f")).reshape(3, 3) * NM
        yield number, float(time), box if box.any() else None, xtc_coordinates(r, n_atoms) * NM
        number += 1


def xy_table(text: str) -> list[tuple[float, float]]:
    """Pairs of a free-form table: comments and unreadable rows are left out; one column gets its row number."""
    rows = []
    for line in text.splitlines():
        if line.strip() and line.strip()[0] not in "#@&;%":
            try:
                rows.append([float(v) for v in line.replace(",", " ").split()])
            except ValueError:
                continue
    if not rows:
        raise ValueError("the table has no numeric rows")
    if min(map(len, rows)) == 1:
        return [(float(i), r[0]) for i, r in enumerate(rows)]
    return [(r[0], r[1]) for r in rows]


TOPOLOGIES = {".pdb": pdb_topology, ".gro": gro_topology, ".prmtop": prmtop_topology, ".parm7": prmtop_topology}
TRAJECTORIES = {".gro": gro_frames, ".mdcrd": mdcrd_frames, ".crd": mdcrd_frames, ".nc": netcdf_frames, ".ncdf": netcdf_frames, ".trr": trr_frames, ".xtc": xtc_frames}
