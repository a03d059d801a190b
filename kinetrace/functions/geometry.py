"""Closed-form geometry as SQL expressions, so that superposition stays inside Catalyst.

The optimal superposition of a frame on a reference follows from nine weighted moments. With the
4 x 4 quaternion matrix K of the moments, the largest root of K's characteristic polynomial gives
the RMSD, and a column of the adjugate of K - root the rotation.
"""

from __future__ import annotations

AXES = "xyz"
NEWTON_STEPS = 50


def det(m: list[list[str]]) -> str:
    """Determinant of a small matrix of expressions, by the first row."""
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
    terms = []
    for c, head in enumerate(m[0]):
        rest = [[x for j, x in enumerate(row) if j != c] for row in m[1:]]
        terms.append(f"{'-' if c % 2 else '+'} {head} * {det(rest)}")
    return f"({' '.join(terms).lstrip('+ ')})"


def quaternion_matrix() -> list[list[str]]:
    """K by the moments mxy = sum of weight * mobile x * reference y (centred)."""
    return [
        ["(mxx + myy + mzz)", "(myz - mzy)", "(mzx - mxz)", "(mxy - myx)"],
        ["(myz - mzy)", "(mxx - myy - mzz)", "(mxy + myx)", "(mzx + mxz)"],
        ["(mzx - mxz)", "(mxy + myx)", "(myy - mxx - mzz)", "(myz + mzy)"],
        ["(mxy - myx)", "(mzx + mxz)", "(myz + mzy)", "(mzz - mxx - myy)"],
    ]


C2 = "(-2.0 * (" + " + ".join(f"m{a}{b} * m{a}{b}" for a in AXES for b in AXES) + "))"
C1 = "(-8.0 * " + det([[f"m{a}{b}" for b in AXES] for a in AXES]) + ")"
C0 = det(quaternion_matrix())
NEXT = "CASE WHEN 4.0 * l * l * l + 2.0 * c2 * l + c1 = 0.0 THEN l ELSE l - (l * l * l * l + c2 * l * l + c1 * l + c0) / (4.0 * l * l * l + 2.0 * c2 * l + c1) END"
SPARK_ROOT = f"aggregate(sequence(1, {NEWTON_STEPS}), (ga + gb) / 2.0D, (l, i) -> {NEXT.replace('.0', '.0D')})"
DUCK_ROOT = f"list_reduce(CAST(range({NEWTON_STEPS}) AS DOUBLE[]), lambda l, i: {NEXT}, (ga + gb) / 2.0)"
RMSD = "sqrt(greatest(0.0, ga + gb - 2.0 * root) / w)"


def cofactor(i: int, j: int) -> str:
    """Cofactor (i, j) of K - root * 1."""
    k = [[x if r != c else f"({x} - root)" for c, x in enumerate(row)] for r, row in enumerate(quaternion_matrix())]
    minor = [[x for c, x in enumerate(row) if c != j] for r, row in enumerate(k) if r != i]
    return f"({'-' if (i + j) % 2 else ''}{det(minor)})"


def rotation() -> dict[str, str]:
    """Entries rab of the rotation matrix of the unit quaternion q0..q3."""
    return {
        "rxx": "(q0 * q0 + q1 * q1 - q2 * q2 - q3 * q3)", "rxy": "(2.0 * (q1 * q2 - q0 * q3))", "rxz": "(2.0 * (q1 * q3 + q0 * q2))",
        "ryx": "(2.0 * (q1 * q2 + q0 * q3))", "ryy": "(q0 * q0 - q1 * q1 + q2 * q2 - q3 * q3)", "ryz": "(2.0 * (q2 * q3 - q0 * q1))",
        "rzx": "(2.0 * (q1 * q3 - q0 * q2))", "rzy": "(2.0 * (q2 * q3 + q0 * q1))", "rzz": "(q0 * q0 - q1 * q1 - q2 * q2 + q3 * q3)",
    }


def spark(expression: str) -> str:
    """Decimal literals made doubles."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\dD])", r"\1D", expression)
