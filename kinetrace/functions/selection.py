"""The atom-selection language, compiled to a Column predicate over an atoms table.

    or-list: and-list ("or" and-list)*     and-list: term ("and" term)*
    term: "not" term | "(" or-list ")" | "all" | "protein" | "backbone"
        | "name" words | "resname" words | "resid" ranges | "index" ranges

Words and ranges run up to a bracket or one of and, or, not. Keywords are case-insensitive, names
are compared exactly. Ranges are inclusive; `index` counts from 0 and follows slices, so negative
values count from the end (which needs the number of atoms).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace import schema

_LEXER = re.compile(r"\s+|[()]|[A-Za-z0-9_*+\-]+")
_STOP = {"(", ")", "and", "or", "not"}


class SelectionError(ValueError):
    """A selection that cannot be read."""


def _lex(query: str) -> list[str]:
    out, at = [], 0
    while at < len(query):
        m = _LEXER.match(query, at)
        if m is None:
            raise SelectionError(f"unexpected character {query[at]!r} at {at}")
        if not m[0].isspace():
            out.append(m[0])
        at = m.end()
    if not out:
        raise SelectionError("empty selection")
    return out


class _Compiler:
    def __init__(self, tokens: list[str], n_atoms: int | None):
        self.tokens, self.n_atoms = tokens[::-1], n_atoms

    def ahead(self) -> str | None:
        return self.tokens[-1] if self.tokens else None

    def chain(self, word: str, part, combine) -> Column:
        found = [part()]
        while (self.ahead() or "").lower() == word:
            self.tokens.pop()
            found.append(part())
        return reduce(combine, found)

    def any_of(self) -> Column:
        return self.chain("or", self.all_of, lambda a, b: a | b)

    def all_of(self) -> Column:
        return self.chain("and", self.term, lambda a, b: a & b)

    def term(self) -> Column:
        if not self.tokens:
            raise SelectionError("the selection ends too early")
        token = self.tokens.pop()
        word = token.lower()
        if word == "not":
            return ~self.term()
        if token == "(":
            inner = self.any_of()
            if self.ahead() != ")":
                raise SelectionError(f"expected ')', found {self.ahead()!r}")
            self.tokens.pop()
            return inner
        protein = F.col("residue_name").isin(*schema.PROTEIN)
        if word == "all":
            return F.lit(True)
        if word == "protein":
            return protein
        if word == "backbone":
            return protein & F.col("atom_name").isin(*schema.BACKBONE)
        if word in ("name", "resname"):
            return F.col("atom_name" if word == "name" else "residue_name").isin(*self.words())
        if word in ("resid", "index"):
            column = F.col("residue_id" if word == "resid" else "atom_idx")
            spans = [self.span(w) for w in self.words()]
            if word == "index":
                spans = [self.slice(*s) for s in spans]
            return reduce(lambda a, b: a | b, [column.between(lo, hi) for lo, hi in spans])
        raise SelectionError(f"unknown keyword {token!r}")

    def words(self) -> list[str]:
        out = []
        while self.tokens and self.ahead().lower() not in _STOP:
            out.append(self.tokens.pop())
        if not out:
            raise SelectionError("a keyword needs at least one argument")
        return out

    @staticmethod
    def span(word: str) -> tuple[int, int]:
        lo, dash, hi = (word, "", "") if word.startswith("-") else word.partition("-")
        return (int(lo), int(hi)) if dash else (int(lo), int(lo))

    def slice(self, lo: int, hi: int) -> tuple[int, int]:
        if lo >= 0 and hi >= 0:
            return lo, hi
        if self.n_atoms is None:
            raise SelectionError("negative indices need the number of atoms")
        start, stop, _ = slice(lo, hi + 1).indices(self.n_atoms)
        return start, stop - 1


def predicate(query: str, n_atoms: int | None = None) -> Column:
    """The selection as a boolean Column over atom_idx, atom_name, residue_id and residue_name."""
    compiler = _Compiler(_lex(query), n_atoms)
    out = compiler.any_of()
    if compiler.tokens:
        raise SelectionError(f"unexpected token {compiler.ahead()!r}")
    return out


def select(atoms: DataFrame, query: str) -> DataFrame:
    """The atoms that a selection names. Only negative indices make the table be counted."""
    negative = re.search(r"(?i)\bindex\b[^()]*(?<![\w-])-\d", query)
    return atoms.where(predicate(query, atoms.count() if negative else None))


def not_solvent(names: tuple[str, ...] | None = None) -> Column:
    """True for atoms whose residue is none of the names (default: solvents and ions)."""
    strip = {n.strip().upper() for n in (names if names is not None else schema.SOLVENTS + schema.IONS)}
    return ~F.upper(F.trim("residue_name")).isin(*sorted(strip))


def vdw_radius(element: str = "element") -> Column:
    pairs = [F.lit(x) for item in schema.VDW_RADII.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.trim(element)), F.lit(schema.VDW_DEFAULT))


def atomic_number(element: str = "element") -> Column:
    pairs = [F.lit(x) for z, e in schema.ELEMENTS.items() for x in (e, z)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(element)), F.lit(0))
