"""Chemical formulas in the notations of databases: ProForma, PSI-MOD, XL-MOD, Unimod, RESID and SMILES."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from massloom.functions.chemistry import ELEMENTS, ISOTOPE_MASSES, formula_mass, hill, parse_formula
from massloom.functions.modifications import SUGARS
from massloom.functions.smiles import molecule_formula, parse_smiles

#: Short names of groups in Unimod compositions.
UNIMOD_GROUPS = {"ac": "C2H2O", "me": "CH2", "kdn": "C9H14O8", "kdo": "C8H12O7", "sulf": "SO3", "phos": "PO3", "water": "H2O", "hep": "C7H12O6", "dhex": "C6H10O4"}
_GROUPS = UNIMOD_GROUPS | {k.lower(): v for k, v in SUGARS.items() if k.lower() not in UNIMOD_GROUPS}
_SYMBOL = re.compile(r"[A-Z][a-z]?")
NOTATIONS = ("proforma", "psi_mod", "xl_mod", "unimod", "resid", "smiles")

Formula = tuple[dict[str, int], int]


def _known(formula: dict[str, int], text: str) -> dict[str, int]:
    for k in formula:
        if k not in ELEMENTS and k not in ISOTOPE_MASSES:
            raise ValueError(f"no element {k} in {text!r}")
    return {k: n for k, n in formula.items() if n}


def _spaced(text: str, pattern: str) -> dict[str, int]:
    """Counts of tokens (isotope, symbol, number) that fill the text; D is 2H."""
    out: dict[str, int] = {}
    at, token = 0, re.compile(pattern)
    while at < len(text):
        m = token.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"no formula: {text!r} at {at}")
        if m["symbol"]:
            key = "2H" if m["symbol"] == "D" else f"{m['isotope'] or ''}{m['symbol']}"
            out[key] = out.get(key, 0) + int(m["n"] or 1)
        at = m.end()
    if not out:
        raise ValueError("no formula: an empty text")
    return out


def _unimod(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for part in text.split():
        m = re.fullmatch(r"(\d*)([A-Za-z]+)(?:\((-?\d+)\))?", part)
        if not m:
            raise ValueError(f"no formula: {text!r} at {part!r}")
        n, name = int(m[3] or 1), m[2]
        group = _GROUPS.get(name.lower()) if not m[1] and name not in ELEMENTS else None
        for key, k in (parse_formula(group) if group else {f"{m[1]}{name}": 1}).items():
            out[key] = out.get(key, 0) + k * n
    if not out:
        raise ValueError("no formula: an empty text")
    return out


def read_formula(text: str, notation: str) -> list[Formula]:
    """Formulas (counts by element, an isotope's key is such as 13C) and charges; RESID texts may hold several. ValueError for what is none."""
    text = text.strip()
    if notation == "proforma":
        own, _, z = text.partition(":z")
        return [(_known(parse_formula(own), text), int(z) if z else 0)]
    if notation == "psi_mod":
        return [(_known(_spaced(text.strip('"'), r"(?:\((?P<isotope>\d+)\))?(?P<symbol>[A-Z][a-z]?)\s*(?P<n>-?\d+)?\s*"), text), 0)]
    if notation == "xl_mod":
        return [(_known(_spaced(text.strip('"'), r"(?P<isotope>\d+)?(?P<symbol>[A-Z][a-z]?)(?P<n>-?\d+)?\s*"), text), 0)]
    if notation == "unimod":
        return [(_known(_unimod(text), text), 0)]
    if notation == "resid":
        out = []
        for part in text.split(","):
            m = re.fullmatch(r"\s*(.*?)\s*(?:(\d*)([+-]))?\s*", part)
            z = int(m[2] or 1) * (1 if m[3] == "+" else -1) if m[3] else 0
            out.append((_known(_spaced(m[1], r"(?P<isotope>)(?P<symbol>[A-Z][a-z]?)\s+(?P<n>-?\d+)\s*"), text), z))
        return out
    if notation == "smiles":
        atoms, _ = parse_smiles(text)
        return [(_known(molecule_formula(atoms), text), sum(a.charge for a in atoms))]
    raise ValueError(f"no notation {notation}")


SCHEMA = "formulas array<struct<formula:map<string,int>,hill:string,mass:double,charge:int>>, error string"


def formulas(text: Column | str, notation: str) -> Column:
    """Struct of formulas (counts, Hill notation, mass, charge) and error of texts in one of NOTATIONS; null stays null."""
    if notation not in NOTATIONS:
        raise ValueError(f"no notation {notation}")

    def one(t: str | None) -> tuple:
        if t is None:
            return None, None
        try:
            return [{"formula": f, "hill": hill(f), "mass": formula_mass(f, ELEMENTS | ISOTOPE_MASSES), "charge": z} for f, z in read_formula(t, notation)], None
        except ValueError as e:
            return None, str(e)

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=["formulas", "error"])

    return run(text)
