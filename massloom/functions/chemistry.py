"""Masses of residues and elements, and mass arithmetic as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letter, monoisotopic mass (Da), average mass (Da), formula of the residue.
RESIDUES = [
    ("A", 71.037113783, 71.07793, "C3H5NO"),
    ("R", 156.101111019036, 156.18612, "C6H12N4O"),
    ("N", 114.042927438408, 114.10276, "C4H6N2O2"),
    ("D", 115.02694302152, 115.08733, "C4H5NO3"),
    ("C", 103.00918495654, 103.14543, "C3H5NOS"),
    ("Q", 128.058577502204, 128.12931, "C5H8N2O2"),
    ("E", 129.042593085316, 129.11388, "C5H7NO3"),
    ("G", 57.021463719204, 57.05138, "C2H3NO"),
    ("H", 137.058911855296, 137.13939, "C6H7N3O"),
    ("I", 113.084063974388, 113.15758, "C6H11NO"),
    ("L", 113.084063974388, 113.15758, "C6H11NO"),
    ("K", 128.094963010536, 128.17241, "C6H12N2O"),
    ("M", 131.040485084132, 131.19853, "C5H9NOS"),
    ("F", 147.068413910592, 147.17343, "C9H9NO"),
    ("P", 97.052763846796, 97.11508, "C5H7NO"),
    ("S", 87.03202840226, 87.07733, "C3H5NO2"),
    ("T", 101.047678466056, 101.10388, "C4H7NO2"),
    ("W", 186.07931294674, 186.20946, "C11H10N2O"),
    ("Y", 163.063328529852, 163.17283, "C9H9NO2"),
    ("V", 99.068413910592, 99.13103, "C5H9NO"),
    ("J", 113.084063974388, 113.15758, "C6H11NO"),
    ("U", 150.953635544, 150.04893, "C3H5NOSe"),
    ("O", 225.147726857332, 225.28749, "C11H19N3O2"),
    ("X", 0.0, 0.0, ""),
]
MONO = {r[0]: r[1] for r in RESIDUES}
AVERAGE = {r[0]: r[2] for r in RESIDUES}
FORMULA = {r[0]: r[3] for r in RESIDUES}
#: Letters that stand for one of two residues.
AMBIGUOUS = {"B": ("N", "D"), "Z": ("Q", "E")}
#: The twenty usual residues, in the order of substitution matrices.
STANDARD = "ARNDCQEGHILKMFPSTWYV"

#: Monoisotopic masses (Da) of elements.
ELEMENTS = {
    "H": 1.0078250319, "C": 12.0, "N": 14.0030740043, "O": 15.9949146193, "P": 30.97376199842, "S": 31.9720711735, "Se": 79.9165218,
    "Li": 7.01600455, "B": 11.0093054, "F": 18.99840322, "Na": 22.98976928, "Mg": 23.9850417, "Al": 26.98153863, "Si": 27.9769265325, "Cl": 34.96885268, "K": 38.96370668, "Ca": 39.96259098,
    "Mn": 54.9380451, "Fe": 55.9349375, "Co": 58.933195, "Ni": 57.9353429, "Cu": 62.9295975, "Zn": 63.9291422, "As": 74.9215965, "Br": 78.9183371, "Ag": 106.905097, "I": 126.904473,
}
#: Masses (Da) of heavier isotopes, by the key that formulas have for them.
ISOTOPE_MASSES = {"2H": 2.0141017778, "13C": 13.0033548378, "15N": 15.0001088982, "17O": 16.9991317, "18O": 17.999161, "34S": 33.9678669}
#: Average weights (Da) of elements.
WEIGHTS = {"H": 1.00794, "C": 12.0107, "N": 14.0067, "O": 15.9994, "P": 30.973762, "S": 32.065, "Se": 78.96}
#: Heavier isotopes of elements as (neutrons more, natural share).
ISOTOPES = {"H": [(1, 0.000115)], "C": [(1, 0.0107)], "N": [(1, 0.00364)], "O": [(1, 0.00038), (2, 0.00205)], "S": [(1, 0.0075), (2, 0.0425), (4, 0.0001)]}
ELECTRON = 5.48579909065e-4
PROTON = ELEMENTS["H"] - ELECTRON
WATER = 2 * ELEMENTS["H"] + ELEMENTS["O"]
#: Mass between neighbouring peaks of an isotope pattern (Da).
ISOTOPE_STEP = 1.00335483534


def residue_table(spark: SparkSession) -> DataFrame:
    """aa, idx, mono_da, avg_da, formula."""
    return spark.createDataFrame([(a, k, m, w, f) for k, (a, m, w, f) in enumerate(RESIDUES)], "aa string, idx int, mono_da double, avg_da double, formula string")


def letter_count(sequence: Column, letter: str) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, F.lit(letter), F.lit("")))


def residue_sum(sequence: Column, masses: dict[str, float] = MONO, letters: str = STANDARD) -> Column:
    """Sum of the residue masses of an unambiguous sequence, by letter counts; no explode."""
    total = F.lit(0.0)
    for a in letters:
        total = total + letter_count(sequence, a) * F.lit(masses[a])
    return total


def peptide_mass(sequence: Column, masses: dict[str, float] = MONO, letters: str = STANDARD) -> Column:
    """Neutral mass: residues and water."""
    return residue_sum(sequence, masses, letters) + F.lit(WATER)


def mass_options(sequence: Column, letters: str = STANDARD + "JUOX") -> Column:
    """All distinct neutral masses of a sequence with B and Z, each of which stands for either of two residues.

    With k of B and m of Z there are at most (k + 1) * (m + 1) of them, not 2 ** (k + m).
    """
    base = peptide_mass(sequence, letters=letters)
    out = F.array(base)
    for letter, (a, b) in AMBIGUOUS.items():
        out = _with_either(out, letter_count(sequence, letter), MONO[a], MONO[b])
    return F.array_sort(F.array_distinct(out))


def _with_either(masses: Column, n: Column, a: float, b: float) -> Column:
    """The masses with n more residues, each of mass a or b."""
    extra = F.transform(F.sequence(F.lit(0), n), lambda k: k * F.lit(a) + (n - k) * F.lit(b))
    return F.flatten(F.transform(masses, lambda m: F.transform(extra, lambda x: m + x)))


def mass_bounds(options: Column) -> Column:
    return F.struct(F.array_min(options).alias("lo"), F.array_max(options).alias("hi"))


def mz(mass: Column, charge: Column | int) -> Column:
    z = F.lit(charge) if isinstance(charge, int) else charge
    return (mass + z * F.lit(PROTON)) / z


def sql_residue_sum(sequence: str, letters: str = STANDARD) -> str:
    """residue_sum for DuckDB, term by term in the same order."""
    return "(0.0::DOUBLE" + "".join(f" + (length({sequence}) - length(replace({sequence}, '{a}', ''))) * {MONO[a]!r}::DOUBLE" for a in letters) + ")"


_ATOM = re.compile(r"(\[[0-9]+)?([A-Z][a-z]?)(-?[0-9]*)\]?(-?[0-9]*)")


def parse_formula(text: str) -> dict[str, int]:
    """Counts by element of a formula such as C6H12O6 or C2[13C2]H4; an isotope's key is such as 13C. Spaces are skipped."""
    out: dict[str, int] = {}
    at, text = 0, text.replace(" ", "")
    while at < len(text):
        m = _ATOM.match(text, at)
        if not m:
            raise ValueError(f"no formula: {text!r} at {at}")
        isotope = (m[1] or "")[1:]
        n = m[3] if isotope or m[3] not in ("",) else m[4]
        key = isotope + m[2]
        out[key] = out.get(key, 0) + int(n or 1)
        at = m.end()
    return {k: v for k, v in out.items() if v}


def hill(formula: dict[str, int]) -> str:
    """Hill notation: C and H first if there is C, the others by letter."""
    first = [k for k in ("C", "H") if k in formula] if "C" in formula else []
    return "".join(k + ("" if formula[k] == 1 else str(formula[k])) for k in [*first, *sorted(set(formula) - set(first))])


def formula_mass(formula: dict[str, int], masses: dict[str, float] = ELEMENTS) -> float:
    return sum(masses[k] * n for k, n in formula.items())


def add_formulas(a: Column, b: Column, sign: int = 1) -> Column:
    """Sum (or difference) of two map<string,int> formulas; elements of count 0 are left out."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.lit(sign) * F.coalesce(y, F.lit(0)))
    return F.map_filter(both, lambda _, n: n != 0)


def map_mass(formula: Column, masses: dict[str, float] = ELEMENTS) -> Column:
    """Mass of a map<string,int> formula; null if it has an unknown element."""
    table = F.create_map(*(F.lit(x) for kv in masses.items() for x in kv))
    return F.aggregate(F.map_entries(formula), F.lit(0.0), lambda acc, e: acc + F.element_at(table, e["key"]) * e["value"])
