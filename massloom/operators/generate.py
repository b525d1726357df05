"""Generators: formulas and residue sets of a mass, isotope patterns, isoelectric points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.chemistry import ELEMENTS, ISOTOPES, MONO, PROTON, WATER, parse_formula
from massloom.functions.tolerance import Tolerance

#: pKa of each residue as (at the N-terminus, side chain, at the C-terminus).
PKA: dict[str, dict[str, tuple[float, float | None, float]]] = {
    "lide": {
        "R": (9.00, 12.10, 2.03), "H": (9.09, 6.04, 1.70), "K": (9.16, 10.67, 2.15), "D": (9.66, 3.71, 1.95), "E": (9.58, 4.15, 2.16),
        "Y": (9.04, 10.10, 2.24), "C": (10.28, 8.14, 1.91), "A": (9.71, None, 2.33), "G": (9.58, None, 2.34), "P": (10.47, None, 1.95),
        "S": (9.05, None, 2.13), "T": (8.96, None, 2.20), "M": (9.08, None, 2.16), "F": (9.09, None, 2.18), "W": (9.34, None, 2.38),
        "V": (9.52, None, 2.27), "I": (9.60, None, 2.26), "L": (9.58, None, 2.32), "Q": (9.00, None, 2.18), "N": (8.73, None, 2.16),
    },
    "lehninger": {
        "R": (9.04, 12.48, 2.17), "H": (9.17, 6.00, 1.82), "K": (8.95, 10.53, 2.18), "D": (9.60, 3.65, 1.88), "E": (9.67, 4.25, 2.19),
        "Y": (9.11, 10.07, 2.20), "C": (10.28, 8.18, 1.96), "A": (9.69, None, 2.34), "G": (9.60, None, 2.34), "P": (10.96, None, 1.99),
        "S": (9.15, None, 2.21), "T": (9.62, None, 2.11), "M": (9.21, None, 2.28), "F": (9.13, None, 1.83), "W": (9.39, None, 2.38),
        "V": (9.62, None, 2.32), "I": (9.68, None, 2.36), "L": (9.60, None, 2.36), "Q": (9.13, None, 2.17), "N": (8.80, None, 2.02),
    },
}
#: Side chains that carry a charge, and its sign.
CHARGED = {"R": 1, "H": 1, "K": 1, "D": -1, "E": -1, "C": -1, "Y": -1}


def find_formulas(targets: DataFrame, mass: str, limits: dict[str, tuple[int, int]], tol: Tolerance) -> DataFrame:
    """targets with n_<element> and formula_mass of every composition within tolerance of the mass; bounds inclusive.

    Elements but the last are counted out (never past the mass), and the last one's counts follow from what is left.
    """
    names = list(limits)
    lo, hi = tol.bounds(F.col(mass))
    out = targets.withColumn("lo_", lo).withColumn("hi_", hi).withColumn("sum_", F.lit(0.0))
    for e in names[:-1]:
        a, b = limits[e]
        most = F.least(F.lit(b), F.floor((F.col("hi_") - F.col("sum_")) / ELEMENTS[e]).cast("int"))
        out = out.where(most >= a).withColumn(f"n_{e}", F.explode(F.sequence(F.lit(a), most))).withColumn("sum_", F.col("sum_") + F.col(f"n_{e}") * F.lit(ELEMENTS[e]))
    e, (a, b) = names[-1], limits[names[-1]]
    # one count to either side, so that rounding loses none; the exact test follows
    first = F.greatest(F.lit(a), F.ceil((F.col("lo_") - F.col("sum_")) / ELEMENTS[e]).cast("int") - 1)
    last = F.least(F.lit(b), F.floor((F.col("hi_") - F.col("sum_")) / ELEMENTS[e]).cast("int") + 1)
    out = out.where(last >= first).withColumn(f"n_{e}", F.explode(F.sequence(first, last)))
    out = out.withColumn("formula_mass", F.col("sum_") + F.col(f"n_{e}") * F.lit(ELEMENTS[e]))
    return out.where(F.col("formula_mass").between(F.col("lo_"), F.col("hi_"))).drop("lo_", "hi_", "sum_")


def _blocks(letters: str, fixed: list[tuple[str, float, str]], variable: list[tuple[str, float, str]]) -> list[tuple[str, str, float]]:
    """Text, letter and mass of each residue with its modifications, by mass; a fixed modification replaces the plain residue."""
    out = []
    for x in letters:
        own = [(f"[{n}]", m) for n, m, on in fixed if x in on]
        base = (x + "".join(n for n, _ in own), MONO[x] + sum(m for _, m in own))
        out += [(base[0], x, base[1]), *((f"{base[0]}[{n}]", x, base[1] + m) for n, m, on in variable if x in on)]
    return sorted(out, key=lambda b: (b[2], b[0]))


def isobaric_sets(
    targets: DataFrame,
    mass: str,
    tol: Tolerance,
    most: int = 3,
    letters: str = "ARNDCQEGHLKMFPSTWYV",
    fixed: list[tuple[str, float, str]] = [],  # noqa: B006
    variable: list[tuple[str, float, str]] = [],  # noqa: B006
    n_term: list[tuple[str, float, str]] = [],  # noqa: B006
    c_term: list[tuple[str, float, str]] = [],  # noqa: B006
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """targets with `residues`, `n_term` and `c_term` of every multiset of up to `most` residues whose peptide mass is within tolerance.

    Modifications are (name, mass, residues that carry it): fixed ones are on each such residue, variable ones may be, one a residue. A terminal one may be on the set if one of its residues can be at that end
    (two different ones if both ends have one); n_term and c_term are null without. Sets meet in the middle: a set in the order of masses is a lower half and an upper half that
    doesn't begin before it ends, halves of up to (most + 1) // 2 residues are made once, and a target asks, for each lower half, the mass bins that can hold an upper half. So the work grows
    with the halves and the results, not with all sets. Upper halves depend on the parameters alone and are broadcast if they are `broadcast_rows` at most.
    """
    spark, blocks = targets.sparkSession, _blocks(letters, list(fixed), list(variable))
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("text"), F.lit(m).alias("m")) for k, (t, _, m) in enumerate(blocks)))
    grown = spark.range(1).select(F.lit("").alias("text"), F.lit(0.0).alias("m"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("size"))
    halves = grown
    for _ in range((most + 1) // 2):
        grown = grown.withColumn("r_", F.explode(F.filter(table, lambda r: r["k"] >= F.col("last"))))
        grown = grown.select(F.concat("text", "r_.text").alias("text"), (F.col("m") + F.col("r_.m")).alias("m"), F.when(F.col("size") == 0, F.col("r_.k")).otherwise(F.col("first")).alias("first"), F.col("r_.k").alias("last"), (F.col("size") + 1).alias("size"))
        halves = halves.unionAll(grown)
    lo, hi = tol.bounds(F.col(mass))
    ends = [(None, 0.0, ""), *n_term], [(None, 0.0, ""), *c_term]
    terms = spark.createDataFrame([(1, a, b, float(x + y), on, of) for a, x, on in ends[0] for b, y, of in ends[1]], "one_ int, n_term string, c_term string, end_ double, on_n_ string, on_c_ string")
    asked = targets.withColumn("one_", F.lit(1)).join(F.broadcast(terms), "one_").withColumn("lo_", lo - F.lit(WATER) - F.col("end_")).withColumn("hi_", hi - F.lit(WATER) - F.col("end_"))
    wide = asked.agg(F.max(F.col("hi_") - F.col("lo_"))).first()[0] or 1.0
    width = F.lit(max(float(wide), 1e-4))
    lower = halves.where(F.col("size") <= most // 2).select(F.lit(1).alias("one_"), F.col("text").alias("text_"), F.col("m").alias("m_"), F.col("last").alias("last_"), F.col("size").alias("size_"))
    upper = halves.where("size > 0").select(F.floor(F.col("m") / width).alias("bin_"), F.col("text").alias("upper_text_"), F.col("m").alias("upper_m_"), F.col("first").alias("upper_first_"), F.col("size").alias("upper_size_"))
    if upper.limit(broadcast_rows + 1).count() <= broadcast_rows:
        upper = F.broadcast(upper)
    # each target goes through the lower halves, of which there are no more than upper ones
    met = asked.join(F.broadcast(lower), "one_").where("m_ <= hi_").drop("one_")
    from_, to = F.floor((F.col("lo_") - F.col("m_")) / width), F.floor((F.col("hi_") - F.col("m_")) / width)
    met = met.withColumn("bin_", F.explode(F.sequence(from_, to))).join(upper, "bin_")
    # of a set of n, the lower half has n // 2
    lower_size, upper_size = F.col("size_"), F.col("upper_size_")
    met = met.where((F.col("upper_first_") >= F.col("last_")) & (upper_size - lower_size).isin(0, 1) & (upper_size + lower_size <= most))
    met = met.where((F.col("m_") + F.col("upper_m_")).between(F.col("lo_"), F.col("hi_"))).withColumn("residues", F.concat("text_", "upper_text_"))
    bare = F.regexp_replace("residues", r"\[[^\]]*\]", "")
    left = lambda on: F.length(F.regexp_replace(bare, F.concat(F.lit("[^#"), on, F.lit("]")), F.lit("")))
    can = (F.col("n_term").isNull() | (left(F.col("on_n_")) > 0)) & (F.col("c_term").isNull() | (left(F.col("on_c_")) > 0))
    two = F.col("n_term").isNull() | F.col("c_term").isNull() | (F.length(bare) == 1) | (left(F.concat("on_n_", "on_c_")) > 1)
    return met.where(can & two).select(*targets.columns, "residues", "n_term", "c_term")


def isotope_pattern(formula: dict[str, int], threshold: float = 1e-6) -> np.ndarray:
    """Probabilities of 0, 1, 2, ... additional neutrons; the tail below threshold is cut."""
    out = np.ones(1)
    for element, n in formula.items():
        for step, share in ISOTOPES.get(element, []):
            term = np.zeros(1)
            term[0] = (1 - share) ** n
            probs, p = [term[0]], term[0]
            for k in range(1, n + 1):
                p = p * (n - k + 1) / k * share / (1 - share)
                probs.append(p)
                if p < threshold * 1e-3 and k > n * share:
                    break
            spread = np.zeros((len(probs) - 1) * step + 1)
            spread[::step] = probs
            out = np.convolve(out, spread)
            last = np.flatnonzero(out >= threshold)
            out = out[: last[-1] + 1] if len(last) else out[:1]
    return out


def isotope_patterns(formula: Column | str) -> Column:
    """isotope_pattern of formula texts; null for texts that are no formula."""

    def one(text: str) -> list[float] | None:
        try:
            return isotope_pattern(parse_formula(text)).tolist()
        except (ValueError, KeyError):
            return None

    @F.pandas_udf("array<double>")
    def run(formulas: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in formulas:
            yield s.map(one, na_action="ignore")

    return run(formula)


def most_abundant(pattern: Column) -> Column:
    """Neutrons of the most abundant peak; the last of equal ones."""
    return F.size(pattern) - F.array_position(F.reverse(pattern), F.array_max(pattern)).cast("int")


def isoelectric_points(peptides: DataFrame, sequence: str, pka: str = "lide", rounds: int = 18) -> DataFrame:
    """peptides and `pi`: bisection of the net charge (Henderson-Hasselbalch) between pH 0 and 14.

    The ends have the pKa of their residues. Null for empty sequences and residues without a pKa.
    """
    table = PKA[pka]
    letters = list(CHARGED)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.notna() & s.fillna("").str.fullmatch("[ARNDCQEGHILKMFPSTWYV]+")
            own = s.where(known, "A")
            n = np.array([[x.count(a) for a in letters] for x in own], float).reshape(len(s), len(letters))
            first, last = np.array([table[x[0]][0] for x in own]), np.array([table[x[-1]][2] for x in own])
            lo, hi = np.zeros(len(s)), np.full(len(s), 14.0)
            for _ in range(rounds):
                ph = (lo + hi) / 2
                charge = 1 / (1 + 10 ** (ph - first)) - 1 / (1 + 10 ** (last - ph))
                for k, a in enumerate(letters):
                    sign = CHARGED[a]
                    charge += sign * n[:, k] / (1 + 10 ** (sign * (ph - table[a][1])))
                lo, hi = np.where(charge > 0, ph, lo), np.where(charge > 0, hi, ph)
            yield pd.Series((lo + hi) / 2).where(known.reset_index(drop=True))

    return peptides.withColumn("pi", run(sequence))


def charge_states(rows: DataFrame, mass: str, lowest: int = 1, highest: Column | int = 4) -> DataFrame:
    """rows for each charge of a range (the lowest at least 1), with mz."""
    top = F.lit(highest) if isinstance(highest, int) else highest
    low = max(1, lowest)
    spread = rows.where(top >= low).withColumn("charge", F.explode(F.sequence(F.lit(low), top)))
    return spread.withColumn("mz", (F.col(mass) + F.col("charge") * F.lit(PROTON)) / F.col("charge"))
