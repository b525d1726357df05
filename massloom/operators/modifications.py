"""Modifications: placement rules, searches by mass, formula or glycan composition, replacement of mass shifts, glycan fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massloom.functions.chemistry import ELEMENTS, formula_mass, hill, parse_formula
from massloom.functions.modifications import MODIFICATIONS, SUGARS, composition, glycan_formula, sub_compositions
from massloom.functions.tolerance import Tolerance
from massloom.operators.joins import band_join

#: Positions of a residue in its chain that a rule can ask for.
POSITIONS = ("anywhere", "any_n_term", "any_c_term", "protein_n_term", "protein_c_term")


def modification_table(spark: SparkSession) -> DataFrame:
    """id, name, formula (Hill), delta, residues."""
    rows = []
    for id_, name, text, residues in MODIFICATIONS:
        formula = parse_formula(text)
        rows.append((id_, name, hill(formula), formula_mass(formula), list(residues)))
    return spark.createDataFrame(rows, "id string, name string, formula string, delta double, residues array<string>")


def placed(rules: Column, residue: Column, index: Column, length: Column, starts: Column | None = None, ends: Column | None = None) -> Column:
    """Whether one of the rules (residues: array<string>, position) allows a residue at index (from 0) of a chain; no residues: any.
    starts, ends: whether the chain's ends are those of its protein; without them any end may be."""
    starts, ends = (F.lit(True) if x is None else x for x in (starts, ends))

    def one(r: Column) -> Column:
        first, last = index == 0, index == length - 1
        here = F.when(r["position"] == "any_n_term", first).when(r["position"] == "any_c_term", last).when(r["position"] == "protein_n_term", first & starts).when(r["position"] == "protein_c_term", last & ends).otherwise(True)
        return here & ((F.size(r["residues"]) == 0) | F.array_contains(r["residues"], residue))

    return F.exists(rules, one)


def rules_within(narrow: Column, wide: Column) -> Column:
    """Whether each rule of `narrow` is covered by one of `wide` at the same position (or anywhere)."""
    return F.forall(narrow, lambda a: F.exists(wide, lambda b: ((b["position"] == "anywhere") | (a["position"] == b["position"])) & (F.size(F.array_except(a["residues"], b["residues"])) == 0)))


def merge_rules(rules: Column) -> Column:
    """One rule per position, of all its residues."""
    positions = F.array_distinct(F.transform(rules, lambda r: r["position"]))
    return F.transform(positions, lambda p: F.struct(p.alias("position"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(rules, lambda r: r["position"] == p), lambda r: r["residues"])))).alias("residues")))


def find_by_mass(targets: DataFrame, modifications: DataFrame, tol: Tolerance, delta: str = "delta_mass", residue: str | None = None, index: str | None = None, length: str | None = None) -> DataFrame:
    """targets with every modification (mod_*) whose mass is within tolerance and that the target can carry.

    residue: a column of the target's residue, which must be one of the modification's. index and length: columns of its place (from 0) and its chain's length; then the modification's `rules`
    (residues, position) decide, an array that is empty for one that can be anywhere.
    """
    table = modifications.select(*(F.col(c).alias(f"mod_{c}") for c in modifications.columns))
    met = band_join(targets, table, (delta, "mod_delta"), tol)
    if index and length and residue:
        return met.where((F.size("mod_rules") == 0) | placed(F.col("mod_rules"), F.col(residue), F.col(index), F.col(length)))
    return met.where(F.array_contains("mod_residues", F.col(residue))) if residue else met


def find_by_formula(targets: DataFrame, modifications: DataFrame, formula: str = "formula") -> DataFrame:
    """targets with every modification of the same formula (both in Hill notation)."""
    table = modifications.select(*(F.col(c).alias(f"mod_{c}") for c in modifications.columns))
    return targets.join(table, targets[formula] == table["mod_formula"])


def replace_mass_shifts(shifts: DataFrame, modifications: DataFrame, tol: Tolerance, closest: bool = True, index: str | None = None, length: str | None = None) -> DataFrame:
    """shifts (residue, delta_mass, ...) and `name`: the only modification that fits, or the closest one; null if none does.

    With columns of place (from 0) and chain length, the modifications' rules decide, so that terminal ones are found at the ends only. Each distinct residue and mass (at a start,
    at an end, or inside) is searched once.
    """
    at_end = bool(index and length)
    first, last = (F.col(index) == 0, F.col(index) == F.col(length) - 1) if at_end else (F.lit(False), F.lit(False))
    named = shifts.withColumn("first_", first).withColumn("last_", last)
    # a place that is like all of its kind
    kind = F.when(F.col("first_"), 0).otherwise(1)
    asked = named.select("residue", "delta_mass", "first_", "last_").distinct().withColumn("place_", kind).withColumn("n_", F.when(F.col("last_"), kind + 1).otherwise(3))
    met = find_by_mass(asked, modifications, tol, residue="residue", **({"index": "place_", "length": "n_"} if at_end else {}))
    own = Window.partitionBy("residue", "delta_mass", "first_", "last_")
    met = met.withColumn("many_", F.count("*").over(own)).withColumn("k_", F.row_number().over(own.orderBy(F.abs(F.col("delta_mass") - F.col("mod_delta")), "mod_name")))
    best = met.where("k_ = 1" if closest else "k_ = 1 and many_ = 1").select(F.col("residue").alias("r_"), F.col("delta_mass").alias("d_"), F.col("first_").alias("f_"), F.col("last_").alias("l_"), F.col("mod_name").alias("name"))
    on = (named["residue"] == F.col("r_")) & (named["delta_mass"] == F.col("d_")) & (named["first_"] == F.col("f_")) & (named["last_"] == F.col("l_"))
    return named.join(best, on, "left").select(*shifts.columns, "name")


def glycan_fragments(glycans: DataFrame, column: str = "glycan", peptide_mass: str | None = None) -> DataFrame:
    """glycans and, for each part of the composition, `part`, `ion` (B: the part alone; Y: the peptide with the rest), `neutral` and `error`.

    A text that is no composition gives one row with `error`; a null or empty one gives none.
    """
    sugars = {s: formula_mass(parse_formula(f), ELEMENTS) for s, f in SUGARS.items()}

    names = ("ion", "part", "mass", "error")

    def one(text: str) -> list[dict]:
        try:
            counts = composition(text)
        except ValueError as e:
            return [dict.fromkeys(names) | {"error": str(e)}]
        total, out = sum(sugars[s] * n for s, n in counts.items()), []
        for p in sub_compositions(counts):
            mass, part = sum(sugars[s] * n for s, n in p.items()), "".join(f"{s}{n}" for s, n in sorted(p.items()))
            out.append(("B", part, mass, None))
            if peptide_mass:
                out.append(("Y", part, total - mass, None))
        return [dict(zip(names, x)) for x in out]

    @F.pandas_udf("array<struct<ion:string,part:string,mass:double,error:string>>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one, na_action="ignore")

    each = glycans.withColumn("p_", F.explode(parts(column)))
    neutral = F.col("p_.mass") + (F.when(F.col("p_.ion") == "Y", F.col(peptide_mass)).otherwise(0.0) if peptide_mass else 0.0)
    return each.select(*glycans.columns, "p_.part", "p_.ion", neutral.alias("neutral"), "p_.error")


def glycan_formulas() -> dict[str, str]:
    """Hill notation of each sugar's residue."""
    return {s: hill(glycan_formula({s: 1})) for s in SUGARS}
