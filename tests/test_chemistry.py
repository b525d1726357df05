from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from massloom.functions import chemistry as ch
from massloom.functions.text import codon_table, reverse_complement, translate, trigrams
from massloom.functions.tolerance import Tolerance, ppm, signed_ppm
from massloom.operators import generate


def test_residue_formulas_give_residue_masses():
    for aa, mono, _, formula in ch.RESIDUES:
        if formula and "Se" not in formula:
            assert ch.formula_mass(ch.parse_formula(formula)) == pytest.approx(mono, abs=2e-6), aa


def test_formulas():
    assert ch.parse_formula("C6H12O6") == {"C": 6, "H": 12, "O": 6}
    assert ch.parse_formula("H-2O-1") == {"H": -2, "O": -1}
    assert ch.parse_formula("C2[13C2]H4") == {"C": 2, "13C": 2, "H": 4}
    assert ch.hill({"O": 1, "H": 2, "C": 1, "N": 3}) == "CH2N3O"
    assert ch.hill({"O": 1, "H": 2}) == "H2O"
    with pytest.raises(ValueError):
        ch.parse_formula("6C?")


@given(st.lists(st.sampled_from(ch.STANDARD), min_size=1, max_size=40))
def test_mass_is_the_sum_over_residues(letters):
    assert sum(ch.MONO[a] for a in letters) == pytest.approx(sum(letters.count(a) * ch.MONO[a] for a in set(letters)))


def test_masses(spark):
    df = spark.createDataFrame([("AG",), ("GB",), ("Z",), ("",)], "s string")
    got = df.select(ch.peptide_mass(F.col("s")).alias("m"), ch.mass_options(F.col("s")).alias("o")).collect()
    assert got[0]["m"] == pytest.approx(ch.MONO["A"] + ch.MONO["G"] + ch.WATER)
    assert got[1]["o"] == pytest.approx(sorted(ch.MONO["G"] + ch.MONO[x] + ch.WATER for x in "ND"))
    assert len(got[2]["o"]) == 2 and got[3]["m"] == pytest.approx(ch.WATER)
    maps = spark.sql("SELECT map('C', 2, 'H', 6) a, map('H', 2, 'O', 1) b")
    r = maps.select(ch.add_formulas(F.col("a"), F.col("b")).alias("p"), ch.add_formulas(F.col("a"), F.col("a"), -1).alias("z"), ch.map_mass(F.col("b")).alias("m")).first()
    assert r["p"] == {"C": 2, "H": 8, "O": 1} and r["z"] == {} and r["m"] == pytest.approx(ch.WATER)


def test_tolerance(spark):
    assert Tolerance.parse("10ppm") == Tolerance(1e-5) and Tolerance.parse(" 0.5 Da") == Tolerance(0.5, False) and Tolerance.parse("0.02m/z") == Tolerance(0.02, False)
    with pytest.raises(ValueError):
        Tolerance.parse("ten ppm")
    df = spark.createDataFrame([(100.0, 110.0), (110.0, 100.0), (-100.0, -110.0)], "a double, b double")
    t = Tolerance(0.095)
    assert [r[0] for r in df.select(t.within(F.col("a"), F.col("b"))).collect()] == [False, True, False]
    r = df.select(ppm(F.col("a"), F.col("b")), signed_ppm(F.col("a"), F.col("b")), *t.bounds(F.col("a"))).first()
    assert list(r) == pytest.approx([1e5, -1e5, 90.5, 109.5])
    arrays = spark.sql("SELECT array(1.0D, 100.0D) a, array(50.0D, 101.0D) b")
    assert arrays.select(Tolerance(0.02).within_any(F.col("a"), F.col("b"))).first()[0]


def test_text(spark):
    df = spark.createDataFrame([("ATGGCCTAA", "abcd"), ("AU", "é12"), ("", "ab")], "d string, t string")
    got = df.select(translate(F.col("d")).alias("p"), reverse_complement(F.col("d")).alias("r"), trigrams(F.col("t")).alias("g")).collect()
    assert [r["p"] for r in got] == ["MA*", "", ""] and got[0]["r"] == "TTAGGCCAT"
    assert [r["g"] for r in got] == [["abc", "bcd"], ["\x0012"], []]
    table = codon_table()
    assert table["ATG"] == "M" and table["TAA"] is None and table["GCN"] == "A" and table["RAY"] == "B" and table["NNN"] == "X"


def test_isotopes_and_pi(spark):
    p = generate.isotope_pattern({"C": 60})
    assert p[:3] == pytest.approx([math.comb(60, k) * 0.0107**k * 0.9893 ** (60 - k) for k in range(3)])
    assert generate.isotope_pattern({}).tolist() == [1.0]
    df = spark.createDataFrame([("EMEVEESPEK",), ("AXB",), (None,)], "s string")
    pi = [r["pi"] for r in generate.isoelectric_points(df, "s").collect()]
    assert pi[0] == pytest.approx(3.57, abs=0.01) and pi[1] is None and pi[2] is None
    mass = ch.MONO["A"] + ch.MONO["G"] + ch.WATER
    sets = generate.isobaric_sets(spark.createDataFrame([(mass,)], "m double"), "m", Tolerance.ppm(10))
    assert sorted(r["residues"] for r in sets.collect()) == ["GA", "Q"]


def test_residue_classes(spark):
    from massloom.functions import residues

    table = {r["aa"]: r for r in residues.class_table(spark).collect()}
    assert len(table) == 26 and (table["K"]["charge"], table["W"]["hydrogen_bond"], table["G"]["volume"], table["X"]["polarity"]) == ("positive", "donor", "very_small", "unknown")
    assert all(sum(aa in own for own in kind.values()) == 1 for kind in residues.CLASSES.values() for aa in ch.STANDARD)
    pairs = spark.createDataFrame([("A", "A"), ("X", "K"), ("J", "L"), ("D", "B"), ("Z", "N"), ("I", "L")], "a string, b string")
    assert [r[0] for r in pairs.select(residues.same_residue(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, False, False]
    d = spark.sql("SELECT array(100.0D, 200.0D) a, array(150.0D, 200.5D) b").select(residues.mass_difference(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert d == pytest.approx(0.5)
