"""Molecules, ontologies and residue sets: known formulas, layouts of vocabularies, closures and sets by brute force."""

from __future__ import annotations

import itertools
import random

import pytest

from massloom.functions import chemistry as ch
from massloom.functions.smiles import SmilesError, molecule_formula, molecules, parse_smiles
from massloom.functions.tolerance import Tolerance
from massloom.operators import generate
from massloom.sources import ontology as on
from massloom.sources.vocabulary import obo_stanzas

#: Molecules and their formulas.
KNOWN = [
    ("C", "CH4"), ("O", "H2O"), ("CCO", "C2H6O"), ("C=C", "C2H4"), ("C#N", "CHN"), ("CC(=O)O", "C2H4O2"), ("NCC(=O)O", "C2H5NO2"), ("c1ccccc1", "C6H6"), ("C1CCCCC1", "C6H12"),
    ("c1ccncc1", "C5H5N"), ("c1cc[nH]c1", "C4H5N"), ("Cn1cccc1", "C5H7N"), ("o1cccc1", "C4H4O"), ("s1cccc1", "C4H4S"), ("[NH4+]", "H4N"), ("[13CH4]", "H4[13C]"), ("OS(=O)(=O)O", "H2O4S"), ("OP(=O)(O)O", "H3O4P"), ("CS(C)=O", "C2H6OS"),
    ("C(F)(Cl)(Br)I", "CBrClFI"), ("N[C@@H](C)C(=O)O", "C3H7NO2"), ("F/C=C/F", "C2H2F2"), ("C1CC2CCC1CC2", "C8H14"), ("C%12CC%12", "C3H6"), ("[Na+].[Cl-]", "ClNa"), ("CC(=O)Oc1ccccc1C(=O)O", "C9H8O4"), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C8H10N4O2"),
    ("c1ccc2ccccc2c1", "C10H8"), ("C1=CC=CC=C1", "C6H6"), ("[O-]C(=O)C", "C2H3O2"), ("[Fe++]", "Fe"), ("*C", "CH3"),
]


@pytest.mark.parametrize("text, formula", KNOWN)
def test_formulas_of_molecules(text, formula):
    f = molecule_formula(parse_smiles(text)[0])
    want = formula.replace("H4[13C]", "H4")
    assert {k: v for k, v in f.items() if k != "13C"} == ch.parse_formula(want) and ("13C" in f) == ("13C" in formula)


@pytest.mark.parametrize("text", ["", "C(", "C)", "(C)", "C1CC", "C=", "=C", "C==C", "Xx", "[Na", "C()C", "C11", "C1C1", "C.(C)", "C(.C)", "1CC1", "C=1CC-1", "[C++2]"])
def test_texts_that_are_no_molecules(text):
    with pytest.raises(SmilesError):
        parse_smiles(text)


def test_molecule_columns(spark):
    df = spark.createDataFrame([("C1CC2CCC1CC2",), ("C(",), (None,), ("[NH4+].[Xe]",), (" OCC ",)], "s string")
    a, b, c, d, e = df.select(molecules("s").alias("m")).select("m.*").collect()
    assert (a.formula, a.rings, a.charge, len(a.bonds), a.error) == ("C8H14", 2, 0, 9, None) and a.mass == pytest.approx(110.10955, abs=1e-4)
    assert b.error and b.formula is None and c.error is None and c.formula is None
    assert (d.formula, d.mass, d.charge, d.rings) == ("H4NXe", None, 1, 0) and e.formula == "C2H6O"


def _terms(spark, text):
    return obo_stanzas(spark.createDataFrame([(b,) for b in ("\n" + text).split("\n[")], "value string"))


def test_closure(spark):
    r = random.Random(1)
    links = {(k, r.randrange(k)) for k in range(1, 60) for _ in range(r.randint(0, 2))} | {(100, 101), (101, 102), (102, 100)} | {(k + 1, k) for k in range(200, 237)}
    got = {(x.id, x.ancestor): x.distance for x in on.closure(spark.createDataFrame(sorted(links), "child long, parent long")).collect()}
    want: dict = {}
    for start in {a for a, _ in links}:
        seen, now, n = {}, {start}, 0
        while now:
            n += 1
            now = {p for c, p in links if c in now} - set(seen)
            seen |= dict.fromkeys(now, n)
        want |= {(start, p): d for p, d in seen.items()}
    assert got == want
    assert on.closure(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_protein_modification_terms(spark):
    terms = _terms(spark, """format-version: 1.2
[Term]
id: MOD:00001
name: alkylated
is_a: MOD:01156
xref: DiffFormula: "C 2 H -1 (13)C 3 N 0 O 1"
xref: FormalCharge: "1-"
xref: Origin: "K"
xref: TermSpec: "N-term"
[Term]
id: MOD:00002
name: linked
comment: Cross-link 2.
xref: DiffFormula: "C 0 H -2 N 0 O 0 S 0"
xref: Origin: "C, C"
xref: TermSpec: "none"
[Term]
id: MOD:00003
name: wrong
comment: Cross-link 3; other.
xref: DiffFormula: "what"
xref: Origin: "X"
[Term]
id: MOD:00004
name: plain
is_obsolete: true
""")
    rows = {x.id: x for x in on.psi_mod(terms).collect()}
    a, b, c, d = (rows[f"MOD:0000{k}"] for k in (1, 2, 3, 4))
    assert a.formula == {"C": 2, "H": -1, "13C": 3, "O": 1} and a.delta is None and a.charge == -1 and [(x.residues, x.position) for x in a.rules] == [(["K"], "any_n_term")] and a.cross_linked is None
    assert b.formula == {"H": -2} and b.delta == pytest.approx(-2 * ch.ELEMENTS["H"]) and b.cross_linked == 2 and len(b.rules) == 1 and b.error is None
    assert c.formula is None and c.error.startswith("no formula") and c.rules[0].residues == []
    assert d.obsolete and d.formula is None and d.error is None and not d.rules


def test_cross_linker_terms(spark):
    terms = _terms(spark, """format-version: 1.2
[Term]
id: XLMOD:00001
name: linker
property_value: reactionSites: "2" xsd:nonNegativeInteger
property_value: spacerLength: "11.4" xsd:float
[Term]
id: XLMOD:00002
name: DSS
is_a: XLMOD:00001 ! linker
property_value: bridgeFormula: "C8 H10 O2" xsd:string
property_value: specificities: "(K,Protein N-term)&(E,D,Protein C-term)" xsd:string
[Term]
id: XLMOD:00003
name: heavy
is_a: XLMOD:00002
property_value: spacerLength: "9" xsd:float
property_value: bridgeFormula: "C8 D4 H6 O2" xsd:string
[Term]
id: XLMOD:00004
name: no linker
""".replace("property_value: ", "property_value: ").replace(': "', ' "').replace("bridgeFormula:", "bridgeFormula"))
    rows = {x.id: x for x in on.xl_mod(terms).collect()}
    assert set(rows) == {"XLMOD:00001", "XLMOD:00002", "XLMOD:00003"}
    a, b = rows["XLMOD:00002"], rows["XLMOD:00003"]
    assert (a.sites, a.length, a.formula, a.asymmetric) == (2, 11.4, {"C": 8, "H": 10, "O": 2}, True) and a.delta == pytest.approx(138.06808, abs=1e-4)
    assert [[(x.residues, x.position) for x in side] for side in a.sides] == [[(["K"], "anywhere"), ([], "protein_n_term")], [(["E"], "anywhere"), (["D"], "anywhere"), ([], "protein_c_term")]]
    assert (b.sites, b.length) == (2, 9.0) and b.formula == {"C": 8, "D": 4, "H": 6, "O": 2} and b.sides == a.sides


def test_glycan_terms(spark):
    terms = _terms(spark, """format-version: 1.2
[Term]
id: GNO:00000001
name: glycan of molecular weight 1234.56 Da
[Term]
id: GNO:G1
name: G1
is_a: GNO:00000001
property_value: GNO:00000021 GNO:00000014
property_value: GNO:00000101 "Hex5HexNAc2" xsd:string
[Term]
id: GNO:G2
name: G2
is_a: GNO:G1
property_value: GNO:00000021 GNO:00000016
property_value: GNO:00000034 GNO:G1
property_value: GNO:00000102 "3" xsd:integer
""")
    rows = {x.id: x for x in on.gnome(terms).collect()}
    assert set(rows) == {"GNO:G1", "GNO:G2"}
    assert (rows["GNO:G1"].level, rows["GNO:G1"].weight, rows["GNO:G1"].composition) == ("composition", 1234.56, "Hex5HexNAc2")
    assert (rows["GNO:G2"].level, rows["GNO:G2"].weight, rows["GNO:G2"].composition, rows["GNO:G2"].score) == ("saccharide", 1234.56, "Hex5HexNAc2", 3)


def test_isobaric_sets_by_brute_force(spark):
    fixed, variable = [("f", 57.0, "C")], [("v", 16.0, "MC")]
    n_term, c_term = [("n", 42.0, "AG")], [("c", -1.0, "GK"), ("d", 5.0, "")]
    blocks = generate._blocks("ACGKM", fixed, variable)
    targets = [(k, 200.0 + 37.0 * k) for k in range(12)]
    for most in (1, 2, 4, 5):
        want = set()
        for size in range(1, most + 1):
            for own in itertools.combinations_with_replacement(blocks, size):
                letters = [x for _, x, _ in own]
                for n, mn, on_n in [(None, 0.0, None), *n_term]:
                    for c, mc, on_c in [(None, 0.0, None), *c_term]:
                        first = range(size) if on_n is None else [k for k in range(size) if letters[k] in on_n]
                        last = range(size) if on_c is None else [k for k in range(size) if letters[k] in on_c]
                        if not any(a != b or size == 1 or n is None or c is None for a in first for b in last):
                            continue
                        total = sum(m for _, _, m in own) + ch.WATER + mn + mc
                        want |= {(k, "".join(t for t, _, _ in own), n, c) for k, x in targets if abs(x - total) <= 0.4}
        df = spark.createDataFrame([(k, m, 0.0, "x", 1) for k, m in targets], "k int, mass double, m double, text string, size int")
        got = generate.isobaric_sets(df, "mass", Tolerance.absolute(0.4), most, "ACGKM", fixed, variable, n_term, c_term).collect()
        rows = [(x.k, x.residues, x.n_term, x.c_term) for x in got]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert generate.isobaric_sets(df.limit(0), "mass", Tolerance(1e-5), 4).count() == 0


@pytest.mark.parametrize(
    "text, notation, want",
    [
        ("C2H-1[13C3]O", "proforma", [({"C": 2, "H": -1, "13C": 3, "O": 1}, 0)]),
        ("C2H3:z+1", "proforma", [({"C": 2, "H": 3}, 1)]),
        ("C 2 H -1 (13)C 3 N 0 O 1", "psi_mod", [({"C": 2, "H": -1, "13C": 3, "O": 1}, 0)]),
        ("C8 H6 D4 O2 N-1", "xl_mod", [({"C": 8, "H": 6, "2H": 4, "O": 2, "N": -1}, 0)]),
        ("H(25) C(8) 13C(7) N 15N(2) O(3)", "unimod", [({"H": 25, "C": 8, "13C": 7, "N": 1, "15N": 2, "O": 3}, 0)]),
        ("H(6) C(4) N(2) dHex", "unimod", [({"H": 16, "C": 10, "N": 2, "O": 4}, 0)]),
        ("Water", "unimod", [({"H": 2, "O": 1}, 0)]),
        ("C 2 H 3 N 1 O 1 +", "resid", [({"C": 2, "H": 3, "N": 1, "O": 1}, 1)]),
        ("C 4 H 5 N 1 O 3, C 4 H 6 N 2 O 2 2-", "resid", [({"C": 4, "H": 5, "N": 1, "O": 3}, 0), ({"C": 4, "H": 6, "N": 2, "O": 2}, -2)]),
        ("[NH4+]", "smiles", [({"N": 1, "H": 4}, 1)]),
    ],
)
def test_formula_notations(text, notation, want):
    from massloom.functions.formulas import read_formula

    assert read_formula(text, notation) == want


@pytest.mark.parametrize("text, notation", [("", "psi_mod"), ("C 2 ?", "psi_mod"), ("Zz3", "xl_mod"), ("C(", "unimod"), ("what", "unimod"), ("C2 H3", "resid"), ("C", "none"), ("C(", "smiles"), ("C[99C2]", "proforma")])
def test_texts_that_are_no_formulas(spark, text, notation):
    from massloom.functions.formulas import formulas, read_formula

    with pytest.raises(ValueError):
        read_formula(text, notation)
    if notation in ("psi_mod", "unimod"):
        df = spark.createDataFrame([(text,), (None,)], "t string").select(formulas("t", notation).alias("f")).select("f.*").collect()
        assert [(x.formulas, x.error is None) for x in df] == [(None, False), (None, True)]


def test_unimod_xml(spark, tmp_path):
    (tmp_path / "unimod.xml").write_text("""<?xml version="1.0"?><umod:unimod xmlns:umod="http://www.unimod.org/xmlns/schema/unimod_2"><umod:modifications>
<umod:mod title="Acetyl" full_name="Acetylation" record_id="1"><umod:specificity site="K" position="Anywhere" classification="Multiple" hidden="1"/><umod:specificity site="N-term" position="Protein N-term" classification="PT" hidden="0"/>
<umod:delta mono_mass="42.010565" avge_mass="42.0367" composition="H(2) C(2) O"/></umod:mod>
<umod:mod title="Phospho" full_name="Phosphorylation" record_id="21"><umod:specificity site="S" position="Anywhere"><umod:NeutralLoss mono_mass="97.976896" composition="H(3) O(4) P"/><umod:NeutralLoss mono_mass="0" composition="0"/></umod:specificity><umod:delta mono_mass="79.966331" composition="H O(3) P"/></umod:mod>
</umod:modifications></umod:unimod>""")
    rows = {x.id: x for x in on.read_unimod(spark, f"{tmp_path}/unimod.xml").collect()}
    a, b = rows["UNIMOD:1"], rows["UNIMOD:21"]
    assert (a.name, a.description, a.composition, a.delta) == ("Acetyl", "Acetylation", "H(2) C(2) O", 42.010565) and a.error is None
    assert [(r.residues, r.position) for r in a.rules] == [(["K"], "anywhere"), ([], "protein_n_term")]
    assert b.formula == {"H": 1, "O": 3, "P": 1} and [list(r.losses) for r in b.rules] == [[97.976896]]


def test_matrices():
    from massloom.operators import alignment as al

    own = al.read_matrix("# comment\n   A  R\nA  4 -1\nR -1  5\n")
    assert own["A", "R"] == -1 and own["R", "R"] == 5 and own["A", "W"] == -1 and own["W", "W"] == -1
    assert al.align("AR", "AR", scoring=al.Scoring(matrix=own)).score == 9
    for bad in ("", "A R\nA 1\n", "A\nR 1\n"):
        with pytest.raises(ValueError):
            al.read_matrix(bad)
