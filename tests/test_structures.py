"""Glycan trees, modified and linked chains: goldens, brute force over all placements and breaks, and bad texts."""

from __future__ import annotations

import itertools
import random

import pytest

from massloom.functions import chemistry as ch
from massloom.functions import masses as ms
from massloom.functions.modifications import modification_mass
from massloom.functions.proforma import ProFormaError, parse
from massloom.operators import fragments as fr
from massloom.operators import generate, glycans
from massloom.operators import modifications as md

ARMS = "Neu5Ac(a2-3)Gal(b1-4)GlcNAc(b1-2)Man(a1-3)[Gal(b1-4)GlcNAc(b1-2)Man(a1-6)]Man(b1-4)GlcNAc(b1-4)[Fuc(a1-6)]GlcNAc(b1-"


def test_structures_are_read_and_written():
    nodes = glycans.read_structure(ARMS)
    assert nodes[0] == ("GlcNAc", -1) and [s for s, p in nodes if p == 0] == ["Fuc", "GlcNAc"] and all(p < k for k, (_, p) in enumerate(nodes))
    assert glycans.composition_of(nodes) == {"HexNAc": 4, "dHex": 1, "Hex": 5, "NeuAc": 1}
    assert glycans.read_structure(glycans.write_structure(nodes)) == nodes
    assert glycans.read_structure("[Fuc][Gal]Man") == [("Man", -1), ("Fuc", 0), ("Gal", 0)]
    for bad in ("", "Xyz", "Gal]", "[Gal", "Gal[Man", "Man[Gal]", "[]Man", "Man GlcNAc"):
        with pytest.raises(ValueError):
            glycans.read_structure(bad)


def _parts(nodes, root):
    """All connected parts whose highest node is root, with the bonds broken below, one by one."""
    below = [[c for c, (_, p) in enumerate(nodes) if p == k] for k in range(len(nodes))]

    def grow(k):
        options = [[((), 1)] + [x for x in grow(c)] for c in below[k]]
        for choice in itertools.product(*options):
            yield (k, *(n for own, _ in choice for n in own)), sum(b for _, b in choice)

    return list(grow(root))


def test_parts_of_trees_by_brute_force():
    r = random.Random(1)
    for _ in range(30):
        n = r.randint(1, 9)
        nodes = [(r.choice(["Man", "GlcNAc", "Fuc", "Gal"]), r.randrange(k) if k else -1) for k in range(n)]
        found = glycans.part_compositions(nodes)
        for root in range(n):
            want: dict = {}
            for own, breaks in _parts(nodes, root):
                counts = glycans.composition_of([nodes[k] for k in own])
                key = "".join(f"{k}{v}" for k, v in sorted(counts.items())), breaks
                want[key] = want.get(key, 0) + 1
            assert dict(found[root]) == want


def test_wide_trees_stay_small():
    nodes = [("Man", -1)] + [("Gal", 0)] * 60
    assert len(glycans.part_compositions(nodes)[0]) == 61 and sum(glycans.part_compositions(nodes)[0].values()) == 2**60


def test_structure_fragments(spark):
    df = spark.createDataFrame([(1, "Gal(b1-4)GlcNAc", 500.0), (2, "what?", 1.0), (3, None, 1.0), (4, "", 1.0)], "id int, glycan string, pep double")
    rows = glycans.structure_fragments(df, "glycan", "pep").collect()
    got = {(x.ion, x.node, x.part, x.breaks, x.ways): round(x.neutral, 3) for x in rows if x.id == 1}
    assert got == {("B", 0, "Hex1HexNAc1", 0, 1): 365.132, ("B", 0, "HexNAc1", 1, 1): 203.079, ("B", 1, "Hex1", 0, 1): 162.053, ("Y", 0, "HexNAc1", 1, 1): 703.079, ("Y", None, "", 1, 1): 500.0}
    assert [(x.id, x.part, x.error is None) for x in rows if x.id > 1] == [(2, None, False), (4, None, False)]
    assert {x.ion for x in glycans.structure_fragments(df.where("id = 1")).collect()} == {"B"}
    own = df.select("id", glycans.structures("glycan").alias("s")).select("id", "s.*").orderBy("id").collect()
    assert [(x.composition, x.error is None) for x in own] == [("Hex1HexNAc1", True), (None, False), (None, True), (None, False)] and own[0].nodes[1].parent == 0


def test_bad_texts_are_rows(spark):
    df = spark.createDataFrame([("bad!",), ("Hex1",), (None,)], "glycan string")
    rows = md.glycan_fragments(df.selectExpr("*", "1.0D AS pep"), peptide_mass="pep").collect()
    assert sorted((x.glycan, x.ion or "-", x.error is None) for x in rows) == [("Hex1", "B", True), ("Hex1", "Y", True), ("bad!", "-", False)]
    patterns = spark.createDataFrame([("Q?9",), ("C6",), (None,), ("Zz2",)], "f string").select(generate.isotope_patterns("f").alias("p")).collect()
    assert [x.p is None for x in patterns] == [True, False, True, False]


def _brute(residues, groups, start, end):
    """groups: (mass, n, places); all placements, each on another residue."""
    out = set()
    for placed in itertools.product(*(itertools.combinations(sorted(p), n) for _, n, p in groups)):
        for letters in itertools.product(*(ch.AMBIGUOUS.get(a, (a,)) for a in residues[start:end])):
            out.add(round(sum(ch.MONO[x] for x in letters) + sum(m * sum(start <= k < end for k in own) for (m, _, _), own in zip(groups, placed)), 3))
    return out


def test_part_masses_by_all_placements():
    r = random.Random(2)
    for _ in range(60):
        letters = "".join(r.choice("AGSTKBZ") for _ in range(r.randint(2, 6)))
        n, groups = len(letters), []
        marks = [""] * n
        for label in ("a", "b")[: r.randint(0, 2)]:
            places = set(r.sample(range(n), r.randint(1, n)))
            mass = r.choice([10.5, 80.25])
            groups.append((mass, 1, places))
            for at, k in enumerate(sorted(places)):
                marks[k] += f"[+{mass}#{label}]" if not at else f"[#{label}]"
        head = ""
        if r.random() < 0.5:
            times = r.randint(1, n)
            groups.append((7.125, times, set(range(n))))
            head = f"[+7.125]^{times}?"
        own = ms.sites(parse(head + "".join(a + m for a, m in zip(letters, marks)))[0].chains[0], {})
        for start in range(n):
            for end in range(start + 1, n + 1):
                assert {round(m, 3) for m in ms.part_masses(own, start, end)} == _brute(letters, groups, start, end)


def test_linked_parts():
    def one(text):
        return ms.Linked.of(parse(text)[0])

    loop = one("AK[+100#XL1]AAK[#XL1]A")
    assert [loop.part(0, 0, k) is None for k in range(1, 6)] == [False, True, True, True, False]
    three = one("K[+10#XL1]AA//K[#XL1]GK[+20#XL2]//AK[#XL2]")
    sums = [sum(ch.MONO[x] for x in s) for s in ("KAA", "KGK", "AK")]
    whole = sum(sums) + 30 + 3 * ch.WATER
    assert next(iter(three.whole())) == pytest.approx(whole, abs=1e-5)
    assert next(iter(three.part(0, 0, 1))) == pytest.approx(whole - ch.WATER - 2 * ch.MONO["A"], abs=1e-5)
    assert next(iter(three.part(0, 1, 3))) == pytest.approx(2 * ch.MONO["A"], abs=1e-5)
    assert next(iter(three.part(1, 0, 2))) == pytest.approx(ch.MONO["K"] + ch.MONO["G"] + 10 + sums[0] + ch.WATER, abs=1e-5)
    ring = one("K[+1#XL1]AK[+2#XL2]//K[#XL1]GK[#XL2]")  # a ring of two chains: no cut between its links sets anything free
    assert ring.part(0, 0, 1) is None and ring.part(0, 0, 2) is None and next(iter(ring.whole())) == pytest.approx(3 + 4 * ch.MONO["K"] + ch.MONO["A"] + ch.MONO["G"] + 2 * ch.WATER, abs=1e-5)


def test_isotopes_fixed_and_terminal():
    def mass(text):
        return sorted(ms.Linked.of(parse(text)[0]).whole())

    plain = mass("AMK")[0]
    assert mass("<13C>AMK")[0] == pytest.approx(plain + 14 * 1.00335483507, abs=1e-5)
    assert mass("<[Oxidation]@M>AMK")[0] == pytest.approx(plain + modification_mass("Oxidation"), abs=1e-5)
    assert mass("<[Acetyl]@N-term:A>AMA")[0] == pytest.approx(mass("[Acetyl]-AMA")[0], abs=1e-5)
    assert mass("{+50}AMK")[0] == pytest.approx(plain + 50, abs=1e-5) and len(mass("ABZ")) == 3
    for bad in ("A/[Na:z+1]^0", "A[x]^", "A[+1]^99999999999", "A[unheard of]", "A[#g]", "[+1]^3?AA", "<77X>A", "K[#XL1]A", "K[+1#XL1]K[#XL1]K[#XL1]"):
        with pytest.raises(ProFormaError):
            ms.Linked.of(parse(bad)[0])


def test_modified_fragments(spark):
    df = spark.createDataFrame([(1, "AS[Phospho#g]T[#g]K"), (2, "A["), (3, None), (4, "GGA"), (5, "<13C>AA")], "id int, peptide string")
    model = fr.FragmentModel((fr.Series("b"), fr.Series("y", losses=("", "-H3PO4"))), (1, 2), precursor=True)
    rows = fr.modified_fragments(df, model, ["id"], losses={"-H3PO4": 97.976896}).collect()
    phospho = modification_mass("Phospho")
    got = {(x.ion, x["index"], x.inside, x.loss): x.mz for x in rows if x.id == 1 and x.charge == 1}
    b1, b2 = ch.MONO["A"] + ch.PROTON, ch.MONO["A"] + ch.MONO["S"] + ch.PROTON
    assert got["b", 1, "", ""] == pytest.approx(b1, abs=1e-5) and got["b", 2, "", ""] == pytest.approx(b2, abs=1e-5) and got["b", 2, "#g", ""] == pytest.approx(b2 + phospho, abs=1e-5)
    assert ("b", 1, "#g", "") not in got and ("b", 3, "", "") not in got and got["y", 2, "#g", "-H3PO4"] == pytest.approx(got["y", 2, "#g", ""] - 97.976896, abs=1e-6)
    plain = {(x.ion, x["index"], x.charge): round(x.mz, 5) for x in fr.fragments(df.where("id = 4"), model.__class__((fr.Series("b"), fr.Series("y")), (1, 2)), ["id"]).collect()}
    assert plain == {(x.ion, x["index"], x.charge): round(x.mz, 5) for x in rows if x.id == 4 and x.ion != "precursor" and not x.loss}
    assert sorted((x.id, x.ion) for x in rows if x.error) == [(2, None), (3, None), (5, None)]
    assert [x.masses for x in df.select(ms.ion_masses("peptide").alias("m")).select("m.*").collect()][1:3] == [None, None]
