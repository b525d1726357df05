from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from massloom.functions import chemistry as ch
from massloom.functions.tolerance import Tolerance
from massloom.operators import alignment as al
from massloom.operators import digest as dg
from massloom.operators import fragments as fr
from massloom.operators import joins, ranking, spectra


@pytest.mark.parametrize("tol", [Tolerance(0.01), Tolerance.absolute(0.3)])
def test_band_join_is_the_cross_product_with_the_condition(spark, tol):
    r = random.Random(1)
    a = [(i, r.choice([0.0, -5.0, r.uniform(-20, 20), r.uniform(0.001, 0.1)])) for i in range(150)]
    b = [(i, x * r.uniform(0.985, 1.015)) for i, (_, x) in enumerate(a)] + [(200, 0.0)]
    got = joins.band_join(spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double"), ("x", "y"), tol)
    want = {(i, j) for i, x in a for j, y in b if abs(x - y) <= (tol.value * abs(x) if tol.relative else tol.value)}
    rows = [(r_["i"], r_["j"]) for r_ in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    left = joins.band_join(spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double"), ("x", "y"), tol, how="left")
    assert {r_["i"] for r_ in left.collect()} == set(range(150))


def test_nearest_and_empty(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 99.0)], "i int, x double")
    b = spark.createDataFrame([(1, 10.2), (2, 9.9), (3, 10.1)], "j int, y double")
    got = joins.nearest_join(a, b, ("x", "y"), Tolerance.absolute(0.5), ["i"], [F.col("y"), F.col("j")])
    assert [(r["i"], r["j"]) for r in got.collect()] == [(1, 2)]
    assert joins.band_join(a, b.limit(0), ("x", "y"), Tolerance(0.1)).count() == 0


def test_lookup_and_fuzzy(spark):
    terms = spark.createDataFrame([("M:1", "Oxidation"), ("M:2", "Phospho")], "id string, name string")
    also = spark.createDataFrame([("M:2", "Phosphorylation")], "id string, synonym string")
    asked = spark.createDataFrame([("M:1",), ("OXIDATION",), ("phosphorylation",), ("none",)], "query string")
    got = {r["query"]: (r["id"], r["matched"]) for r in joins.lookup(asked, terms, also).collect()}
    assert got == {"M:1": ("M:1", "id"), "OXIDATION": ("M:1", "name"), "phosphorylation": ("M:2", "synonym"), "none": (None, None)}
    near = joins.fuzzy_join(spark.createDataFrame([("oxidated",), ("phospho",)], "query string"), terms.select("name"))
    assert {(r["query"], r["name"], r["distance"]) for r in near.collect()} == {("oxidated", "oxidation", 3), ("phospho", "phospho", 0)}


def test_digest(spark):
    p = dg.PROTEASES["trypsin_not_before_proline"]
    df = spark.createDataFrame([(1, "AKRPGKR"), (2, ""), (3, "KKK")], "id int, sequence string")
    assert df.select(dg.cut_sites(F.col("sequence"), p)).first()[0] == [2, 6]
    got = {(r["id"], r["peptide"]) for r in dg.digest(df, p, 1, (4, 40)).collect()}
    assert got == {(1, "AKRPGK"), (1, "RPGK"), (1, "RPGKR")}
    whole = dg.digest(df, p, 0, (1, 99)).where("id = 1").orderBy("first_piece").collect()
    assert "".join(r["peptide"] for r in whole) == "AKRPGKR"
    asp = df.select(dg.pieces(F.lit("DADK"), dg.PROTEASES["aspn"])).first()[0]
    assert asp == ["DA", "DK"]


def test_fragments(spark):
    df = spark.createDataFrame([("AAA",)], "peptide string")
    model = fr.FragmentModel(tuple(fr.Series(i) for i in "abcxyz"))
    got = {(r["ion"], r["index"]): r["mz"] for r in fr.fragments(df, model, ["peptide"]).collect()}
    a = ch.MONO["A"]
    assert got["b", 1] == pytest.approx(a + ch.PROTON) and got["b", 2] == pytest.approx(2 * a + ch.PROTON)
    assert got["y", 1] == pytest.approx(a + ch.WATER + ch.PROTON)
    assert got["a", 2] == pytest.approx(got["b", 2] - 27.9949146, abs=1e-6) and got["c", 1] == pytest.approx(got["b", 1] + 17.0265491, abs=1e-6)
    assert got["y", 2] - got["z", 2] == pytest.approx(17.0265491, abs=1e-6)
    assert len(got) == 12
    every = fr.fragments(df, fr.MODELS["all"], ["peptide"])
    assert {r["ion"] for r in every.select("ion").distinct().collect()} == {*"abcxyz", "precursor", "immonium"}


def test_fragment_models(spark):
    both = fr.combined(fr.MODELS["etd"], fr.MODELS["cid"])
    assert {s.ion for s in both.series} == {*"abcyz"} and both.internal == (2, 200) and len([s for s in both.series if s.ion == "y"]) == 1
    assert fr.combined(fr.MODELS["none"], fr.MODELS["ead"]).series == fr.MODELS["ead"].series
    df = spark.createDataFrame([("PEPTIDE",)], "peptide string")
    assert fr.fragments(df, fr.MODELS["none"], ["peptide"]).count() == 0
    got = {(r["ion"], r["loss"], r["variant"]) for r in fr.fragments(df, fr.MODELS["etcid"], ["peptide"]).collect()}
    assert {("z", "", 1), ("c", "-H2O", 0), ("a", "", 0), ("internal", "", 0)} <= got and not any(ion == "x" for ion, *_ in got)


def test_annotation_and_scores(spark):
    ions = spark.createDataFrame([(1, "b1", "b", 1, 100.0), (1, "b2", "b", 2, 200.0), (1, "y1", "y", 2, 100.001)], "spectrum_id int, fragment_id string, ion string, position int, mz double")
    peaks = spark.createDataFrame([(1, 0, 100.0005, 5.0), (1, 1, 150.0, 7.0), (2, 0, 50.0, 1.0)], "spectrum_id int, peak_idx int, mz double, intensity double")
    met = spectra.annotate(ions, peaks, Tolerance.absolute(0.01))
    assert {(r["fragment_id"], r["peak_idx"]) for r in met.collect()} == {("b1", 0), ("y1", 0)}
    got = {r["spectrum_id"]: r for r in spectra.scores(ions, peaks, met).collect()}
    assert (got[1]["fragments_found"], got[1]["n_fragments"], got[1]["peaks_found"], got[1]["intensity_found"]) == (2, 3, 1, 5.0)
    assert got[2]["n_fragments"] == 0
    fdr = {r["spectrum_id"]: r for r in spectra.shift_fdr(ions, peaks, Tolerance.absolute(0.01)).collect()}
    assert fdr[1]["actual"] == 0.5 and fdr[2]["fdr"] is None


def test_ranking(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (1, "c", 1.0), (2, "d", 2.0)], "g int, k string, s double")
    best = {(r["k"], r["unique"]) for r in ranking.best_with_ties(df, ["g"], "s").collect()}
    assert best == {("a", False), ("b", False), ("d", True)}
    kinds = spark.createDataFrame([(1, False), (1, True), (2, True), (3, None)], "p int, decoy boolean")
    assert {r["p"]: r["class"] for r in ranking.target_or_decoy(kinds, ["p"]).collect()} == {1: "Target", 2: "Decoy", 3: "Unknown"}


HEAVY_TAIL = "VTVSSASTKGPSVFPLAPSSKSTSGGTAALGCLVKDYFPEPVTVSWNSGALTSGVHTFPAVLQSSGLYSLSSVVTVPSSSLGTQTYICNVNHKPSNTKVDK{}VEPKSCDKTHTCPPCPAPELLGGPSVFLFPPKPKDTLMISRTPEVTCVVVDVSHEDPEVKFNWYVDGVEVHNAKTKPREEQYNSTYRVVSVLTVLHQDWLNGKEYKCKVSNKALPAPIEKTISKAKGQPREPQVYTLPPSREEMTKNQVSLTCLVKGFYPSDIAVEWESNGQPENNYKTTPPVLDSDGSFFLYSKLTVDKSRWQQGNVFSCSVMHEALHNHYTQKSLSLSPG"
HEAVY_A = "EPELVESGGGLAQPGTSLRLSCEASGFTFDDYAMHWVRQAPGRALEWVSGISWSSDNLAYSDSVEGRFTISRDNAKNSLYLQMNSLRLDDTAFYYCAKDVRPYYDFWAFDSWGRGTP" + HEAVY_TAIL.format("R")
HEAVY_B = "EVQLVESGGGLVQPGGSLRLSCAASGFNIKDTYIHWVRQAPGKGLEWVARIYPTNGYTRYADSVKGRFTISADTSKNTAYLQMNSLRAEDTAVYYCSRWGGDGFYAMDYWGQGTL" + HEAVY_TAIL.format("K")


@pytest.mark.parametrize(
    "a, b, kind, path",
    [
        ("ANA", "AGGA", "global", "1=1:2i1="),
        ("ANGARS", "AGGQRS", "global", "1=1:2i2:1i2="),
        ("AAK", "AAKGGG", "global_a", "3=3I"),  # to the right, reaching the end of a is reaching both
        ("AAK", "AAKGGG", "either_global", "3="),
        ("AEDTAVYYC[Carboxymethyl]SRWGGDGFYA", "AEDTAVYYM[oxidation]QSW[oxidation]SRW", "global_b", "8=1X3I3="),
        ("HJKASFHLKJFHAS", "JHSLAFKJHFLKSFJ", "global_a", "2r3X1=3i2i3X1I"),
        ("AAASSS", "ASSS", "global_a", "1=2D3="),
        ("HHHHHHAA", "AAHHHHHHH", "either_global", "6="),
        (HEAVY_A, "DLQLVESGGGLVQPGGSLRLSC[carboxymethyl]AASGF", "either_global", "3X8=1X3=1X5=2X4="),
        (HEAVY_A, "TSGVHTAPFVLQSSGLY", "either_global", "6=3r8="),
        (HEAVY_B, "SGFGGLKN[deamidated]TYLHW", "either_global", "3=1:2i1i1=1i2=1i2="),
        (HEAVY_B, "DTLM[oxidation]LSRTPEVTC[carbamidomethyl]VVVN[deamidated]VSHEN[deamidated]PEVK", "either_global", "3=1X1i7=1X3=1i4=1i4="),
        ("ADA", "AN[deamidated]A", "local", "1=1i1="),
        ("IVQEVS", "LEVQVES", "global", "1i1I2=2r1="),
        ("AGGHT", "ANTH", "global", "1=2:1i2r"),
        ("AGGHTK", "ANTHK", "global", "1=2:1i2r1="),
        ("[gln->pyro-glu]-QADFS-[Methyl]", "[glu->pyro-glu]-EADFT", "global", "1i3=1i"),
    ],
)
def test_alignments(a, b, kind, path):
    found = al.align(a, b, kind)
    assert found.cigar == path
    assert al.read_cigar(path) == [s[:3] for s in found.path]


def test_alignment_scores_and_letters(spark):
    assert al.align("ANNA", "AGGGGA", "local", al.Scoring(mismatch=12)).cigar == "4X"
    assert al.align("ABZJA", "ADQLA").cigar == "1=1i1i1i1=" and al.align("AXA", "AWA").cigar == "1=1X1="
    assert al.align("AC[Carbamidomethyl]A", "ACA", scoring=al.Scoring(pair="peptide_to_database", mass_mismatch=-1)).path[1] == ("m", 1, 1, 8)
    assert al.align("", "AA").cigar == "2I" and al.align("", "").cigar == ""
    rows = [("ANA", "AGGA"), (None, "A"), ("A1", "A"), ("A[unheard of]", "A"), ("A+G", "A"), ("B", "Z")]
    got = al.align_pairs(spark.createDataFrame(rows, "a string, b string"), kind="global").collect()
    assert [r["cigar"] for r in got] == ["1=1:2i1=", None, None, None, None, "1X"] and [r["error"] is None for r in got] == [True, False, False, False, False, True]
    for bad in ("3", "2:1r", "x="):
        with pytest.raises(ValueError):
            al.read_cigar(bad)


def test_alignment_frames(spark):
    names = ["ANGARS", "AGGQRS", "WWWWW"]
    df = spark.createDataFrame([(n, n) for n in names], "query_id string, query string")
    out = al.align_to_templates(df, df.toDF("template_id", "template"), "global")
    own = [r for r in out.collect() if r["query_id"] == r["template_id"]]
    assert len(own) == 3 and all(r["normalised"] == 1.0 for r in own)


def test_satellites_losses_and_linkers(spark):
    df = spark.createDataFrame([("GLI",)], "peptide string")
    got = {(r["ion"], r["index"], r["loss"]): r["mz"] for r in fr.satellite_fragments(df, ["peptide"]).collect()}
    ladder = {(r["ion"], r["index"]): r["mz"] for r in fr.fragments(df, fr.FragmentModel((fr.Series("a"), fr.Series("z"))), ["peptide"]).collect()}
    h = ch.ELEMENTS["H"]
    assert set(got) == {("d", 2, 0), ("w", 2, 0), ("w", 1, 0), ("w", 1, 1)}
    assert got["d", 2, 0] == pytest.approx(ladder["a", 2] + h - 43.0547752, abs=1e-5) and got["w", 1, 0] == pytest.approx(ladder["z", 1] + h - 15.0234751, abs=1e-5)
    b = fr.fragments(df, fr.FragmentModel((fr.Series("b"),)), ["peptide"])
    more = fr.with_losses(b, {"-X": 50.0, "-Y": 1e6})
    assert {(r["index"], r["loss"]) for r in more.collect()} == {(1, ""), (2, ""), (1, "-X"), (2, "-X")}
    halves = fr.cleaved_linkers(spark.createDataFrame([(100.0, 200.0)], "mass_a double, mass_b double"), [(54.0, 86.0)])
    assert {(r["neutral_a"], r["neutral_b"]) for r in halves.collect()} == {(154.0, 286.0), (186.0, 254.0)}


@pytest.mark.parametrize("tol", [Tolerance.ppm(2000), Tolerance.absolute(0.3), Tolerance.absolute(0.0)])
def test_left_band_join_keeps_each_row(spark, tol):
    """Repeated rows and nulls among them; against all pairs."""
    import random

    r = random.Random(3)
    left = [(k % 40, r.choice([None, round(r.uniform(-50, 900), 1)])) for k in range(90)] + [(7, 100.0), (7, 100.0)]
    right = [(k, r.choice([None, round(r.uniform(-50, 900), 1)])) for k in range(90)] + [(99, 100.0)]
    a, b = spark.createDataFrame(left, "k int, x double"), spark.createDataFrame(right, "m int, y double")
    near = lambda x, y: abs(x - y) <= (tol.value * abs(x) if tol.relative else tol.value)
    want = []
    for k, x in left:
        hits = [(m, y) for m, y in right if x is not None and y is not None and near(x, y)]
        want += [(k, x, m, y) for m, y in hits or [(None, None)]]
    got = joins.band_join(a, b, ("x", "y"), tol, how="left").select("k", "x", "m", "y").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    inner = joins.band_join(a, b, ("x", "y"), tol).select("k", "x", "m", "y").collect()
    assert sorted(map(repr, map(tuple, inner))) == sorted(repr(w) for w in want if w[2] is not None)


def test_terminal_modifications_are_found_at_the_ends(spark):
    from massloom.operators import modifications as md

    rule = "array<struct<residues:array<string>,position:string>>"
    table = spark.createDataFrame(
        [("Acetyl", 42.0106, [([], "any_n_term"), (["K"], "anywhere")]), ("Trimethyl", 42.047, [(["K"], "anywhere")]), ("Amidated", -0.984, [([], "any_c_term")]), ("Label", 100.0, [])], f"name string, delta double, rules {rule}"
    )
    rows = [(1, "A", 42.01, 0, 5), (2, "A", 42.01, 2, 5), (3, "K", 42.01, 2, 5), (4, "G", -0.98, 4, 5), (5, "G", -0.98, 0, 5), (6, "G", -0.98, 0, 1), (7, "W", 100.0, 1, 5), (8, "K", 500.0, 1, 5)]
    shifts = spark.createDataFrame(rows, "id int, residue string, delta_mass double, at int, n int")
    got = {x.id: x.name for x in md.replace_mass_shifts(shifts, table, Tolerance.absolute(0.05), index="at", length="n").collect()}
    assert got == {1: "Acetyl", 2: None, 3: "Acetyl", 4: "Amidated", 5: None, 6: "Amidated", 7: "Label", 8: None}
    only = {x.id: x.name for x in md.replace_mass_shifts(shifts, table, Tolerance.absolute(0.05), closest=False, index="at", length="n").collect()}
    assert only[3] is None and only[1] == "Acetyl"  # two fit on K
