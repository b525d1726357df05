from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from massloom.functions import modifications, proforma
from massloom.sources import delimited, mztab, psm, sequences, spectra, vocabulary
from massloom.streaming import parsing


def test_fields():
    assert delimited.fields('a,"b,c",d', ",") == ["a", "b,c", "d"]
    assert delimited.fields("x\t'y''z'\t", "\t") == ["x", "y''z", ""]
    for bad in ("", "  ", 'a,"b'):
        with pytest.raises(ValueError):
            delimited.fields(bad, ",")


def test_delimited(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿sep=;\nA;B\n1;'x;y'\n2\n3;-\n")
    rows = delimited.read_delimited(spark, str(p)).collect()
    assert [r["values"] for r in rows] == [{"a": "1", "b": "x;y"}, None, {"a": "3", "b": "-"}] and rows[1]["error"]
    out = delimited.read_delimited(spark, str(p)).where("error is null").select(delimited.number_column("values", "a").alias("a"), delimited.text_column("values", "B").alias("b"))
    assert [tuple(r) for r in out.collect()] == [(1.0, "x;y"), (3.0, None)]
    delimited.write_delimited([out, out.select((F.col("a") + 1).alias("a"), F.lit('q"').alias("c"))], str(tmp_path / "out"), ";", one_file=True)
    text = next((tmp_path / "out").glob("part*")).read_text().splitlines()
    assert text[0] == "a;b;c" and '1.0;"x;y";' in text and '2.0;;q"' in text


def test_psm_formats(spark, tmp_path):
    p = tmp_path / "a.ssl"
    p.write_text("file\tscan\tcharge\tsequence\tscore\nr.raw\t5\t2\tPEPK\t0.5\nr.raw\t6\tx\tPEPK\t-7\n")
    a, b = psm.read_psms(spark, str(p)).collect()
    assert (a["scan"], a["charge"], a["confidence"], a["format"], a["error"]) == ("5", 2, 0.5, "ssl", None)
    assert b["confidence"] == -1.0 and b["error"] == "no charge"
    q = tmp_path / "b.csv"
    q.write_text("Scan_index,sequence,raw_file,z,more\n3,AK/2,f,2,m\n")
    one = psm.read_psms(spark, str(q)).first()
    assert one["format"] == "basic_csv" and one["extras"] == {"more": "m"} and one["confidence"] is None
    both = psm.union_formats([psm.read_psms(spark, str(p)), psm.read_psms(spark, str(q))])
    assert both.count() == 3
    with pytest.raises(ValueError):
        psm.detect(["x"], psm.BY_EXTENSION["tsv"])
    assert len(psm.FORMATS) == 20
    (tmp_path / "in").mkdir()
    stream = parsing.stream_psms(spark, str(tmp_path / "in"), "ssl", "1", ["file", "scan", "charge", "sequence", "score"])
    (tmp_path / "in" / "a.ssl").write_text(p.read_text())
    w = stream.writeStream.format("memory").queryName("psm_stream").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("psm_stream").count() == 2


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text(">sp|P1|N_HUMAN Some name OS=Homo sapiens OX=9606\nMKA\nLL\n>rev_tr|Q2|D x\nAA1\n>plain\nGG*\n>rev_other y REGIONS=V:1;J:2\nGGG\n")
    a, b, c, d = sequences.read_fasta(spark, str(p)).collect()
    assert (a["id_kind"], a["accession"], a["name"], a["decoy"], a["description"], a["sequence"]) == ("swissprot", "P1", "N_HUMAN", False, "Some name", "MKALL")
    assert a["tags"] == {"OS": "Homo sapiens", "OX": "9606"} and b["decoy"] and b["error"] == "no amino acid"
    assert c["sequence"] == "GG" and d["accession"] == "other" and d["decoy"] and [r["region"] for r in d["regions"]] == ["V", "J"] and d["error"] is None


def test_mgf_and_library(spark, tmp_path):
    p = tmp_path / "x.mgf"
    p.write_text("# head\nBEGIN IONS\nTITLE=a=b\nPEPMASS=400.5 10\nCHARGE=2+\nSCANS=7\n100.1 5\n200 6\nEND IONS\n\nBEGIN IONS\nTITLE=n\nEND IONS\n")
    a, b = spectra.read_mgf(spark, str(p)).collect()
    assert (a["title"], a["scan"], a["charge"], a["precursor_mz"], len(a["peaks"])) == ("a=b", 7, 2, 400.5, 2) and b["peaks"] == []
    lib = tmp_path / "x.mzSpecLib.txt"
    lib.write_text("<mzSpecLib>\nMS:1003186|library format version=1.0\n<AttributeSet Spectrum=all>\nMS:1|a=b\n<Spectrum=1>\nMS:1003061|library spectrum name=N\n<Analyte=1>\nMS:2|c=d\n<Peaks>\n100.5\t3\tb2-H2O^2/0.1ppm*0.5,?\n\n<Spectrum=2>\nnonsense\n<Peaks>\n1\t2\n")
    x, y = spectra.read_speclib(spark, str(lib)).orderBy("key").collect()
    assert x["name"] == "N" and x["error"] is None and len(x["attributes"]) == 3 and y["error"].startswith("no attribute") and len(y["peaks"]) == 1
    text = spectra.library_lines(spectra.read_speclib(spark, str(lib)).where("key = 1")).first()["value"]
    again = spectra.parse_library_entry(text)
    assert again["key"] == 1 and again["name"] == "N" and again["peaks"][0]["annotations"] == "b2-H2O^2/0.1ppm*0.5,?"


@pytest.mark.parametrize("text", ["b2-H2O^2/0.1ppm*0.5", "&1@y12/-0.002", "?", "p^3", "IA/1ppm", "m3:6", "y4+i[M+H]", "f{C6H12O6}"])
def test_annotations_round_trip(text):
    (a,) = spectra.parse_annotations(text)
    assert spectra.render_annotation(a) == text


def test_annotations(spark):
    with pytest.raises(ValueError):
        spectra.parse_annotations("b2,zz")
    got = spark.createDataFrame([("b2,y3^2",), ("q!",), (None,)], "t string").select(spectra.annotations("t").alias("a")).collect()
    assert [x["index"] for x in got[0]["a"]] == [2, 3] and got[1]["a"] is None and got[2]["a"] is None


def test_mztab(spark, tmp_path):
    prh, psh = mztab.REQUIRED["PRH"], mztab.REQUIRED["PSH"]
    prot = spark.createDataFrame([("P1", "d"), ("P1", "d")], "accession string, description string")
    rows = spark.createDataFrame([("PEPK", "1", "P1", "2", "f.raw", "scan=3"), ("AAK", "2", "P1", "3", "e.raw", "scan=4")], "sequence string, psm_id string, accession string, charge string, spectra_file string, spectra_id string")
    mztab.write_mztab([("description", "t")], prot, rows, str(tmp_path / "m"))
    meta, proteins, psms = mztab.read_mztab(spark, str(tmp_path / "m"))
    assert proteins.count() == 1 and {(r["sequence"], r["charge"], r["spectra_ref"]) for r in psms.collect()} == {("PEPK", 2, "ms_run[2]:scan=3"), ("AAK", 3, "ms_run[1]:scan=4")}
    assert ("ms_run[1]-location", "e.raw") in {tuple(r) for r in meta.collect()}
    bad = tmp_path / "bad.mztab"
    bad.write_text("PRH\t" + "\t".join(prh) + "\nPSH\t" + "\t".join(psh[1:]) + "\n")
    with pytest.raises(ValueError):
        mztab.read_mztab(spark, str(bad))


def test_obo(spark, tmp_path):
    p = tmp_path / "x.obo"
    p.write_text('format-version: 1.2\n\n[Term]\nid: MS:1\nname: one ! c\nsynonym: "uno" EXACT []\nis_a: MS:0 ! root\nproperty_value: mass "1.5" xsd:double\n\n[Term]\nid: MS:2\nname: two\nis_obsolete: true\n\n[Typedef]\nid: part_of\n')
    a, b, c = vocabulary.read_obo(spark, str(p)).collect()
    assert (a["id"], a["name"], a["synonyms"], a["parents"], a["obsolete"]) == ("MS:1", "one", ["uno"], ["MS:0"], False) and b["obsolete"] and c["stanza"] == "Typedef"
    assert [tuple(r) for r in vocabulary.property_values(vocabulary.read_obo(spark, str(p))).collect()] == [("MS:1", "mass", "1.5", "xsd:double")]
    table, errors = vocabulary.load_cached(spark, str(tmp_path / "cache"), [lambda: 1 / 0, lambda: vocabulary.read_obo(spark, str(p))])
    assert table.count() == 3 and len(errors) == 2
    assert vocabulary.gene_name("IGHV3-23*01") == ("H", "V", "3-23", 1)


@pytest.mark.parametrize("text", ["EM[Oxidation]EVEES[U:21]PEK/2", "[Acetyl]-AC[+57.02]D-[Amidated]", "<[Carbamidomethyl]@C>ATPEC/3+AAA/2", "(?DQ)NGK", "{Glycan:Hex}EMK", "PEPTK[X:DSS#XL1]ID//AK[#XL1]A/4", "(AAK)[+10]G", "<13C>AK/[Na:z+1]", "[Phospho]?SS", "(>n)AK"])
def test_proforma_round_trip(text):
    assert proforma.render(proforma.parse(text)) == text


@pytest.mark.parametrize("text", ["", "AA-", "A[", "((A)[+1])[+2]", "A1", "[x]", "A/", "(AA)", "AK//", "A+"])
def test_proforma_errors(text):
    with pytest.raises(ValueError):
        proforma.parse(text)


def test_proforma_column(spark):
    got = spark.createDataFrame([("AK/2",), ("A(",), (None,)], "t string").select(proforma.parse_proforma("t").alias("p")).select("p.*").collect()
    assert got[0]["ions"][0]["chains"][0]["sequence"] == "AK" and got[0]["complexity"] == "unambiguous" and got[1]["error"] and got[2]["error"]
    assert proforma.sloppy("K.PEPM(Oxidation)TIDE.R") == "PEPM[Oxidation]TIDE" and proforma.sloppy("_AC+57.02D_") == "AC[+57.02]D"
    assert modifications.modification_mass("Oxidation") == pytest.approx(15.9949146) and modifications.modification_mass("nothing") is None
    assert modifications.modification_mass("Formula:H2O") == pytest.approx(18.0105647) and len(modifications.sub_compositions({"Hex": 2, "HexNAc": 1})) == 5


def test_germlines(spark, tmp_path):
    from massloom.operators.ranking import select_germlines
    from massloom.sources import germlines

    p = tmp_path / "x.dat"
    feature = 'FT   V-REGION        1..9\nFT                   /IMGT_allele="IGHV1-2*01"\nFT                   /codon_start=1\n'
    p.write_text("ID   A1\nAC   A1;\nOS   Homo sapiens\n" + feature + 'FT   V-REGION        complement(1..6)\nFT                   /IMGT_allele="IGHV3*02"\nFT                   /pseudo\nFT   J-REGION        5..40\nFT                   /allele="IGHJ1*01"\nSQ   Sequence 12 BP;\n     atggcctaa ttt        12\n//\n')
    rows = germlines.read_germlines(spark, str(p)).collect()
    assert [(r["sequence"], r["functional"], r["error"] is None) for r in rows] == [("MA*", True, True), ("GH", False, True), ("PN", True, False)]
    table = germlines.germline_table(germlines.read_germlines(spark, str(p)))
    assert [tuple(r) for r in table.collect()] == [("Homo sapiens", "H", "V", "1-2", 1, "MA*", "A1")]
    assert select_germlines(table, ["Homo sapiens"], ["H"], ["V"], "first").count() == 1 and select_germlines(table, genes=["J"]).count() == 0


def test_chains():
    (ion,) = proforma.parse("[Acetyl]-AC[+1]DE(FG)[+2]-[Amidated]")
    c = ion.chains[0]
    assert proforma.render([proforma.Ion([proforma.part(c, 0, 2)])]) == "[Acetyl]-AC[+1]"
    assert proforma.render([proforma.Ion([proforma.part(c, 4, 6)])]) == "(FG)[+2]-[Amidated]"
    assert proforma.reverse(c).sequence == "GFEDCA" and proforma.reverse(proforma.reverse(c)) == c
    both = proforma.concatenate(proforma.part(c, 0, 3), proforma.part(c, 3, 6))
    assert both == c
    with pytest.raises(ValueError):
        proforma.concatenate(c, c)
    assert proforma.validate(proforma.parse("<[+1]@?>A[#XLa]A[#XLa]A[#XLa]")) and not proforma.validate(proforma.parse("AK"))
    assert proforma.validate(proforma.parse("AXK"), strict=True) and not proforma.validate(proforma.parse("AXK"))


def test_modification_operators(spark):
    from massloom.functions.tolerance import Tolerance
    from massloom.operators import modifications as md
    from massloom.operators import statistics as st

    table = md.modification_table(spark)
    shifts = spark.createDataFrame([("M", 15.995), ("K", 15.995), ("S", 79.966), ("S", 0.5)], "residue string, delta_mass double")
    got = {(r["residue"], r["delta_mass"]): r["name"] for r in md.replace_mass_shifts(shifts, table, Tolerance.absolute(0.01)).collect()}
    assert got == {("M", 15.995): "Oxidation", ("K", 15.995): None, ("S", 79.966): "Phospho", ("S", 0.5): None}
    assert md.find_by_formula(spark.createDataFrame([("O",)], "formula string"), table).first()["mod_name"] == "Oxidation"
    rules = "array<struct<position:string,residues:array<string>>>"
    df = spark.createDataFrame([([("anywhere", ["K"]), ("any_n_term", [])], [("anywhere", ["K", "R"])], "A", 0), ([("any_n_term", ["Q"]), ("any_n_term", ["E"])], [("any_n_term", ["Q", "E"])], "E", 2)], f"r {rules}, w {rules}, aa string, i int")
    out = df.select(md.placed(F.col("r"), F.col("aa"), F.col("i"), F.lit(5)).alias("p"), md.rules_within(F.col("r"), F.col("w")).alias("s"), md.merge_rules(F.col("r")).alias("m")).collect()
    assert [r["p"] for r in out] == [True, False] and [r["s"] for r in out] == [True, True]
    assert out[1]["m"][0]["residues"] == ["E", "Q"]
    errors = spark.sql("SELECT 100.0D o, array(100.1D, 99.99D) m").select(st.mass_error(F.col("o"), F.col("m"), False).alias("e"), st.flanking(F.lit("ABCDE"), F.lit(1), F.lit(2)).alias("f")).first()
    assert errors["e"] == pytest.approx(0.01) and tuple(errors["f"]) == ("A", "D")
    labels = "k int, fragment_id int, labels array<struct<site:string,option:string>>"
    every = spark.createDataFrame([(1, 1, [("3", "N")]), (1, 2, [("3", "D")]), (1, 3, [("3", "D")])], labels)
    assert {(r["option"], r["found"], r["total"]) for r in st.ambiguity(every.where("fragment_id = 2"), every, ["k"]).collect()} == {("N", 0, 1), ("D", 1, 2)}
    psms = spark.createDataFrame([("AK", "1", "f", 2, 0.5, False, None), ("AK", "1", "f", 2, 0.5, None, "x")], "peptide string, scan string, raw_file string, charge int, confidence double, decoy boolean, error string")
    assert [r["class"] for r in st.convert(psms).collect()] == ["Target"]


def test_library_index(spark, tmp_path):
    from massloom.sources import spectra as sp

    n = 4000
    rows = [(k, f"spectrum {k}", [(100.0 + k, float(k % 9))]) for k in range(n)]
    library = spark.createDataFrame(rows, "key long, name string, peaks array<struct<mz:double,intensity:double>>").repartition(3)
    sp.write_library_index(library, f"{tmp_path}/index", row_group_mb=1)
    found = sp.library_entries(spark, f"{tmp_path}/index", keys=[5, n + 1], names=None)
    assert [x.name for x in found.collect()] == ["spectrum 5"] and sp.library_entries(spark, f"{tmp_path}/index", names=["spectrum 7", "none"]).first().key == 7
    assert sp.library_entries(spark, f"{tmp_path}/index", between=(10, 12)).count() == 3 and sp.library_entries(spark, f"{tmp_path}/index", keys=[]).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key" in plan
    import glob

    import pyarrow.parquet as pq

    ranges = sorted((m.row_group(g).column(0).statistics.min, m.row_group(g).column(0).statistics.max) for m in (pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/index/*.parquet")) for g in range(m.num_row_groups))
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # a key is in one row group


def test_files_are_opened_by_name_or_first_line(spark, tmp_path):
    from massloom.sources.mzml import spectrum_text
    from massloom.sources.opening import kind_of, open_file

    texts = {
        "a.fasta": ">sp|P1|A protein\nAGK\n",
        "b.unknown": "\n>sp|P1|A protein\nAGK\n",
        "c.mgf": "BEGIN IONS\nTITLE=x\nPEPMASS=100\n100 1\nEND IONS\n",
        "d.txt": "BEGIN IONS\nTITLE=x\nPEPMASS=100\n100 1\nEND IONS\n",
        "e.mzML": "<mzML><run>" + spectrum_text({"id": "s"}, 0, False).replace('<referenceableParamGroupRef ref="mz"/>', "").replace('<referenceableParamGroupRef ref="intensity"/>', "") + "</run></mzML>",
        "f.obo": "format-version: 1.2\n\n[Term]\nid: A:1\nname: a\n",
        "g.csv": "raw_file,scan_index,sequence,z\nr.raw,1,PEPK,2\n",
        "h.mzspeclib": "<mzSpecLib>\n<Spectrum=1>\nMS:1003061|library spectrum name=x\n<Peaks>\n100.0\t1.0\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    kinds = {name: open_file(spark, str(tmp_path / name)) for name in texts}
    assert {n: k for n, (k, _) in kinds.items()} == {"a.fasta": "sequences", "b.unknown": "sequences", "c.mgf": "spectra_mgf", "d.txt": "spectra_mgf", "e.mzML": "spectra_mzml", "f.obo": "ontology", "g.csv": "identifications", "h.mzspeclib": "library"}
    assert all(df.count() == 1 for n, (_, df) in kinds.items() if n != "f.obo") and kinds["f.obo"][1].where("id = 'A:1'").count() == 1
    assert open_file(spark, str(tmp_path / "g.csv"), format="basic_csv")[1].first()["peptide"] == "PEPK"
    (tmp_path / "z.bin").write_text("nothing known")
    for call in (lambda: kind_of(spark, str(tmp_path / "z.bin")), lambda: open_file(spark, "x", kind="none"), lambda: open_file(spark, "x", format="none")):
        with pytest.raises(ValueError):
            call()


def test_libraries_are_written_with_heads_and_sets(spark, tmp_path):
    from massloom.sources import spectra as sp

    text = "<mzSpecLib>\nMS:1003186|library format version=1.0\n<AttributeSet Spectrum=all>\nMS:1000044|dissociation method=HCD\n" + "".join(f"<Spectrum={k}>\nMS:1003061|library spectrum name=s{k}\n<Peaks>\n{100 + k}.5\t1.0\ty1\n" for k in range(1, 6))
    (tmp_path / "in.txt").write_text(text)
    first = sp.read_speclib(spark, str(tmp_path / "in.txt"))
    sp.write_speclib(first.repartition(2), f"{tmp_path}/out", [("MS:1003186", "library format version", "1.0")], {"Spectrum": [("MS:1000044", "dissociation method", "HCD")]})
    again = sp.read_speclib(spark, f"{tmp_path}/out")
    rows = [sorted((x.key, x.name, x.error, [a.value for a in x.attributes], [(p.mz, p.annotations) for p in x.peaks]) for x in df.collect()) for df in (first, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 5 and rows[0][0][3] == ["HCD", "s1"]
