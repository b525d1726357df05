"""mzML: files written and read back, other layouts of the same, and what can't be read."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pytest

from massloom.sources.mzml import parse_spectrum, read_mzml, write_mzml

KIND = "id string, ms_level int, polarity int, rt_s double, precursor_mz double, charge int, isolation_low double, isolation_high double, activation array<string>, energy double, peaks array<struct<mz:double,intensity:double>>, other string"


def test_round_trip(spark, tmp_path):
    rows = [
        ('scan=1 "a" <b>', 1, 1, 12.5, None, None, None, None, None, None, [(100.25, 1.5), (200.125, 2.0)], "x"),
        ("scan=2", 2, -1, 0.1, 500.123456789, 2, 499.5, 500.5, ["HCD"], 30.0, [], "y"),
        ("scan=3", None, None, None, 1e-3, None, None, None, ["ETD", "CID"], None, None, None),
    ]
    for compress in (True, False):
        path = f"{tmp_path}/{compress}"
        write_mzml(spark.createDataFrame(rows, KIND).repartition(2), path, compress)
        got = {x.id: x for x in read_mzml(spark, path).collect()}
        assert set(got) == {r[0] for r in rows} and all(x.error is None for x in got.values())
        for r in rows:
            x = got[r[0]]
            assert (x.ms_level, x.polarity, x.rt_s, x.precursor_mz, x.charge, x.energy) == (r[1], r[2], r[3], r[4], r[5], r[9])
            assert [(p.mz, p.intensity) for p in x.peaks] == [tuple(p) for p in r[10] or []]
            assert (x.activation or []) == sorted(r[8] or []) and (x.isolation_low, x.isolation_high) == (r[6], r[7])


def _array(kind, values, compress, name, extra=""):
    raw = np.array(values, kind).tobytes()
    text = base64.b64encode(zlib.compress(raw) if compress else raw).decode()
    number = {"<f8": "MS:1000523", "<f4": "MS:1000521", "<i4": "MS:1000519"}[kind]
    way = "MS:1000574" if compress else "MS:1000576"
    return f'<binaryDataArray><cvParam accession="{number}"/><cvParam accession="{way}"/>{extra}<cvParam accession="{name}"/><binary>{text[:8]}\n {text[8:]}</binary></binaryDataArray>'


def _spectrum(arrays, head='index="7" id="s"', more=""):
    return f"<spectrum {head}>{more}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>"


def test_layouts():
    both = _array("<f4", [1.5, 2.5], True, "MS:1000514") + _array("<i4", [3, 4], False, "MS:1000515") + _array("<f8", [9.0], False, "MS:1000595")
    scan = '<scanList><scan><cvParam value="2" accession="MS:1000016" unitAccession="UO:0000031"/></scan></scanList>'
    x = parse_spectrum(_spectrum(both, more=scan + '<referenceableParamGroupRef ref="g"/>'), {"g": [["MS:1000511", "2", ""], ["MS:1000130", "", ""]]})
    assert x["error"] is None and [(p["mz"], p["intensity"]) for p in x["peaks"]] == [(1.5, 3.0), (2.5, 4.0)] and (x["index"], x["rt_s"], x["ms_level"], x["polarity"]) == (7, 120.0, 2, 1)
    target = '<precursorList><precursor><isolationWindow><cvParam accession="MS:1000827" value="400"/><cvParam accession="MS:1000828" value="1"/></isolationWindow></precursor></precursorList>'
    x = parse_spectrum(_spectrum("", more=target), {})
    assert (x["precursor_mz"], x["isolation_low"], x["isolation_high"], x["peaks"]) == (400.0, 399.0, 400.0, [])


@pytest.mark.parametrize(
    "text, says",
    [
        (_spectrum(_array("<f8", [1.0], False, "MS:1000514")), "1 m/z and 0 intensities"),
        (_spectrum("", head='index="0" id="s" defaultArrayLength="3"'), "3 peaks expected"),
        (_spectrum(_array("<f8", [1.0], False, "MS:1000514", '<cvParam accession="MS:1002312"/>')), "compressed by MS:1002312"),
        (_spectrum('<binaryDataArray><cvParam accession="MS:1000514"/><cvParam accession="MS:1000523"/><binary>!!</binary></binaryDataArray>'), ""),
        (_spectrum('<binaryDataArray><cvParam accession="MS:1000514"/><cvParam accession="MS:1000523"/><binary>AAAA</binary></binaryDataArray>'), "ends within a number"),
        (_spectrum('<binaryDataArray><cvParam accession="MS:1000514"/><binary>AAAA</binary></binaryDataArray>'), "unknown numbers"),
        ("<spectrum index='0'><unclosed></spectrum>", "mismatched"),
    ],
)
def test_bad_spectra(text, says):
    x = parse_spectrum(text, {})
    assert x["error"] and says in x["error"] and x["peaks"] is None


def test_foreign_files(spark, tmp_path):
    (tmp_path / "a.mzML").write_text("")
    (tmp_path / "b.mzML").write_text("no xml at all")
    (tmp_path / "c.mzML").write_text("<mzML><spectrumList>" + _spectrum("") + "<spectrum index='x'></spectrum></spectrumList></mzML>")
    got = read_mzml(spark, str(tmp_path)).collect()
    assert sorted((x.id or "-", x.error is None) for x in got) == [("-", False), ("s", True)]
