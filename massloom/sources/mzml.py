"""Raw spectra in mzML: XML that is cut at its spectra, each parsed and its arrays decoded by itself, and the same files written.

A file is read as text that ends at each </spectrum>, so a large file is many tasks' work and no task holds more than a spectrum at a time. Parameters that spectra take over
from groups of the file's head are joined to them by file.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accessions of kinds of arrays, of numbers and of ways of fragmentation.
ARRAYS = {"MS:1000514": "mz", "MS:1000515": "intensity"}
NUMBERS = {"MS:1000523": "<f8", "MS:1000521": "<f4", "MS:1000522": "<i8", "MS:1000519": "<i4"}
ACTIVATION = {"MS:1000133": "CID", "MS:1000422": "HCD", "MS:1000598": "ETD", "MS:1000250": "ECD", "MS:1000435": "PD", "MS:1003246": "UVPD", "MS:1000134": "PD-decay", "MS:1002481": "HCD"}
_NUMPRESS = ("MS:1002312", "MS:1002313", "MS:1002314", "MS:1002746", "MS:1002747", "MS:1002748")
PLAIN, ZLIB, SECONDS = "MS:1000576", "MS:1000574", "UO:0000010"

SPECTRUM = (
    "file string, id string, index long, ms_level int, polarity int, rt_s double, precursor_mz double, charge int, isolation_low double, isolation_high double, activation array<string>, energy double, "
    "peaks array<struct<mz:double,intensity:double>>, error string"
)
_NAMES = ["file", "id", "index", "ms_level", "polarity", "rt_s", "precursor_mz", "charge", "isolation_low", "isolation_high", "activation", "energy", "peaks", "error"]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.float64(), pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())])), pa.string()]


def _params(node: ElementTree.Element, groups: dict[str, list]) -> list[tuple[str, str, str]]:
    """accession, value and unit of a node's own parameters and of the groups that it names."""
    out: list[tuple[str, str, str]] = []
    for c in node:
        if c.tag == "cvParam":
            out.append((c.get("accession", ""), c.get("value", ""), c.get("unitAccession", "")))
        elif c.tag == "referenceableParamGroupRef":
            out += [tuple(p) for p in groups.get(c.get("ref", ""), [])]
    return out


def decode_array(text: str, params: list[tuple[str, str, str]]) -> np.ndarray:
    """Numbers of a binary array by its parameters."""
    own = [p[0] for p in params]
    kind = next((NUMBERS[a] for a in own if a in NUMBERS), None)
    if kind is None:
        raise ValueError("an array of unknown numbers")
    if other := [a for a in own if a in _NUMPRESS]:
        raise ValueError(f"an array compressed by {other[0]}")
    raw = base64.b64decode("".join(text.split()), validate=True)
    raw = zlib.decompress(raw) if ZLIB in own else raw
    if len(raw) % np.dtype(kind).itemsize:
        raise ValueError("an array that ends within a number")
    return np.frombuffer(raw, kind).astype(np.float64)


def parse_spectrum(text: str, groups: dict[str, list], whole: bool = True) -> dict:
    """One <spectrum> element. What could be read stays beside an error. Peaks are dicts, or two arrays if not `whole`."""
    out: dict = dict.fromkeys(_NAMES)
    try:
        node = ElementTree.fromstring(text)
        out["id"], out["index"] = node.get("id"), int(node.get("index", "-1"))
        for a, v, _ in _params(node, groups):
            if a == "MS:1000511":
                out["ms_level"] = int(v)
            elif a in ("MS:1000129", "MS:1000130"):
                out["polarity"] = 1 if a.endswith("30") else -1
        for scan in node.iterfind("scanList/scan"):
            for a, v, unit in _params(scan, groups):
                if a == "MS:1000016" and out["rt_s"] is None:
                    out["rt_s"] = float(v) * (1 if unit == SECONDS else 60)
        for p in node.iterfind("precursorList/precursor"):
            found = {a: v for part in p.iter() for a, v, _ in _params(part, groups)}
            target = found.get("MS:1000827")
            out["precursor_mz"] = float(found.get("MS:1000744") or target) if found.get("MS:1000744") or target else None
            out["charge"] = int(found["MS:1000041"]) if "MS:1000041" in found else None
            if target:
                out["isolation_low"], out["isolation_high"] = float(target) - float(found.get("MS:1000828", 0)), float(target) + float(found.get("MS:1000829", 0))
            out["activation"] = sorted({ACTIVATION[a] for a in found if a in ACTIVATION})
            out["energy"] = float(found["MS:1000045"]) if "MS:1000045" in found else None
            break  # the first precursor is the spectrum's own
        arrays = {}
        for b in node.iterfind("binaryDataArrayList/binaryDataArray"):
            params = _params(b, groups)
            name = next((ARRAYS[p[0]] for p in params if p[0] in ARRAYS), None)
            if name:
                arrays[name] = decode_array(b.findtext("binary") or "", params)
        mz, intensity = arrays.get("mz", np.zeros(0)), arrays.get("intensity", np.zeros(0))
        if len(mz) != len(intensity):
            raise ValueError(f"{len(mz)} m/z and {len(intensity)} intensities")
        if (said := node.get("defaultArrayLength")) is not None and int(said) != len(mz):
            raise ValueError(f"{said} peaks expected, found {len(mz)}")
        out["peaks"] = (mz, intensity) if not whole else [{"mz": x, "intensity": y} for x, y in zip(mz.tolist(), intensity.tolist())]
    except (ElementTree.ParseError, ValueError, zlib.error) as e:
        out["error"] = str(e)
    return out


def _peaks(pairs: list[tuple[np.ndarray, np.ndarray] | None]) -> pa.Array:
    """Lists of peaks of pairs of arrays."""
    have = [p for p in pairs if p is not None]
    both = pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in have]) if have else np.zeros(0)) for k in (0, 1)], ["mz", "intensity"])
    ends = np.cumsum([0] + [0 if p is None else len(p[0]) for p in pairs])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.array([p is None for p in pairs] + [False])), both)


def _groups(blocks: DataFrame) -> DataFrame:
    """file, groups: parameters by group of the heads of files that have any, as JSON."""
    head = blocks.where(F.contains("value", F.lit("<referenceableParamGroup ")))

    @F.pandas_udf("string")
    def read(texts):
        import json

        def one(text: str) -> str:
            m = re.search(r"<referenceableParamGroupList.*?</referenceableParamGroupList>", text, re.S)
            found = {}
            try:
                for g in ElementTree.fromstring(m[0]) if m else ():
                    found[g.get("id", "")] = _params(g, {})
            except ElementTree.ParseError:
                pass
            return json.dumps(found)

        return texts.map(one)

    return head.groupBy("file").agg(F.min("value").alias("v")).select("file", read("v").alias("groups"))


def read_mzml(spark: SparkSession, path: str, most_files: int = 100_000) -> DataFrame:
    """One row a spectrum (columns of SPECTRUM). A spectrum that can't be read, or whose arrays can't, has `error` and what could be read.

    Times are in seconds. Arrays of 32 and 64 bits, plain or zlib, are decoded; other arrays than m/z and intensity are skipped. An empty or foreign file gives no rows.
    """
    blocks = spark.read.text(path, lineSep="</spectrum>").select("value", F.col("_metadata.file_path").alias("file"))
    groups = _groups(blocks)
    if groups.limit(most_files + 1).count() <= most_files:  # a row for each file that has groups
        groups = F.broadcast(groups)
    own = blocks.where(F.rlike("value", F.lit(r"<spectrum[\s>]"))).join(groups, "file", "left")
    own = own.select("file", "groups", F.concat(F.regexp_extract("value", r"(?s)(<spectrum[\s>].*)$", 1), F.lit("</spectrum>")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        known: dict[str | None, dict] = {None: {}}
        for b in batches:
            rows = []
            for file, groups_, text in zip(*(b.column(c).to_pylist() for c in ("file", "groups", "text"))):
                if groups_ not in known:
                    known = {None: {}, groups_: json.loads(groups_)}
                rows.append(parse_spectrum(text, known[groups_], False) | {"file": file})
            yield pa.RecordBatch.from_arrays([_peaks([r[n] for r in rows]) if n == "peaks" else pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, _KINDS)], _NAMES)

    return own.mapInArrow(run, SPECTRUM)


_HEAD = """<?xml version="1.0" encoding="utf-8"?>
<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0">
<cvList count="2"><cv id="MS" fullName="Mass spectrometry ontology" URI="psi-ms.obo"/><cv id="UO" fullName="Unit ontology" URI="unit.obo"/></cvList>
<referenceableParamGroupList count="2">
<referenceableParamGroup id="mz"><cvParam cvRef="MS" accession="MS:1000514" name="m/z array" value=""/><cvParam cvRef="MS" accession="MS:1000523" name="64-bit float" value=""/>{way}</referenceableParamGroup>
<referenceableParamGroup id="intensity"><cvParam cvRef="MS" accession="MS:1000515" name="intensity array" value=""/><cvParam cvRef="MS" accession="MS:1000523" name="64-bit float" value=""/>{way}</referenceableParamGroup>
</referenceableParamGroupList>
<run id="run"><spectrumList>"""
_WAYS = {True: f'<cvParam cvRef="MS" accession="{ZLIB}" name="zlib compression" value=""/>', False: f'<cvParam cvRef="MS" accession="{PLAIN}" name="no compression" value=""/>'}
_TAIL = "</spectrumList></run></mzML>"


def _param(accession: str, name: str, value: object = "", unit: str = "") -> str:
    return f'<cvParam cvRef="MS" accession="{accession}" name="{name}" value={quoteattr(str(value))}{f" unitAccession={quoteattr(unit)}" if unit else ""}/>'


def spectrum_text(row: dict, index: int, compress: bool) -> str:
    """The element of one spectrum (columns of SPECTRUM; missing and null ones are left out)."""
    peaks = row.get("peaks")
    if not isinstance(peaks, tuple):  # dicts
        peaks = tuple(np.array([p[name] for p in peaks or ()], "<f8") for name in ("mz", "intensity"))
    out = [f'<spectrum index="{index}" id={quoteattr(str(row.get("id") or f"index={index}"))} defaultArrayLength="{len(peaks[0])}">']
    if row.get("ms_level") is not None:
        out.append(_param("MS:1000511", "ms level", row["ms_level"]))
    if row.get("polarity"):
        out.append(_param("MS:1000130", "positive scan") if row["polarity"] > 0 else _param("MS:1000129", "negative scan"))
    if row.get("rt_s") is not None:
        out.append(f'<scanList count="1"><scan>{_param("MS:1000016", "scan start time", repr(row["rt_s"]), SECONDS)}</scan></scanList>')
    if row.get("precursor_mz") is not None:
        ion = _param("MS:1000744", "selected ion m/z", repr(row["precursor_mz"])) + (_param("MS:1000041", "charge state", row["charge"]) if row.get("charge") is not None else "")
        ways = "".join(_param(a, n) for a, n in ACTIVATION.items() if n in (row.get("activation") or []) and a != "MS:1002481")
        ways += _param("MS:1000045", "collision energy", repr(row["energy"])) if row.get("energy") is not None else ""
        window = ""
        if row.get("isolation_low") is not None and row.get("isolation_high") is not None:
            middle = (row["isolation_low"] + row["isolation_high"]) / 2
            window = "<isolationWindow>" + _param("MS:1000827", "isolation window target m/z", repr(middle)) + _param("MS:1000828", "isolation window lower offset", repr(middle - row["isolation_low"])) + _param("MS:1000829", "isolation window upper offset", repr(row["isolation_high"] - middle)) + "</isolationWindow>"
        out.append(f'<precursorList count="1"><precursor>{window}<selectedIonList count="1"><selectedIon>{ion}</selectedIon></selectedIonList><activation>{ways}</activation></precursor></precursorList>')
    out.append('<binaryDataArrayList count="2">')
    for name, values in zip(("mz", "intensity"), peaks):
        raw = values.astype("<f8").tobytes()
        text = base64.b64encode(zlib.compress(raw) if compress else raw).decode()
        out.append(f'<binaryDataArray encodedLength="{len(text)}"><referenceableParamGroupRef ref="{name}"/><binary>{text}</binary></binaryDataArray>')
    return "".join(out) + "</binaryDataArrayList></spectrum>"


def write_mzml(spectra: DataFrame, path: str, compress: bool = True) -> None:
    """spectra (any columns of SPECTRUM) as mzML: one complete file for each partition; the number of spectra, known at a file's end only, isn't in its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, started = 0, False
        for b in batches:
            texts = [] if started else [_HEAD.format(way=_WAYS[compress])]
            started = True
            lists = b.column("peaks") if "peaks" in b.schema.names else pa.nulls(len(b), _KINDS[-2])
            mz, intensity = (lists.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("mz", "intensity"))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(int)
            for k, row in enumerate(b.select([c for c in b.schema.names if c != "peaks"]).to_pylist()):
                own = slice(ends[k], ends[k + 1])
                texts.append(spectrum_text(row | {"peaks": (mz[own], intensity[own])}, n, compress))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([_TAIL])], ["value"])

    spectra.mapInArrow(run, "value string").write.text(path)
