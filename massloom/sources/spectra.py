"""Spectra as text: MGF files, spectral libraries (mzSpecLib) and their peak annotations (mzPAF)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PEAKS = "array<struct<mz:double,intensity:float>>"


def mgf_records(blocks: DataFrame) -> DataFrame:
    """Of text read with lineSep 'BEGIN IONS': title, scan, rt_s, charge, precursor_mz, extra and peaks."""
    body = blocks.select(F.split("value", "END IONS", 2)[0].alias("b")).where(F.rlike("b", F.lit(r"(?m)^\s*[A-Za-z]+=|^\s*[0-9]")))
    lines = F.transform(F.split("b", r"\r?\n"), lambda x: F.trim(x))
    out = body.select(F.filter(lines, lambda x: F.contains(x, F.lit("=")) & x.rlike("^[A-Za-z]")).alias("h"), F.filter(lines, lambda x: x.rlike("^[0-9]")).alias("p"))
    pairs = F.transform("h", lambda x: F.struct(F.upper(F.split(x, "=", 2)[0]).alias("k"), F.split(x, "=", 2)[1].alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
    # of a header that comes twice the first counts
    header = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["k"] == k), 1)["v"]))
    peaks = F.transform("p", lambda x: F.struct(F.split(x, r"\s+")[0].cast("double").alias("mz"), F.get(F.split(x, r"\s+"), F.lit(1)).try_cast("float").alias("intensity")))
    out = out.select(header.alias("h"), peaks.alias("peaks"))
    charge = F.regexp_extract("h.CHARGE", r"([0-9]+)", 1).try_cast("int") * F.when(F.contains("h.CHARGE", F.lit("-")), -1).otherwise(1)
    own = ["TITLE", "SCANS", "RTINSECONDS", "CHARGE", "PEPMASS"]
    return out.select(
        F.col("h.TITLE").alias("title"), F.regexp_extract(F.coalesce("h.SCANS", F.lit("")), r"([0-9]+)", 1).try_cast("long").alias("scan"), F.col("h.RTINSECONDS").try_cast("double").alias("rt_s"),
        charge.alias("charge"), F.split("h.PEPMASS", r"\s+")[0].try_cast("double").alias("precursor_mz"), F.map_filter("h", lambda k, _: ~k.isin(own)).alias("extra"), "peaks",
    )


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    return mgf_records(spark.read.text(path, lineSep="BEGIN IONS"))


def explode_peaks(spectra: DataFrame, key: str) -> DataFrame:
    """key, peak_idx, mz, intensity."""
    return spectra.select(key, F.posexplode("peaks").alias("peak_idx", "p_")).select(key, "peak_idx", "p_.mz", F.col("p_.intensity").cast("double").alias("intensity"))


_ATTRIBUTE = re.compile(r"(?:\[(\d+)\])?([A-Za-z]+:[A-Za-z0-9]+)\|([^=]*)=(.*)")
_SECTION = re.compile(r"<(mzSpecLib|AttributeSet|Spectrum|Analyte|Interpretation|InterpretationMember|Peaks)(?:[ =](.*?))?>")
ATTRIBUTES = "array<struct<section:string,section_id:string,group:int,accession:string,name:string,value:string>>"
LIBRARY = f"key bigint, name string, scan string, attributes {ATTRIBUTES}, peaks array<struct<mz:double,intensity:float,annotations:string,aggregations:string>>, error string"


def parse_library_entry(text: str, sets: list[dict] | None = None) -> dict:
    """One <Spectrum=...> block; sets: attributes of the library's sets that apply to all spectra."""
    out = {"key": None, "name": None, "scan": None, "attributes": list(sets or []), "peaks": [], "error": None}
    section, section_id = "Spectrum", None
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        m = _SECTION.fullmatch(line)
        if m:
            section, section_id = m[1], m[2]
            if section == "Spectrum":
                out["key"] = int(m[2]) if (m[2] or "").isdigit() else None
                out["error"] = out["error"] or (None if out["key"] is not None else f"no key: {line}")
        elif section == "Peaks":
            parts = line.split("\t")
            try:
                out["peaks"].append({"mz": float(parts[0]), "intensity": float(parts[1]), "annotations": parts[2] if len(parts) > 2 else None, "aggregations": parts[3] if len(parts) > 3 else None})
            except (ValueError, IndexError):
                out["error"] = out["error"] or f"no peak: {line}"
        elif a := _ATTRIBUTE.fullmatch(line):
            out["attributes"].append({"section": section, "section_id": section_id, "group": int(a[1]) if a[1] else None, "accession": a[2], "name": a[3], "value": a[4]})
            if a[2] == "MS:1003061":
                out["name"] = a[4]
            elif a[2] == "MS:1003057":
                out["scan"] = a[4]
        else:
            out["error"] = out["error"] or f"no attribute: {line}"
    return out


def read_speclib(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of a text library; a block with an error keeps what could be read. Attribute sets of `Spectrum=all` are inherited."""
    blocks = spark.read.text(path, lineSep="\n<Spectrum=")
    head = blocks.where(F.startswith("value", F.lit("<mzSpecLib"))).limit(1).collect()
    sets, section, wanted = [], "", False
    for line in (head[0]["value"].splitlines() if head else []):
        m = _SECTION.fullmatch(line.strip())
        if m:
            section, wanted = m[1], m[1] == "AttributeSet" and (m[2] or "").strip().endswith("=all")
            target = (m[2] or "").split("=")[0].strip()
        elif section == "AttributeSet" and wanted and (a := _ATTRIBUTE.fullmatch(line.strip())):
            sets.append({"section": target, "section_id": "all", "group": int(a[1]) if a[1] else None, "accession": a[2], "name": a[3], "value": a[4]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([parse_library_entry("<Spectrum=" + t, sets) for t in pdf["value"]], columns=["key", "name", "scan", "attributes", "peaks", "error"])

    return blocks.where(~F.startswith("value", F.lit("<mzSpecLib"))).mapInPandas(run, LIBRARY)


def library_lines(library: DataFrame) -> DataFrame:
    """value: the text of each spectrum, to be written behind a header line <mzSpecLib>."""

    def attribute(a: Column) -> Column:
        return F.concat(F.when(a["group"].isNotNull(), F.concat(F.lit("["), a["group"].cast("string"), F.lit("]"))).otherwise(""), a["accession"], F.lit("|"), a["name"], F.lit("="), a["value"])

    def section(name: str, ids: bool) -> Column:
        own = F.filter("attributes", lambda a: (a["section"] == name) & (F.coalesce(a["section_id"], F.lit("")) != "all"))
        head = F.lit(f"<{name}=") if ids else F.lit("")
        start = F.concat(head, F.coalesce(F.element_at(F.transform(own, lambda a: a["section_id"]), 1), F.lit("1")), F.lit(">\n")) if ids else F.lit("")
        return F.when(F.size(own) > 0, F.concat(start, F.array_join(F.transform(own, attribute), "\n"), F.lit("\n"))).otherwise("")

    peak = F.transform("peaks", lambda p: F.concat_ws("\t", p["mz"].cast("string"), p["intensity"].cast("string"), p["annotations"], p["aggregations"]))
    return library.select(F.concat(F.lit("<Spectrum="), F.col("key").cast("string"), F.lit(">\n"), section("Spectrum", False), section("Analyte", True), section("Interpretation", True), F.lit("<Peaks>\n"), F.array_join(peak, "\n")).alias("value"))


_ION = re.compile(
    r"(?P<auxiliary>&)?(?:(?P<analyte>\d+)@)?(?P<ion>\?|p|r\[[^\]]*\]|f\{[^}]*\}|_\{[^}]*\}|s\{[^}]*\}|I[A-Z](?:\[[^\]]*\])?|m\d+:\d+|[abcdvwxyz]a?b?\d+)"
    r"(?P<losses>(?:[+-](?:\d*(?:\[[^\]]*\]|[A-Z][A-Za-z0-9]*)))*)?(?P<isotope>(?:[+-]\d*i(?:\d*[A-Z][a-z]?|A)?)*)(?:\[(?P<adduct>M[^\]]*)\])?(?:\^(?P<charge>-?\d+))?(?:/(?P<deviation>-?[0-9.]+(?:e[+-]?\d+)?)(?P<unit>ppm)?)?(?:\*(?P<confidence>[0-9.]+))?"
)
ANNOTATION = "array<struct<ion:string,index:int,analyte:int,auxiliary:boolean,losses:string,isotope:string,adduct:string,charge:int,deviation:double,unit:string,confidence:double>>"


def parse_annotations(text: str) -> list[dict]:
    """All comma-separated annotations of a peak; an error for what is none."""
    out, at = [], 0
    while at < len(text):
        m = _ION.match(text, at)
        if not m or (m.end() < len(text) and text[m.end()] != ","):
            raise ValueError(f"no annotation: {text[at:]!r}")
        g, ion = m.groupdict(), m["ion"]
        number = re.fullmatch(r"([a-z]+)(\d+)", ion) if not ion.startswith("m") else None
        out.append({
            "ion": number[1] if number else ion, "index": int(number[2]) if number else None, "analyte": int(g["analyte"]) if g["analyte"] else None, "auxiliary": bool(g["auxiliary"]), "losses": g["losses"] or None, "isotope": g["isotope"] or None,
            "adduct": g["adduct"], "charge": int(g["charge"]) if g["charge"] else 1, "deviation": float(g["deviation"]) if g["deviation"] else None, "unit": ("ppm" if g["unit"] else "da") if g["deviation"] else None, "confidence": float(g["confidence"]) if g["confidence"] else None,
        })
        at = m.end() + 1
    return out


def render_annotation(a: dict) -> str:
    """The text of one parsed annotation."""
    number = "" if a["index"] is None else str(a["index"])
    deviation = "" if a["deviation"] is None else f"/{a['deviation']:g}" + ("ppm" if a["unit"] == "ppm" else "")
    return "".join(("&" if a["auxiliary"] else "", f"{a['analyte']}@" if a["analyte"] is not None else "", a["ion"], number, a["losses"] or "", a["isotope"] or "", f"[{a['adduct']}]" if a["adduct"] else "", f"^{a['charge']}" if a["charge"] != 1 else "", deviation, f"*{a['confidence']:g}" if a["confidence"] is not None else ""))


def annotations(text: Column | str) -> Column:
    """parse_annotations of a column; null for what is none."""

    @F.pandas_udf(ANNOTATION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> list[dict] | None:
            try:
                return parse_annotations(t) if t else None
            except ValueError:
                return None

        for s in batches:
            yield s.map(one)

    return run(text)


def write_library_index(library: DataFrame, path: str, row_group_mb: int = 8) -> None:
    """A library (key, name, ...) as Parquet in the order of keys, with row groups of some MB and a Bloom filter of names in each.

    Of such a table, `library_entries` reads the row groups whose range of keys, or whose filter, can hold what is asked for, and no others.
    """
    ordered = library.repartitionByRange("key").sortWithinPartitions("key")
    ordered.write.option("parquet.block.size", row_group_mb << 20).option("parquet.bloom.filter.enabled#name", "true").parquet(path)


def library_entries(spark: SparkSession, path: str, keys: list[int] | None = None, names: list[str] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """Spectra of a library index with one of the keys, one of the names, and a key in the range (bounds included), as far as each is given."""
    out = spark.read.parquet(path)
    if keys is not None:
        out = out.where(F.col("key").isin(keys))
    if names is not None:
        out = out.where(F.col("name").isin(names))
    return out.where(F.col("key").between(*between)) if between else out


def write_speclib(library: DataFrame, path: str, attributes: list[tuple[str, str, str]] = [], sets: dict[str, list[tuple[str, str, str]]] | None = None) -> None:  # noqa: B006
    """A library as text files, each with the head: <mzSpecLib>, its attributes and sets (by section: attributes that all spectra have), as (accession, name, value)."""
    line = lambda a: f"{a[0]}|{a[1]}={a[2]}"
    head = ["<mzSpecLib>", *map(line, attributes)]
    for section, own in (sets or {}).items():
        head += [f"<AttributeSet {section}=all>", *map(line, own)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started = False
        for pdf in batches:
            if not started and len(pdf):
                started = True
                yield pd.DataFrame({"value": ["\n".join(head)]})
            yield pdf

    library_lines(library).mapInPandas(run, "value string").write.text(path)
