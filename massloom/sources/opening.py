"""Files opened by what their names and first lines say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from massloom.sources.mzml import read_mzml
from massloom.sources.psm import BY_EXTENSION, FORMATS, _extension, read_psms
from massloom.sources.sequences import read_fasta
from massloom.sources.spectra import read_mgf, read_speclib
from massloom.sources.vocabulary import read_obo

Reader = Callable[[SparkSession, str], DataFrame]

#: Kind of content, reader, and extensions that say so.
KINDS: dict[str, tuple[Reader, tuple[str, ...]]] = {
    "sequences": (read_fasta, ("fasta", "fas", "fa", "faa", "mpfa")),
    "spectra_mgf": (read_mgf, ("mgf",)),
    "spectra_mzml": (read_mzml, ("mzml",)),
    "library": (read_speclib, ("mzspeclib", "mzlib")),
    "ontology": (read_obo, ("obo",)),
    "identifications": (read_psms, ("mztab", *BY_EXTENSION)),
}
#: How a first line that isn't empty begins, where an extension says nothing or .txt.
_BEGINNINGS = {"<mzSpecLib": "library", "<?xml": "spectra_mzml", "<mzML": "spectra_mzml", "<indexedmzML": "spectra_mzml", "BEGIN IONS": "spectra_mgf", "format-version:": "ontology", ">": "sequences", "MTD\t": "identifications"}


def kind_of(spark: SparkSession, path: str) -> str:
    """The kind of a file: by its extension (.gz apart), else by its first line. ValueError if neither says it."""
    extension = _extension(path)
    own = next((k for k, (_, names) in KINDS.items() if extension in names), None)
    if own and extension != "txt":
        return own
    first = next((r["value"].lstrip("﻿") for r in spark.read.text(path).where("trim(value) <> ''").limit(1).collect()), "")
    found = next((k for start, k in _BEGINNINGS.items() if first.startswith(start)), own)
    if not found:
        raise ValueError(f"no kind is known for {path}")
    return found


def open_file(spark: SparkSession, path: str, kind: str | None = None, format: str | None = None) -> tuple[str, DataFrame]:
    """Kind and table of a file; kind and format (of identifications) may be said. Identifications are read by the first format whose columns fit."""
    if format and format not in (*FORMATS, "mztab"):
        raise ValueError(f"no format {format}")
    kind = kind or ("identifications" if format else kind_of(spark, path))
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}")
    if kind == "identifications" and not format and _extension(path) not in KINDS[kind][1]:
        format = "mztab"  # known by its first line
    return kind, read_psms(spark, path, format) if kind == "identifications" else KINDS[kind][0](spark, path)
