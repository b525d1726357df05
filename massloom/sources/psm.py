"""Identification files as one schema: a table of formats, versions and headers.

Every file becomes rows of COMMON columns and `extras` (all other fields, as text). Which version a file has shows in its
header: the first version whose required headers are all there. A format is one entry of FORMATS.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.sources.delimited import fields, guess_separator, number_column, read_delimited, text_column

#: Columns of every format and their types.
COMMON = {
    "scan": "string", "raw_file": "string", "title": "string", "peptide": "string", "charge": "int", "mz": "double", "mass": "double",
    "rt_s": "double", "score": "double", "local_score": "array<double>", "protein": "string", "mode": "string", "decoy": "boolean", "rank": "int", "psm_id": "string",
}


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _hundredth(s: Column) -> Column:
    return _clamp(s / 100)


def _plain(s: Column) -> Column:
    return _clamp(s)


def _none(s: Column) -> Column:
    return F.lit(None).cast("double")


def _logistic(base: float, scale: float, shift: float) -> Callable[[Column], Column]:
    """scale / (1 + base ** -s) + shift, inside -1 to 1."""
    return lambda s: _clamp(F.lit(scale) / (1 + F.pow(F.lit(base), -s)) + shift)


E = 2.718281828459045


@dataclass(frozen=True)
class Version:
    """Headers of COMMON columns; those in `optional` may be missing. rt_minutes: the unit of rt_s in the file."""

    name: str
    headers: dict[str, str]
    optional: frozenset[str] = frozenset()
    rt_minutes: bool = False

    def fits(self, header: list[str]) -> bool:
        have = {h.lower() for h in header}
        return all(h.lower() in have for c, h in self.headers.items() if c not in self.optional)


@dataclass(frozen=True)
class Format:
    name: str
    versions: tuple[Version, ...]
    confidence: Callable[[Column], Column]
    separator: str | None = None
    header: list[str] | None = None
    local_separator: str = ","
    decoy: Callable[[Column], Column] = field(default=lambda c: F.lower(c).isin("-1", "1.0", "true", "d", "decoy", "y"))


def _v(name: str, text: str, optional: str = "", rt_minutes: bool = False) -> Version:
    """text: column=header;column=header"""
    return Version(name, dict(x.split("=", 1) for x in text.split(";")), frozenset(optional.split()), rt_minutes)


_MAXQUANT = "scan=scan number;peptide=modified sequence;charge=charge;score=score;protein=proteins;raw_file=raw file"
_INSTANOVO = "scan=scan_number;mz=precursor_mz;charge=precursor_charge;raw_file=experiment_name"
_PEAKS = "peptide=peptide;mz=m/z;rt_s=rt;"

#: Headers of the formats' versions. Order matters: the first version that fits counts.
FORMATS = {
    f.name: f
    for f in (
        Format("basic_csv", (_v("1", "scan=scan_index;peptide=sequence;raw_file=raw_file;charge=z;mode=mode", "mode"),), _none, ","),
        Format("deepnovo", (
            _v("deepnovo", "scan=scan;peptide=predicted_sequence;score=predicted_score;local_score=predicted_position_score"),
            _v("pointnovo", "scan=scan_list_original;peptide=predicted_sequence;score=predicted_score;local_score=predicted_position_score;mz=precursor_mz;charge=precursor_charge"),
        ), _logistic(E, 2, 0), "\t"),
        Format("instanovo", (
            _v("1.0.0", _INSTANOVO + ";peptide=preds;score=log_probs;local_score=token_log_probs"),
            _v("1.1.0", _INSTANOVO + ";peptide=predictions;score=log_probabilities;local_score=token_log_probabilities"),
            _v("plus 1.1.4", _INSTANOVO + ";peptide=final_prediction;score=final_log_probabilities;local_score=transformer_token_log_probabilities", "local_score"),
            _v("1.2.2", _INSTANOVO + ";peptide=predictions;score=log_probs;local_score=token_log_probs"),
        ), _logistic(1.01, 2, 0), ","),
        Format("maxquant", (
            _v("msms", _MAXQUANT + ";psm_id=id;mz=m/z;mass=mass;rt_s=retention time;mode=fragmentation", "raw_file", True),
            _v("msms_scans", _MAXQUANT + ";mz=m/z;mass=mass;rt_s=retention time;mode=fragmentation", "raw_file", True),
            _v("other", _MAXQUANT, "raw_file"),
        ), _logistic(1.01, 2, -1), "\t", local_separator=";"),
        Format("metamorpheus", (_v("1", "raw_file=file name;scan=scan number;rt_s=scan retention time;charge=precursor charge;mz=precursor mz;mass=precursor mass;peptide=full sequence;protein=accession;score=score;decoy=decoy", "", True),), _hundredth, "\t"),
        Format("opair", (_v("1", "raw_file=file name;scan=scan number;rt_s=scan retention time;charge=precursor charge;mz=precursor mz;mass=precursor mass;peptide=full sequence;protein=protein accession;score=score;rank=rank;decoy=decoy/contaminant/target", "", True),), _hundredth, "\t"),
        Format("msfragger", (
            _v("4.2", "scan=scannum;peptide=peptide;charge=charge;mass=precursor_neutral_mass;score=hyperscore;protein=proteins;rt_s=retention_time;rank=hit_rank"),
            _v("philosopher", "scan=spectrum;peptide=peptide;charge=charge;mass=observed mass;mz=observed m/z;score=hyperscore;protein=protein;rt_s=retention;raw_file=spectrum file", "raw_file"),
        ), _hundredth, "\t"),
        Format("novob", (_v("0.0.1", "scan=mcount;charge=charge;mass=pepmass;peptide=senten;score=prob"),), _plain, "\t", ["mcount", "charge", "pepmass", "senten", "delta_mass", "prob", "senten_reverse", "delta_mass_reverse", "prob_reverse"]),
        Format("novor", (
            _v("old de novo", "scan=scan #;mz=m/z;charge=z;mass=peptide mass;score=score;peptide=de novo peptide"),
            _v("old psm", "psm_id=id;scan=scan #;mz=m/z;charge=z;mass=mass;score=score;peptide=sequence"),
            _v("psm 2023", "psm_id=id;scan=scan;mz=m/z;charge=z;mass=mass;score=score;peptide=sequence"),
            _v("new de novo", "psm_id=# id;scan=scannum;rt_s=rt;mz=mz(data);charge=z;mass=pepmass(denovo);score=score;peptide=peptide;local_score=aascore"),
            _v("new psm", "psm_id=#id;scan=scannum;rt_s=rt;mz=mz;charge=z;mass=pepmass;score=score;peptide=peptide;protein=protein;local_score=aac"),
        ), _hundredth, ",", local_separator="-"),
        Format("peaks", (
            _v("13 dia", _PEAKS + "score=caa (%);scan=scan;charge=z;mass=mass;raw_file=source file;protein=accession", "", True),
            _v("x", _PEAKS + "score=alc (%);scan=scan;charge=z;mass=mass;local_score=local confidence (%);raw_file=source file;mode=mode", "raw_file mode", True),
            _v("psm", _PEAKS + "score=-10lgp;scan=scan;charge=z;mass=mass;raw_file=source file;protein=accession;psm_id=id", "charge scan mass raw_file protein psm_id", True),
        ), _hundredth, ",", local_separator=" "),
        Format("pepnet", (_v("1.0", "peptide=denovo;score=score;local_score=positional score"),), _plain, "\t"),
        Format("pihelixnovo", (_v("1.1", "title=title;peptide=peptide;score=score"),), _plain, "\t", ["title", "peptide", "score"]),
        Format("piprimenovo", (_v("0.1", "title=label;peptide=prediction;score=score;charge=charge"),), _plain, "\t"),
        Format("plgs", (_v("3.0", "peptide=peptide.seq;score=peptide.score;protein=protein.accession;mass=precursor.mhp;rt_s=precursor.rett;charge=precursor.charge;mz=precursor.mz;rank=peptide.rank;psm_id=precursor.leid", "", True),), _logistic(1.3, 2, -1), ","),
        Format("plink", (_v("2.3", "psm_id=order;title=title;charge=charge;mass=precursor_mh;peptide=peptide;score=score;decoy=target_decoy;protein=proteins"),), lambda s: _clamp(1 - s), ","),
        Format("powernovo", (_v("1.0.17", "title=spectrum name;peptide=powernovo peptides;score=powernovo score;local_score=powernovo aascore"),), _plain, ",", local_separator=" "),
        Format("proteoscape", (_v("2025b", "scan=ms2 id;peptide=peptide sequence;score=confidence score;mz=precursor mz;rt_s=rt;protein=protein group name;charge=charge"),), _hundredth, "\t"),
        Format("punifind", (_v("0.1", "title=spectrum_title;score=score;rt_s=rt;peptide=peptide"),), _none, ",", ["spectrum_title", "score", "cos_similarity", "rt", "mass_error", "peptide", "modifications"]),
        Format("sage", (_v("0.14", "psm_id=psm_id;peptide=peptide;protein=proteins;raw_file=filename;scan=scannr;rank=rank;decoy=label;mass=expmass;charge=charge;rt_s=rt;score=sage_discriminant_score", "", True),), _plain, "\t", decoy=lambda c: c == "-1"),
        Format("ssl", (_v("1", "raw_file=file;scan=scan;charge=charge;peptide=sequence;score=score;rt_s=retention-time;mz=precursorMZ", "peptide score rt_s mz", True),), _plain, "\t"),
    )
}

#: Formats that are tried for a file of an extension, in order.
BY_EXTENSION = {
    "csv": ["peaks", "novor", "instanovo", "plink", "powernovo", "plgs", "basic_csv", "punifind"],
    "tsv": ["sage", "pepnet", "msfragger", "proteoscape", "novob", "piprimenovo"],
    "psmtsv": ["metamorpheus", "opair"],
    "txt": ["maxquant", "pihelixnovo"],
    "deepnovo_denovo": ["deepnovo"],
    "ssl": ["ssl"],
}


def detect(header: list[str], names: list[str]) -> tuple[Format, Version]:
    """The first of the formats that has a version for this header."""
    for n in names:
        for v in FORMATS[n].versions:
            if FORMATS[n].header is not None and [h.lower() for h in header] != FORMATS[n].header and v.headers:
                continue
            if v.fits(header):
                return FORMATS[n], v
    raise ValueError(f"none of {', '.join(names)} has these columns: {', '.join(header)}")


def _extension(path: str) -> str:
    parts = path.lower().rstrip("/").rsplit("/", 1)[-1].split(".")
    return parts[-2] if parts[-1] == "gz" and len(parts) > 1 else parts[-1]


def read_psms(spark: SparkSession, path: str, format: str | None = None, version: str | None = None) -> DataFrame:
    """COMMON columns, confidence (-1 to 1), format, version, extras and error of every line."""
    if format == "mztab" or (not format and _extension(path) == "mztab"):
        return _from_mztab(spark, path)
    names = [format] if format else BY_EXTENSION.get(_extension(path), [])
    if not names:
        raise ValueError(f"no format is known for {path}")
    separator = FORMATS[names[0]].separator or guess_separator(path)
    head = [r["value"].lstrip("﻿") for r in spark.read.text(path).limit(2).collect()]
    if head and head[0].lower().startswith("sep="):
        separator, head = head[0][4], head[1:]
    header = fields(head[0], separator) if head else []
    if format and version:
        own, v = FORMATS[format], next(x for x in FORMATS[format].versions if x.name == version)
    elif format and FORMATS[format].header:
        own, v = FORMATS[format], FORMATS[format].versions[0]
    else:
        own, v = detect(header, names)
    return common(read_delimited(spark, path, separator, own.header), own, v)


def _from_mztab(spark: SparkSession, path: str) -> DataFrame:
    from massloom.sources.mztab import read_mztab

    _, _, psms = read_mztab(spark, path)
    own = {"peptide": F.col("sequence"), "charge": F.col("charge"), "mz": F.col("exp_mass_to_charge"), "rt_s": F.col("rt_s"), "protein": F.col("accession"), "psm_id": F.col("psm_id"), "scan": F.col("spectra_ref"), "score": F.col("confidence")}
    columns = [own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in COMMON.items()]
    return psms.select(*columns, F.col("confidence"), F.lit("mztab").alias("format"), F.lit("1.0").alias("version"), F.col("values").alias("extras"), F.col("error"))


def common(rows: DataFrame, own: Format, v: Version) -> DataFrame:
    """rows: values (map), error."""
    out = {}
    for name, kind in COMMON.items():
        header = v.headers.get(name)
        if header is None:
            out[name] = F.lit(None).cast(kind)
        elif kind == "array<double>":
            text = F.regexp_replace(text_column("values", header), r"[\[\]]", "")
            out[name] = F.transform(F.split(text, own.local_separator), lambda x: F.trim(x).try_cast("double"))
        elif kind == "boolean":
            out[name] = own.decoy(text_column("values", header))
        elif kind == "int":
            out[name] = number_column("values", header).try_cast("int")
        elif kind == "double":
            out[name] = number_column("values", header) * (60.0 if name == "rt_s" and v.rt_minutes else 1.0)
        else:
            out[name] = text_column("values", header)
    used = [h.lower() for h in v.headers.values()]
    missing = [c for c in ("peptide", "charge") if c in v.headers and c not in v.optional]
    bad = F.lit(None).cast("string")
    for c in missing:
        bad = F.coalesce(bad, F.when(F.col("error").isNull() & out[c].isNull(), F.lit(f"no {c}")))
    rest = F.map_filter("values", lambda k, _: ~k.isin(used))
    return rows.select(*(c.alias(n) for n, c in out.items()), own.confidence(out["score"]).alias("confidence"), F.lit(own.name).alias("format"), F.lit(v.name).alias("version"), rest.alias("extras"), F.coalesce("error", bad).alias("error"))


def union_formats(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
