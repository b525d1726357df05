"""Germline records in EMBL style, as one row per coding feature."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.text import CODONS

FEATURES = "accession string, species string, feature string, name string, start int, end int, complement boolean, functional boolean, dna string, sequence string, error string"
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
_PLACE = re.compile(r"(complement\()?<?(\d+)\.\.>?(\d+)\)?")


def translated(dna: str) -> str:
    """Residues of whole codons; * for stops, X for what isn't four known nucleotides."""
    return "".join(CODONS.get(dna[k : k + 3], "X") for k in range(0, len(dna) - len(dna) % 3, 3))


def parse_record(text: str) -> list[dict]:
    """The located features of one record (up to //)."""
    accession, species, dna, features, in_sequence = "", "", [], [], False
    for line in text.splitlines():
        code, rest = line[:2], line[5:].rstrip()
        if in_sequence and code == "  ":
            dna.append(re.sub(r"[^A-Za-z]", "", line))
        elif code == "AC" and not accession:
            accession = rest.split(";")[0].strip()
        elif code == "OS" and not species:
            species = rest.strip()
        elif code == "SQ":
            in_sequence = True
        elif code == "FT":
            key, value = rest[:16].strip(), rest[16:].strip()
            if key:
                features.append([key, value, {}])
            elif features and value.startswith("/"):
                name, _, text_ = value[1:].partition("=")
                features[-1][2][name] = text_.strip('"')
            elif features and features[-1][2]:
                last = next(reversed(features[-1][2]))
                features[-1][2][last] += " " + value.strip('"')
    whole, out = "".join(dna).upper().replace("U", "T"), []
    for key, place, qualifiers in features:
        m = _PLACE.fullmatch(place)
        if not m:
            continue
        start, end = int(m[2]) - 1, int(m[3])
        part = whole[start:end]
        error = None if len(part) == end - start else "the place is outside of the sequence"
        if m[1]:
            part = part.translate(_COMPLEMENT)[::-1]
        shift = qualifiers.get("codon_start", "1")
        shift = int(shift) - 1 if shift.isdigit() else 0
        functional = not any(q in qualifiers for q in ("pseudo", "partial", "ORF"))
        name = qualifiers.get("IMGT_allele") or qualifiers.get("allele") or qualifiers.get("IMGT_gene") or qualifiers.get("gene")
        out.append({"accession": accession, "species": species, "feature": key, "name": name, "start": start, "end": end, "complement": bool(m[1]), "functional": functional, "dna": part, "sequence": translated(part[shift:]), "error": error})
    return out


def read_germlines(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for t in pdf["value"] for r in parse_record(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return spark.read.text(path, lineSep="\n//").mapInPandas(run, FEATURES)


def germline_table(features: DataFrame, kinds: list[str] = ["V-REGION", "J-REGION", "C-REGION"]) -> DataFrame:
    """species, chain, gene_kind, gene, number, sequence, acc: one row per allele, the smallest accession of equal ones."""
    name = r"^(?:IG|TR)?([HKLI])([VJC]|[ADEGM])([^*]*)(?:\*(\d+))?$"
    own = features.where(F.col("feature").isin(kinds) & F.col("functional") & F.rlike("name", F.lit(name)) & F.col("error").isNull())
    kind = F.regexp_extract("name", name, 2)
    own = own.select("species", F.regexp_extract("name", name, 1).alias("chain"), F.when(kind.isin("V", "J", "C"), kind).otherwise(F.concat(F.lit("C"), kind)).alias("gene_kind"), F.regexp_extract("name", name, 3).alias("gene"), F.regexp_extract("name", name, 4).try_cast("int").alias("number"), "sequence", "accession")
    return own.groupBy("species", "chain", "gene_kind", "gene", "number", "sequence").agg(F.min("accession").alias("acc"))
