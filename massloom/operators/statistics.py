"""Histograms, ambiguity and converters of identifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offset_histogram(rows: DataFrame, by: list[str], offset: str, resolution: float, weight: str | None = None) -> DataFrame:
    """by, bin, n (and total): how often offsets fall in each bin of width `resolution`; parts of it can be added up."""
    out = rows.groupBy(*by, F.floor(F.col(offset) / F.lit(resolution)).cast("long").alias("bin"))
    return out.agg(F.count("*").alias("n"), *([F.sum(weight).alias("total")] if weight else []))


def merge_histograms(parts: list[DataFrame], by: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by, "bin").agg(*(F.sum(c).alias(c) for c in parts[0].columns if c not in (*by, "bin")))


def ambiguity(annotated: DataFrame, fragments: DataFrame, key: list[str]) -> DataFrame:
    """key, site, option, found, total: fragments that tell an option of an ambiguous site (B, Z, J or a modification) apart, and those met.

    Both tables: key, fragment_id, labels array<struct<site:string,option:string>>.
    """

    def spread(t: DataFrame, n: str) -> DataFrame:
        each = t.select(*key, "fragment_id", F.explode("labels").alias("l")).select(*key, "fragment_id", "l.site", "l.option").distinct()
        return each.groupBy(*key, "site", "option").agg(F.count("*").alias(n))

    return spread(fragments, "total").join(spread(annotated, "found"), [*key, "site", "option"], "left").fillna(0, ["found"]).select(*key, "site", "option", "found", "total")


def mass_error(observed: Column, options: Column, relative: bool = True) -> Column:
    """The smallest error of an observed mass against an array of theoretical ones: ppm or Da."""
    return F.array_min(F.transform(options, lambda m: F.abs(observed - m) / F.abs(m) * 1e6 if relative else F.abs(observed - m)))


def convert(psms: DataFrame) -> DataFrame:
    """sequence, scan_index, raw_file, z, score, class of identifications in the common schema."""
    kind = F.when(F.col("decoy").isNull(), "Unknown").when(F.col("decoy"), "Decoy").otherwise("Target")
    return psms.where("error is null").select(F.col("peptide").alias("sequence"), F.col("scan").alias("scan_index"), "raw_file", F.col("charge").alias("z"), F.col("confidence").alias("score"), kind.alias("class"))


def flanking(protein: Column, start: Column, length: Column, size: int = 1) -> Column:
    """Struct of the residues before and behind a stretch (start from 0); empty at the ends."""
    before = F.substring(protein, F.greatest(start - size, F.lit(0)) + 1, F.least(F.lit(size), start))
    return F.struct(before.alias("before"), F.substring(protein, start + length + 1, F.lit(size)).alias("behind"))
