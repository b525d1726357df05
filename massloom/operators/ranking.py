"""Best rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each partition to k before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def best_with_ties(rows: DataFrame, by: list[str], score: str, epsilon: float = 1e-9) -> DataFrame:
    """All rows within epsilon of their group's best score, and whether there is only one (`unique`)."""
    group = Window.partitionBy(*by)
    best = rows.withColumn("best_", F.max(score).over(group)).where(F.col(score) >= F.col("best_") - epsilon).drop("best_")
    return best.withColumn("unique", F.count("*").over(group) == 1)


def select_germlines(alleles: DataFrame, species: list[str] | None = None, chains: list[str] | None = None, genes: list[str] | None = None, allele: str = "all") -> DataFrame:
    """alleles (species, chain, gene_kind, gene, number, ...) of the given sets (None: any). Kind C matches every C*.

    allele: all, or first (the smallest number of each gene).
    """
    out = alleles
    for column, keep in (("species", species), ("chain", chains)):
        if keep is not None:
            out = out.where(F.col(column).isin(keep))
    if genes is not None:
        named = F.col("gene_kind").isin(genes)
        out = out.where(named | F.col("gene_kind").startswith("C") if "C" in genes else named)
    return top_k(out, ["species", "chain", "gene_kind", "gene"], [F.col("number")], 1, "rank_").drop("rank_") if allele == "first" else out


def target_or_decoy(psms: DataFrame, key: list[str], decoy: str = "decoy") -> DataFrame:
    """key, class: Target if one of the proteins is no decoy, Decoy if all are, Unknown without a protein (decoy null)."""
    real = F.bool_or(~F.col(decoy))
    return psms.groupBy(*key).agg(F.when(real.isNull(), "Unknown").when(real, "Target").otherwise("Decoy").alias("class"))
