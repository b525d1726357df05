"""Classes of residues and their identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published classes of the twenty residues (J as I and L; B, Z, U, O and X where they are known).
CLASSES = {
    "physicochemical": {"aliphatic": "AILVJ", "proline": "P", "tyrosine": "Y", "tryptophan": "W", "glycine": "G", "phenylalanine": "F", "sulphur": "CM", "hydroxyl": "ST", "acidic": "DE", "amide": "NQ", "basic": "RHK"},
    "chemical": {"aliphatic": "AILVGPJ", "aromatic": "FWY", "sulphur": "CM", "hydroxyl": "ST", "acidic": "DE", "amide": "NQ", "basic": "RHK"},
    "volume": {"very_small": "AGS", "small": "NDCPTBU", "medium": "QEHVZ", "large": "RILKMJ", "very_large": "FWYO"},
    "hydropathy": {"hydrophobic": "ACILMFWVJU", "neutral": "GHPSTY", "hydrophilic": "RNDQEKBZO"},
    "charge": {"positive": "RHK", "negative": "DE", "uncharged": "ANCQGILMFPSTWYVJUO"},
    "polarity": {"polar": "RNDQEHKSTYBZ", "nonpolar": "ACGILMFPWVJUO"},
    "hydrogen_bond": {"donor": "RKW", "acceptor": "DE", "both": "NQHSTY", "none": "ACGILMFPVJ"},
}
#: Letters that stand for others.
STANDS_FOR = {"J": "IL", "B": "ND", "Z": "QE"}


def class_table(spark: SparkSession) -> DataFrame:
    """aa and a column for each kind of class; unknown where a class is not known."""
    letters = "ARNDCQEGHILKMFPSTWYVBJZUOX"
    rows = [(aa, *(next((c for c, own in kind.items() if aa in own), "unknown") for kind in CLASSES.values())) for aa in letters]
    return spark.createDataFrame(rows, "aa string, " + ", ".join(f"{k} string" for k in CLASSES))


def same_residue(a: Column, b: Column) -> Column:
    """Whether two letters can be the same residue: X is any, J is I or L, B is N or D, Z is Q or E."""
    out = (a == b) | (a == "X") | (b == "X")
    for wide, own in STANDS_FOR.items():
        out = out | ((a == wide) & b.isin(*own)) | ((b == wide) & a.isin(*own))
    return out


def mass_difference(a: Column, b: Column, relative: bool = False) -> Column:
    """The smallest difference between two arrays of alternative masses, in Da or in ppm of the first."""
    each = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y) / F.abs(x) * 1e6 if relative else F.abs(x - y))))
    return F.array_min(each)
