"""Digestion of protein sequences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Protease:
    """A cut stands where the residue before it is in `after` and the one behind it in `before` (empty: any), and the
    latter is not in `unless`."""

    after: str = ""
    before: str = ""
    unless: str = ""

    def pattern(self) -> str:
        """A zero-width expression that matches at cuts; X matches any residue, B, Z and J what they stand for."""
        wide = {"N": "B", "D": "B", "Q": "Z", "E": "Z", "I": "J", "L": "J"}

        def letters(s: str) -> str:
            return "".join(dict.fromkeys(s + "".join(wide[c] for c in s if c in wide) + "X"))

        back = f"(?<=[{letters(self.after)}])" if self.after else "(?<=.)"
        ahead = f"(?=[{letters(self.before)}])" if self.before else "(?=.)"
        return back + ahead + (f"(?![{self.unless}])" if self.unless else "")


PROTEASES = {
    "trypsin_any": Protease(after="KR"),
    "trypsin_not_before_proline": Protease(after="KR", unless="P"),
    "chymotrypsin": Protease(after="FWYLM"),
    "pepsin": Protease(after="FWYL"),
    "gluc": Protease(after="E"),
    "aspn": Protease(before="D"),
    "lysc": Protease(after="K"),
    "argc": Protease(after="R"),
}


def pieces(sequence: Column, protease: Protease) -> Column:
    """The stretches between cuts, in order; no empty ones."""
    return F.array_remove(F.split(sequence, protease.pattern()), "")


def cut_sites(sequence: Column, protease: Protease) -> Column:
    """Positions of cuts inside the sequence: the number of residues before each."""
    grown = F.aggregate(pieces(sequence, protease), F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    return F.filter(grown, lambda k: (k > 0) & (k < F.length(sequence)))


def digest(proteins: DataFrame, protease: Protease, missed: int = 1, lengths: tuple[int, int] = (6, 30), sequence: str = "sequence") -> DataFrame:
    """The columns of proteins but the sequence, with peptide, first_piece (from 0) and missed of each peptide."""
    keep = [c for c in proteins.columns if c != sequence]
    cut = proteins.select(*keep, pieces(F.col(sequence), protease).alias("pieces_"))
    n = F.size("pieces_")

    def from_piece(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.least(F.lit(missed), n - 1 - k)), lambda m: F.struct(k.alias("first_piece"), m.cast("int").alias("missed"), F.array_join(F.slice("pieces_", k + 1, m + 1), "").alias("peptide")))

    # all peptides of a protein are put together in its row; only they are exploded, so no row carries the pieces along
    peptides = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_piece)))
    inside = F.filter(peptides, lambda p: F.length(p["peptide"]).between(*lengths))
    return cut.select(*keep, F.explode(inside).alias("p_")).select(*keep, "p_.first_piece", "p_.missed", "p_.peptide")


def sub_sequence(sequence: Column, start: Column, end: Column) -> Column:
    return F.substring(sequence, start + 1, end - start)
