"""Text functions of vocabularies and nucleotide sequences."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residues of codons in the order TTT, TTC, TTA, TTG, TCT, ... GGG; * is a stop.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): _CODE[k] for k, c in enumerate(itertools.product("TCAG", repeat=3))}
#: Ambiguous nucleotides.
NUCLEOTIDES = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def of_distinct(texts: pa.Array, one: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """What `one` makes of each text of a batch, as `kind`; equal texts are worked on once."""
    own = pa.compute.dictionary_encode(texts, null_encoding="encode")
    return pa.array([one(t) for t in own.dictionary.to_pylist()], kind).take(own.indices)


def trigrams(text: Column) -> Column:
    """All runs of three characters; non-ASCII ones count as NUL."""
    letters = F.split(F.regexp_replace(text, r"[^\x00-\x7F]", "\x00"), "")
    n = F.greatest(F.length(text) - 2, F.lit(0))
    # three shifted copies side by side: the text is read once, not once per trigram
    first, second, third = (F.slice(letters, F.lit(k), n) for k in (1, 2, 3))
    return F.zip_with(F.zip_with(first, second, lambda a, b: F.concat(a, b)), third, lambda a, b: F.concat(a, b))


def codon_table() -> dict[str, str | None]:
    """Residue of each codon, U read as T, ambiguous nucleotides included where all readings agree (B, Z and J where
    they are the two residues that those letters stand for); X where they don't, None for a stop."""
    letters = {**{k: k for k in "ACGT"}, **NUCLEOTIDES}
    pairs = {frozenset("ND"): "B", frozenset("QE"): "Z", frozenset("IL"): "J"}
    out: dict[str, str | None] = {}
    for codon in itertools.product(letters, repeat=3):
        read = {CODONS["".join(c)] for c in itertools.product(*(letters[x] for x in codon))}
        out["".join(codon)] = (None if read == {"*"} else next(iter(read))) if len(read) == 1 else pairs.get(frozenset(read), "X")
    return out


def translate(dna: Column, frame: int = 0) -> Column:
    """Residues of the whole codons from `frame` on; * for a stop, X for what isn't nucleotides. Codons with ambiguous
    nucleotides have the residue, or the letter for two residues, that all their readings share, else X."""
    clean = F.substring(F.translate(F.upper(dna), "U", "T"), F.lit(1 + frame), F.length(dna))
    known = F.create_map(*(F.lit(x) for kv in CODONS.items() for x in kv))
    wide = F.create_map(*(F.lit(x) for k, v in codon_table().items() if k not in CODONS and v != "X" for x in (k, v or "*")))
    codons = F.regexp_extract_all(clean, F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(known, c), F.element_at(wide, c), F.lit("X"))), "")


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(F.upper(dna), "ACGTURYKMBVDH", "TGCAAYRMKVBHD"))


def curie(text: Column) -> Column:
    """Struct of vocabulary and accession of such as MS:1000031; null if it is none."""
    parts = F.split(text, ":", 2)
    return F.when((F.size(parts) == 2) & (F.trim(parts[0]) != "") & (F.trim(parts[1]) != ""), F.struct(F.upper(F.trim(parts[0])).alias("cv"), F.trim(parts[1]).alias("accession")))
