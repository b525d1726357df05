"""Folds by CRC-32 of the id's decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32(doc_id as text) modulo mod; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % mod


def drawn(doc_id: Column | str, share: float, seed: int) -> Column:
    """A fixed draw of about that share of the ids."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
