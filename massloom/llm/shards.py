"""Groups of documents small enough for one Python call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_of(docs: DataFrame, key: str, mb: float) -> Column:
    """A shard for each document, by the hash of its key; about `mb` MB of text each, whatever the corpus size."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return F.pmod(F.xxhash64(F.col(key)), F.lit(int(total / (mb * 1e6)) + 1))
