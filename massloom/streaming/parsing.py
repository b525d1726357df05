"""The same parsers on files as they arrive. They keep no state, so nothing is aggregated or held back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.sources import sequences, spectra
from massloom.sources.delimited import tokenize
from massloom.sources.psm import FORMATS, common


def stream_psms(spark: SparkSession, folder: str, format: str, version: str, header: list[str]) -> DataFrame:
    """Identification files that arrive in a folder, of a given format and header (a stream has no first line to look at)."""
    own = FORMATS[format]
    names = [h.lower() for h in header]
    lines = spark.readStream.text(folder).withColumn("t_", tokenize(F.col("value"), own.separator or ","))
    keys = F.array(*(F.lit(x) for x in names))
    fits = F.size("t_.fields") == len(names)
    rows = lines.where(F.transform("t_.fields", F.lower) != keys).select(F.when(fits, F.map_from_arrays(keys, F.col("t_.fields"))).alias("values"), F.coalesce("t_.error", F.when(~fits, "another number of columns than in the header")).alias("error"))
    return common(rows, own, next(v for v in own.versions if v.name == version))


def stream_mgf(spark: SparkSession, folder: str) -> DataFrame:
    return spectra.mgf_records(spark.readStream.option("lineSep", "BEGIN IONS").text(folder))


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.records(spark.readStream.option("lineSep", "\n>").text(folder))
