"""mzTab files, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that the format requires of proteins and of peptide-spectrum matches.
REQUIRED = {
    "PRH": ["accession", "description", "taxid", "species", "database", "database_version", "search_engine", "ambiguity_members", "modifications"],
    "PSH": ["sequence", "psm_id", "accession", "unique", "database", "database_version", "search_engine", "modifications", "retention_time", "charge", "exp_mass_to_charge", "spectra_ref", "pre", "post", "start", "end"],
}


def _header(lines: DataFrame, kind: str) -> list[str]:
    found = lines.where(F.startswith("value", F.lit(kind + "\t"))).limit(1).collect()
    if not found:
        return []
    names = found[0]["value"].split("\t")[1:]
    missing = [c for c in REQUIRED[kind] if c not in names]
    if missing:
        raise ValueError(f"{kind} has no {', '.join(missing)}")
    return names


def _section(lines: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """values (map) and error of the lines of a kind; null is written as null."""
    own = lines.where(F.startswith("value", F.lit(kind + "\t"))).select(F.split("value", "\t").alias("f_"))
    keys = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    texts = F.transform(F.slice("f_", F.lit(2), F.size("f_")), lambda x: F.when(~x.isin("null", ""), x))
    error = F.when(F.size("f_") != len(names) + 1, F.lit("another number of columns than in the header"))
    return own.select(F.when(error.isNull(), F.map_from_arrays(keys, texts)).alias("values"), error.alias("error"))


def read_mztab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """metadata (key, value); proteins; psms, with `protein` (description, species, database; null where the accession is none of them).
    Of several proteins of an accession the one with the least description counts."""
    lines = spark.read.text(path).where("value <> ''")
    parts = F.split("value", "\t", 3)
    metadata = lines.where(F.startswith("value", F.lit("MTD\t"))).select(parts[1].alias("key"), F.get(parts, F.lit(2)).alias("value"))
    proteins = _section(lines, "PRT", _header(lines, "PRH"))
    proteins = proteins.where("error is null").select(*(F.col("values")[c].alias(c) for c in REQUIRED["PRH"]), "values").groupBy("accession").agg(F.min_by(F.struct("description", "species", "database", "values"), F.col("description")).alias("p")).select("accession", "p.*")
    psms = _section(lines, "PSM", _header(lines, "PSH"))
    value = F.col("values")
    out = psms.select(*(value[c].alias(c) for c in REQUIRED["PSH"]), _confidence(value).alias("confidence"), "values", "error")
    out = out.withColumns({"charge": F.col("charge").try_cast("int"), "exp_mass_to_charge": F.col("exp_mass_to_charge").try_cast("double"), "rt_s": F.split("retention_time", r"\|")[0].try_cast("double"), "unique": F.col("unique") == "1", "start": F.col("start").try_cast("int"), "end": F.col("end").try_cast("int")})
    known = proteins.select("accession", F.struct("description", "species", "database").alias("protein"))
    return metadata, proteins, out.join(known, "accession", "left")


def _confidence(values: Column) -> Column:
    """Mean of the search engines' scores, a missing one as 0, inside -1 to 1."""
    scores = F.filter(F.map_entries(values), lambda e: F.startswith(e["key"], F.lit("search_engine_score")))
    total = F.aggregate(scores, F.lit(0.0), lambda acc, e: acc + F.coalesce(e["value"].try_cast("double"), F.lit(0.0)))
    return F.when(F.size(scores) > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.size(scores))))


def mztab_lines(metadata: list[tuple[str, str]], proteins: DataFrame, psms: DataFrame) -> DataFrame:
    """value, section, row: all lines of a file, in the order section, row. Proteins are unique by accession; each file that spectra
    come from (spectra_file) is an ms_run, numbered in order of its name. psms: REQUIRED columns but spectra_ref, spectra_file and spectra_id instead.
    """
    spark = psms.sparkSession
    runs = psms.select("spectra_file").where("spectra_file is not null").distinct().orderBy("spectra_file").collect()  # files, not rows
    head = [("mzTab-version", "1.0.0"), ("mzTab-mode", "Summary"), ("mzTab-type", "Identification"), *metadata]
    head += [(f"ms_run[{k}]-location", r["spectra_file"]) for k, r in enumerate(runs, 1)]
    rows = [(f"MTD\t{k}\t{v}", 0, i) for i, (k, v) in enumerate(head)]
    rows += [("PRH\t" + "\t".join(REQUIRED["PRH"]), 1, 0), ("PSH\t" + "\t".join(REQUIRED["PSH"]), 3, 0)]
    numbers = spark.createDataFrame([(r["spectra_file"], f"ms_run[{k}]:") for k, r in enumerate(runs, 1)], "spectra_file string, run_ string")
    own = psms.join(numbers, "spectra_file", "left").withColumn("spectra_ref", F.concat("run_", "spectra_id")).drop("run_")

    def line(kind: str, names: list[str], table: DataFrame) -> Column:
        texts = (F.coalesce(F.col(c).cast("string"), F.lit("null")) if c in table.columns else F.lit("null") for c in names)
        return F.concat_ws("\t", F.lit(kind), *texts)

    rest = [c for c in proteins.columns if c != "accession"]
    once = proteins.groupBy("accession").agg(F.min(F.struct(*rest)).alias("p_")).select("accession", "p_.*") if rest else proteins.distinct()
    body = once.select(line("PRT", REQUIRED["PRH"], once).alias("value"), F.lit(2).alias("section"), F.monotonically_increasing_id().alias("row"))
    body = body.union(own.select(line("PSM", REQUIRED["PSH"], own).alias("value"), F.lit(4).alias("section"), F.monotonically_increasing_id().alias("row")))
    return spark.createDataFrame(rows, "value string, section int, row long").union(body)


def write_mztab(metadata: list[tuple[str, str]], proteins: DataFrame, psms: DataFrame, path: str) -> None:
    """A folder of files whose names are in the order of their lines; together they are one mzTab file."""
    mztab_lines(metadata, proteins, psms).orderBy("section", "row").select("value").write.text(path)
