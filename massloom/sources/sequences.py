"""FASTA files and their identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefixes of identifiers and what their parts are.
PREFIXES = {
    "lcl": "local", "bbs": "backbone_seqid", "bbm": "backbone_moltype", "gim": "import_id", "gi": "integrated", "gb": "genbank", "emb": "embl", "pir": "pir", "sp": "swissprot",
    "tr": "trembl", "ref": "refseq", "gnl": "general", "dbj": "ddbj", "prf": "prf", "pdb": "pdb", "tpg": "tpg", "tpe": "tpe", "tpd": "tpd", "gpp": "pipeline", "nat": "named", "pat": "patent", "pgp": "pregrant",
}
LETTERS = "ARNDCQEGHILKMFPSTWYVBJZUOX"


def identifier(text: Column) -> Column:
    """Struct kind, accession, name, decoy of an identifier such as >rev_sp|P35900|K1C20_HUMAN."""
    plain = F.regexp_replace(F.trim(text), "^>", "")
    decoy = F.lower(plain).startswith("rev_")
    plain = F.regexp_replace(plain, "^(?i:rev_)", "")
    parts = F.split(plain, r"\|")
    kinds = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    kind = F.coalesce(F.element_at(kinds, F.lower(parts[0])), F.lit("undefined"))
    known = (kind != "undefined") & (F.size(parts) > 1)
    # pat and pgp have a country before the number; pdb's second part is the chain
    last = F.lower(parts[0]).isin("pat", "pgp", "gnl", "gi", "lcl", "bbs", "bbm", "gim")
    accession = F.when(known & last, F.array_join(F.slice(parts, 2, 3), "|")).when(known, F.get(parts, F.lit(1))).otherwise(plain)
    name = F.when(known & ~last & (F.size(parts) > 2) & (F.get(parts, F.lit(2)) != ""), F.get(parts, F.lit(2)))
    return F.struct(F.when(known, kind).otherwise("undefined").alias("kind"), accession.alias("accession"), name.alias("name"), decoy.alias("decoy"))


def records(lines: DataFrame) -> DataFrame:
    """Records of text that was read with lineSep '\\n>': id_kind, accession, name, decoy, description, tags, regions, annotations (of positions from 0), sequence, error."""
    text = lines.select(F.regexp_replace("value", "^>", "").alias("r")).where("trim(r) <> ''")
    head = F.regexp_replace(F.split("r", r"\r?\n", 2)[0], r"\s+$", "")
    body = F.upper(F.regexp_replace(F.coalesce(F.get(F.split("r", r"\r?\n", 2), F.lit(1)), F.lit("")), r"\s+", ""))
    out = text.select(head.alias("header"), body.alias("sequence"))
    first = F.split("header", r"\s+", 2)
    rest = F.coalesce(F.get(first, F.lit(1)), F.lit(""))
    tag = r"(?:^|\s)([A-Za-z_]+)=(.*?)(?=\s+[A-Za-z_]+=|$)"
    keys, values = F.regexp_extract_all(rest, F.lit(tag), F.lit(1)), F.transform(F.regexp_extract_all(rest, F.lit(tag), F.lit(2)), lambda x: F.trim(x))
    # of a tag that comes twice the first counts
    once = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda k: F.array_position(keys, F.get(keys, k)) == k + 1)
    once = F.when(F.size(keys) > 0, once).otherwise(F.array().cast("array<int>"))
    tags = F.map_from_arrays(F.transform(once, lambda k: F.upper(F.get(keys, k))), F.transform(once, lambda k: F.get(values, k)))
    out = out.select(identifier(first[0]).alias("i"), F.trim(F.regexp_replace(rest, r"(?s)(^|\s)[A-Za-z_]+=.*$", "")).alias("description"), tags.alias("tags"), "sequence")
    item = F.split(F.element_at("tags", "REGIONS"), ";")
    parsed = F.transform(item, lambda x: F.struct(F.split(x, ":")[0].alias("region"), F.get(F.split(x, ":"), F.lit(1)).try_cast("int").alias("length")))
    out = out.withColumn("regions", F.coalesce(parsed, F.array(F.struct(F.lit("all").alias("region"), F.length("sequence").alias("length")))))
    note = F.split(F.coalesce(F.element_at("tags", "ANNOTATIONS"), F.lit("")), ";")
    notes = F.transform(F.filter(note, lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[0].alias("annotation"), F.get(F.split(x, ":"), F.lit(1)).try_cast("int").alias("position")))
    out = out.withColumn("annotations", notes)
    outside = F.exists("annotations", lambda a: a["position"].isNull() | (a["position"] < 0) | (a["position"] >= F.length("sequence")))
    total = F.aggregate("regions", F.lit(0), lambda acc, x: acc + F.coalesce(x["length"], F.lit(0)))
    error = F.when(F.rlike("sequence", F.lit(f"[^{LETTERS}*]")), F.lit("no amino acid")).when(total != F.length("sequence"), F.lit("regions do not fill the sequence")).when(outside, F.lit("an annotation is outside of the sequence"))
    return out.select(F.col("i.kind").alias("id_kind"), "i.accession", "i.name", "i.decoy", F.nullif("description", F.lit("")).alias("description"), "tags", "regions", "annotations", F.regexp_replace("sequence", r"\*$", "").alias("sequence"), error.alias("error"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return records(spark.read.text(path, lineSep="\n>"))
