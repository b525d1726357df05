"""Vocabularies: OBO files and a cache of them, modification lists as JSON, germline tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def obo_stanzas(blocks: DataFrame) -> DataFrame:
    """Of text read with lineSep '\\n[': stanza (Term, Typedef, Instance), id, name, obsolete, synonyms, parents, tags."""
    body = blocks.select(F.regexp_replace("value", r"^\[", "").alias("b")).where(F.rlike("b", F.lit(r"^(Term|Typedef|Instance)\]")))
    # a comment starts at an exclamation mark behind white space, outside quotes
    plain = F.regexp_replace("b", r'(?m)[ \t]+!(?=[^"\n]*$)[^\n]*$', "")
    lines = F.filter(F.transform(F.split(plain, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z_-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^:]+):", 1).alias("tag"), F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1).alias("value")))
    out = body.select(F.regexp_extract("b", r"^(\w+)\]", 1).alias("stanza"), pairs.alias("tags"))

    def first(tag: str) -> Column:
        return F.try_element_at(F.transform(F.filter("tags", lambda t: t["tag"] == tag), lambda t: t["value"]), F.lit(1))

    def every(tag: str) -> Column:
        return F.transform(F.filter("tags", lambda t: t["tag"] == tag), lambda t: t["value"])

    synonyms = F.transform(every("synonym"), lambda v: F.regexp_extract(v, r'^"((?:[^"\\]|\\.)*)"', 1))
    return out.select("stanza", first("id").alias("id"), first("name").alias("name"), (F.coalesce(first("is_obsolete"), F.lit("")) == "true").alias("obsolete"), synonyms.alias("synonyms"), F.transform(every("is_a"), lambda v: F.split(v, r"\s+")[0]).alias("parents"), "tags")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    return obo_stanzas(spark.read.text(path, lineSep="\n["))


def property_values(terms: DataFrame) -> DataFrame:
    """id, property, value, type of property_value tags."""
    pairs = terms.select("id", F.explode(F.filter("tags", lambda t: t["tag"] == "property_value")).alias("t_"))
    text = F.col("t_.value")
    quoted = F.regexp_extract(text, r'^(\S+)\s+"((?:[^"\\]|\\.)*)"\s*(\S*)', 2)
    plain = F.regexp_extract(text, r"^\S+\s+(\S+)", 1)
    return pairs.select("id", F.regexp_extract(text, r"^(\S+)", 1).alias("property"), F.when(F.contains(text, F.lit('"')), quoted).otherwise(plain).alias("value"), F.nullif(F.regexp_extract(text, r'"\s+(\S+)\s*$', 1), F.lit("")).alias("type"))


def load_cached(spark: SparkSession, cache: str, sources: list[Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[str]]:
    """The table from its cache, else from the first source that works (then cached); what failed before that."""
    errors: list[str] = []
    try:
        return spark.read.parquet(cache), errors
    except Exception as e:
        errors.append(f"{cache}: {str(e).splitlines()[0]}")
    for source in sources:
        try:
            source().write.mode("overwrite").parquet(cache)
            return spark.read.parquet(cache), errors
        except Exception as e:
            errors.append(str(e).splitlines()[0])
    return None, errors


def read_custom_modifications(spark: SparkSession, path: str) -> DataFrame:
    """id, name, formula and rules of a JSON list of modifications."""
    return spark.read.option("multiLine", True).json(path)


_GENE = re.compile(r"(?:IG|TR)?(?P<chain>[HKLI])(?P<kind>[VJC]|[ADEGM])?(?P<gene>[^*]*)(?:\*(?P<number>\d+))?")


def gene_name(name: str) -> tuple[str, str, str, int | None]:
    """chain, kind (V, J, or C with the constant's letter), gene and allele number of such as IGHV3-23*01."""
    m = _GENE.fullmatch(name.strip())
    if not m or not m["kind"]:
        raise ValueError(f"no gene: {name!r}")
    kind = m["kind"] if m["kind"] in "VJC" else "C" + m["kind"]
    return m["chain"], kind, m["gene"], int(m["number"]) if m["number"] else None


def gene_parts(name: Column) -> Column:
    """gene_name as a struct chain, kind, gene, number; null where it is none."""
    pattern = r"^\s*(?:IG|TR)?([HKLI])([VJC]|[ADEGM])([^*]*)(?:\*(\d+))?\s*$"
    part = [F.regexp_extract(name, pattern, k) for k in range(1, 5)]
    kind = F.when(part[1].isin("V", "J", "C"), part[1]).otherwise(F.concat(F.lit("C"), part[1]))
    return F.when(F.rlike(name, F.lit(pattern)), F.struct(part[0].alias("chain"), kind.alias("kind"), part[2].alias("gene"), F.nullif(part[3], F.lit("")).cast("int").alias("number")))


def combine_germlines(genes: DataFrame) -> DataFrame:
    """One row per species, name and sequence; alleles of a gene in order of their number. genes: species, name, number, sequence, acc."""
    return genes.groupBy("species", "name", "number", "sequence").agg(F.min("acc").alias("acc")).orderBy("species", "name", "number")
