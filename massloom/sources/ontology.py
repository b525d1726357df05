"""Ontologies as graphs: ancestors of all terms, and the typed rows of protein modification, cross-linker and glycan vocabularies (OBO).

Everything is columns over the terms that `vocabulary.read_obo` gives; the closure goes from the roots down, so that each term takes over its parents' ancestors once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.chemistry import ELEMENTS, map_mass
from massloom.functions.formulas import formulas
from massloom.session import scratch
from massloom.sources.vocabulary import property_values

FORMULA = "map<string,int>"


def edges(terms: DataFrame) -> DataFrame:
    """child, parent of all is_a tags."""
    return terms.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).distinct()


def closure(links: DataFrame, levels: int = 64) -> DataFrame:
    """id, ancestor, distance: everything that can be reached from each child of links (child, parent), by the shortest way.

    Terms are taken level by level from the roots: one all of whose parents are done takes over their ancestors, so each of its ways is made once. A term's ancestors are a row
    until the end. What isn't done after `levels` levels (terms on rings, which are ancestors of themselves, those below them and very deep ones) is closed among itself by doubling
    the ways and then takes over the ancestors of the parents that are done. Each round is a written table.
    """
    spark, root = links.sparkSession, scratch(links.sparkSession)
    turn = 0

    def save(t: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        t.write.parquet(f"{root}/{turn:04}")
        return spark.read.schema(t.schema).parquet(f"{root}/{turn:04}")

    links = save(links.select("child", "parent").where("child is not null").distinct())
    kind = links.schema["child"].dataType.simpleString()
    done: list[DataFrame] = []
    # links of children that are not done, whose parents are names
    waiting, names = links, links.select(F.col("child").alias("parent")).distinct()
    for _ in range(levels):
        if not waiting.limit(1).count():
            break
        still = save(waiting.join(names, "parent", "left_semi"))
        names = still.select(F.col("child").alias("parent")).distinct()
        ready = waiting.join(still.select("child").distinct(), "child", "left_anti").select("child").distinct()
        if not ready.limit(1).count():  # only rings and what is below them is left
            break
        done.append(save(_taken_over(links.join(ready, "child"), _rows(done), kind)))
        waiting = still
    found = [t.select("id", F.explode(F.arrays_zip("ancestors", "distances")).alias("a")).select("id", F.col("a.ancestors").alias("ancestor"), F.col("a.distances").alias("distance")) for t in ([_rows(done)] if done else [])]
    if waiting.limit(1).count():
        rest = waiting.select(F.col("child").alias("id")).distinct()
        inner = save(_doubled(links.join(rest.select(F.col("id").alias("child")), "child", "left_semi").join(rest.select(F.col("id").alias("parent")), "parent", "left_semi"), save))
        own = inner.unionAll(rest.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))
        outer = links.join(rest.select(F.col("id").alias("child")), "child", "left_semi").join(rest.select(F.col("id").alias("parent")), "parent", "left_anti")
        up = own.join(outer.select(F.col("child").alias("ancestor"), F.col("parent").alias("beyond")), "ancestor").select("id", F.col("beyond").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        up = save(up.groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
        if found:
            further = found[0].select(F.col("id").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("distance").alias("more"))
            far = up.join(further, "ancestor").select("id", F.col("beyond").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
            up = up.unionAll(far).groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))
        found += [inner, up]
    if not found:
        return links.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out = found[0]
    for t in found[1:]:
        out = out.unionAll(t)
    return out


def _rows(done: list[DataFrame]) -> DataFrame | None:
    out = None
    for t in done:
        out = t if out is None else out.unionAll(t)
    return out


def _taken_over(links: DataFrame, known: DataFrame | None, kind: str) -> DataFrame:
    """id, ancestors, distances of each child of links (child, parent): its parents and what they have in known, by the shortest way."""
    if known is None:
        each = links.select("child", F.array("parent").alias("a"), F.array(F.lit(1)).alias("d"))
    else:
        met = links.join(known.withColumnRenamed("id", "parent"), "parent", "left")
        none = F.array().cast(f"array<{kind}>")
        each = met.select("child", F.concat(F.array("parent"), F.coalesce("ancestors", none)).alias("a"), F.concat(F.array(F.lit(1)), F.coalesce(F.transform("distances", lambda d: d + 1), F.array().cast("array<int>"))).alias("d"))
    own = each.groupBy("child").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("d")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("a")
            row, names = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            codes, far = pc.dictionary_encode(names).indices.to_numpy(), b.column("d").flatten().to_numpy()
            order = np.lexsort((far, codes, row))
            first = np.ones(len(order), bool)
            first[1:] = (row[order][1:] != row[order][:-1]) | (codes[order][1:] != codes[order][:-1])
            kept = order[first]
            ends = pa.array(np.searchsorted(row[kept], np.arange(len(b) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("child"), pa.ListArray.from_arrays(ends, names.take(pa.array(kept))), pa.ListArray.from_arrays(ends, pa.array(far[kept], pa.int32()))], ["id", "ancestors", "distances"])

    return own.mapInArrow(run, f"id {kind}, ancestors array<{kind}>, distances array<int>")


def _doubled(links: DataFrame, save) -> DataFrame:
    """The closure of links by doubling: after each round ways twice as long are known, so rounds grow with the logarithm of the depth. Only ways that a round has found or shortened are carried on."""
    known = fresh = save(links.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    while fresh.limit(1).count():
        onward = lambda t: t.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("distance").alias("more"))
        far = fresh.join(onward(known), "ancestor").unionAll(known.join(onward(fresh), "ancestor"))
        far = far.groupBy("id", F.col("beyond").alias("ancestor")).agg(F.min(F.col("distance") + F.col("more")).alias("distance"))
        old = known.select("id", "ancestor", F.col("distance").alias("old"))
        fresh = save(far.join(old, ["id", "ancestor"], "left").where("old is null or distance < old").drop("old"))
        known = save(known.unionAll(fresh).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
    return known


def spaced_formula(text: Column) -> Column:
    """Counts by element of such as `C 2 H -1 (13)C 3` or `C8 H10 O2 D-4`; null where something else is in it. Elements of count 0 are left out."""
    one = r"\(?([0-9]*)\)?([A-Z][a-z]?) ?(-?[0-9]+)? *"
    clean = F.regexp_replace(text, r'^"|"$', "")
    names = F.zip_with(F.regexp_extract_all(clean, F.lit(one), F.lit(1)), F.regexp_extract_all(clean, F.lit(one), F.lit(2)), lambda a, b: F.concat(a, b))
    counts = F.transform(F.regexp_extract_all(clean, F.lit(one), F.lit(3)), lambda x: F.when(x == "", F.lit(1)).otherwise(x.try_cast("int")))
    pairs = F.arrays_zip(names.alias("k"), counts.alias("n"))
    keys = F.array_distinct(names)
    total = F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0), lambda acc, p: acc + p["n"])))
    return F.when(F.rlike(clean, F.lit(f"^({one})+$")), F.map_filter(total, lambda _, n: n != 0))


def _tags(tag: str, head: str) -> Column:
    """Values of a tag that begin with `head`, without it."""
    own = F.filter("tags", lambda t: (t["tag"] == tag) & F.startswith(t["value"], F.lit(head)))
    return F.transform(own, lambda t: F.trim(F.substring(t["value"], F.lit(len(head) + 1), F.length(t["value"]))))


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, r'^"|"$', "")


def psi_mod(terms: DataFrame) -> DataFrame:
    """id, name, formula (the difference), delta, charge, rules (residues, position), cross_linked, obsolete, error of protein modification terms.

    Origins become rules: a residue each, at the term's place (N-term, C-term or anywhere); X is any residue. Several origins, or a comment that says so, are
    residues that are linked: then cross_linked is their number. error: a formula, charge or origin that can't be read.
    """
    one = lambda head: F.nullif(_unquoted(F.try_element_at(_tags("xref", head), F.lit(1))), F.lit("none"))
    raw = terms.where("stanza = 'Term'").select("id", "name", "obsolete", one("DiffFormula:").alias("f"), one("FormalCharge:").alias("c"), one("Origin:").alias("o"), one("TermSpec:").alias("t"), _tags("comment", "").alias("comments"))
    place = F.when(F.col("t") == "N-term", "any_n_term").when(F.col("t") == "C-term", "any_c_term").otherwise("anywhere")
    origins = F.transform(F.split("o", ","), lambda x: F.trim(x))
    rules = F.transform(F.filter(origins, lambda x: x.rlike("^[A-Z]$")), lambda x: F.struct(F.when(x == "X", F.array().cast("array<string>")).otherwise(F.array(x)).alias("residues"), place.alias("position")))
    formula, sign = spaced_formula(F.col("f")), F.when(F.endswith("c", F.lit("-")), -1).otherwise(1)
    charge = F.when(F.rlike("c", F.lit("^[0-9]+[+-]$")), F.regexp_extract("c", "^([0-9]+)", 1).cast("int") * sign)
    linked = F.regexp_extract(F.lower(F.array_join("comments", ";")), r"cross-link ([0-9]+)", 1).try_cast("int")
    bad = F.when(F.col("f").isNotNull() & formula.isNull(), F.concat(F.lit("no formula: "), "f")).when(F.col("c").isNotNull() & charge.isNull(), F.concat(F.lit("no charge: "), "c"))
    bad = F.coalesce(bad, F.when(linked.isNotNull() & (linked != F.size(origins)), F.concat(F.lit("as many origins as linked sites expected: "), F.coalesce("o", F.lit("none")))))
    out = raw.select("id", "name", formula.alias("formula"), charge.alias("charge"), F.array_distinct(rules).alias("rules"), F.coalesce(linked, F.when(F.size(origins) > 1, F.size(origins))).alias("cross_linked"), "obsolete", bad.alias("error"))
    return out.select("id", "name", "formula", map_mass(F.col("formula")).alias("delta"), *out.columns[3:])


def _sites(text: Column) -> Column:
    """Sides of such as (K,Protein N-term)&(E,D) as arrays of rules."""
    where = {"Protein N-term": "protein_n_term", "Protein C-term": "protein_c_term", "N-term": "any_n_term", "C-term": "any_c_term"}

    def rule(x: Column) -> Column:
        position = F.lit("anywhere")
        for k, v in where.items():
            position = F.when(x == k, v).otherwise(position)
        return F.struct(F.when(F.length(x) == 1, F.array(x)).otherwise(F.array().cast("array<string>")).alias("residues"), position.alias("position"))

    sides = F.split(text, r"\)\s*&\s*\(")
    return F.transform(sides, lambda s: F.transform(F.split(F.regexp_replace(s, r"[()]", ""), ","), lambda x: rule(F.trim(x))))


def xl_mod(terms: DataFrame) -> DataFrame:
    """id, name, sites, length, formula, delta, sides, asymmetric, obsolete of cross-linker terms; properties that a term doesn't have itself are its nearest ancestor's.

    Of several nearest ancestors, the one of least id counts. formula: of the bridge, or of a dead end. sides: for each side the rules (residues, position) where it binds. Terms without a number of sites are left out.
    """
    own = terms.where("stanza = 'Term'")
    values = property_values(own).where(F.col("property").isin("reactionSites", "spacerLength", "monoIsotopicMass", "bridgeFormula", "deadEndFormula", "specificities"))
    up = closure(edges(own)).unionAll(own.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))
    met = up.join(values.select(F.col("id").alias("ancestor"), "property", "value"), "ancestor")
    best = met.groupBy("id", "property").agg(F.min(F.struct("distance", "ancestor", "value")).alias("b"))
    names = ["reactionSites", "spacerLength", "monoIsotopicMass", "bridgeFormula", "deadEndFormula", "specificities"]
    wide = best.groupBy("id").agg(*(F.max(F.when(F.col("property") == p, F.col("b.value"))).alias(p) for p in names)).where("reactionSites is not null")
    formula = spaced_formula(F.coalesce("bridgeFormula", "deadEndFormula"))
    out = wide.join(own.select("id", "name", "obsolete"), "id").select("id", "name", F.col("reactionSites").try_cast("int").alias("sites"), F.col("spacerLength").try_cast("double").alias("length"), formula.alias("formula"), F.col("monoIsotopicMass").try_cast("double").alias("mass_"), _sites(F.col("specificities")).alias("sides"), "obsolete")
    return out.select("id", "name", "sites", "length", "formula", F.coalesce(map_mass(F.col("formula")), "mass_").alias("delta"), "sides", (F.size("sides") > 1).alias("asymmetric"), "obsolete")


#: Accessions of the glycan vocabulary's levels and properties.
GLYCAN_LEVELS = {"GNO:00000012": "average_weight", "GNO:00000013": "base_composition", "GNO:00000014": "composition", "GNO:00000015": "topology", "GNO:00000016": "saccharide"}
GLYCAN_PROPERTIES = {"level": "GNO:00000021", "base_composition_of": "GNO:00000033", "composition_of": "GNO:00000034", "topology_of": "GNO:00000035", "composition": "GNO:00000101", "score": "GNO:00000102", "other_name": "GNO:00000202"}


def gnome(terms: DataFrame) -> DataFrame:
    """id, name, level, weight, composition, composition_of, topology_of, score, other_name of glycan terms that have a parent.

    A weight stands in a term's name or else is that of its nearest ancestor that has one (of several, of the least id); a composition is the term's own or that of the term it names as such.
    """
    own = terms.where("stanza = 'Term'")
    values = property_values(own)
    wide = values.groupBy("id").agg(*(F.max(F.when(F.col("property") == a, F.col("value"))).alias(n) for n, a in GLYCAN_PROPERTIES.items()))
    weight = F.regexp_extract(F.coalesce("name", F.lit("")), r"(?:weight|mass)[^0-9]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    weighed = own.select("id", weight.alias("weight")).where("weight is not null")
    up = closure(edges(own)).unionAll(own.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))
    nearest = up.join(weighed.withColumnRenamed("id", "ancestor"), "ancestor").groupBy("id").agg(F.min(F.struct("distance", "ancestor", "weight")).alias("w")).select("id", "w.weight")
    level = F.lit(None).cast("string")
    for accession, name in GLYCAN_LEVELS.items():
        level = F.when(F.contains("level", F.lit(accession)), name).otherwise(level)
    out = own.where(F.size("parents") > 0).select("id", "name").join(wide, "id", "left").join(nearest, "id", "left")
    named = wide.select(F.col("id").alias("composition_of"), F.col("composition").alias("theirs")).where("theirs is not null")
    out = out.join(named, "composition_of", "left")
    return out.select("id", "name", level.alias("level"), "weight", F.coalesce("composition", "theirs").alias("composition"), "composition_of", "topology_of", F.col("score").try_cast("int").alias("score"), "other_name")


def known_elements(formula: Column) -> Column:
    """Whether all elements of a formula have a mass here."""
    return F.forall(F.map_keys(formula), lambda k: k.isin(*ELEMENTS))


def read_unimod(spark: SparkSession, path: str) -> DataFrame:
    """id, name, description, composition, formula, delta, rules (residues, position, losses), error of an XML file of modifications (umod:mod records).

    losses: masses of neutral losses of a rule, but those of 0. error: a composition that can't be read.
    """
    loss = "struct<_mono_mass:double,_composition:string>"
    schema = f"_title string, _full_name string, _record_id long, `umod:delta` struct<_mono_mass:double,_composition:string>, `umod:specificity` array<struct<_site:string,_position:string,`umod:NeutralLoss`:array<{loss}>>>"
    raw = spark.read.format("xml").option("rowTag", "umod:mod").schema(schema).load(path)
    positions = {"Any N-term": "any_n_term", "Any C-term": "any_c_term", "Protein N-term": "protein_n_term", "Protein C-term": "protein_c_term"}

    def rule(s: Column) -> Column:
        place = F.lit("anywhere")
        for k, v in positions.items():
            place = F.when(s["_position"] == k, v).otherwise(place)
        losses = F.transform(F.filter(F.coalesce(s["umod:NeutralLoss"], F.array().cast(f"array<{loss}>")), lambda x: x["_mono_mass"] != 0), lambda x: x["_mono_mass"])
        return F.struct(F.when(F.length(s["_site"]) == 1, F.array(s["_site"])).otherwise(F.array().cast("array<string>")).alias("residues"), place.alias("position"), losses.alias("losses"))

    delta = F.col("`umod:delta`")
    found = formulas(delta["_composition"], "unimod")
    out = raw.select(F.concat(F.lit("UNIMOD:"), "_record_id").alias("id"), F.col("_title").alias("name"), F.col("_full_name").alias("description"), delta["_composition"].alias("composition"), found.alias("f"), delta["_mono_mass"].alias("delta"), F.transform("`umod:specificity`", rule).alias("rules"))
    return out.select("id", "name", "description", "composition", F.col("f.formulas")[0]["formula"].alias("formula"), "delta", "rules", F.col("f.error").alias("error"))
