"""Theoretical fragment ions, of plain sequences and of modified, ambiguous and cross-linked ones."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions.chemistry import ELEMENTS, FORMULA, MONO, PROTON, WATER, formula_mass, parse_formula
from massloom.functions.masses import ladders
from massloom.functions.text import of_distinct
from massloom.session import spread

_H, _C, _N, _O = (ELEMENTS[e] for e in "HCNO")

#: Offsets of series to the sum of residues, as neutral fragments (N-terminal ones carry H, C-terminal ones OH).
N_TERMINAL = {"a": _H - (_C + _H + _O), "b": _H - _H, "c": _H + _N + 2 * _H}
C_TERMINAL = {"x": _O + _H + _C + _O - _H, "y": _O + _H + _H, "z": _O + _H - (_N + 2 * _H)}
IMMONIUM = -(_C + _O)
LOSSES = {"": 0.0, "-H2O": WATER, "-NH3": _N + 3 * _H}


@dataclass(frozen=True)
class Location:
    """Which positions of a series count: all but the whole length, fewer at the ends (skip), or only the first few (take)."""

    skip_n: int = 0
    skip_c: int = 0
    take: int | None = None

    def condition(self, index: str = "index", length: str = "length") -> Column:
        inside = (F.col(index) > self.skip_n) & (F.col(index) < F.col(length) - self.skip_c)
        return inside & (F.col(index) <= self.take) if self.take is not None else inside


@dataclass(frozen=True)
class Series:
    ion: str
    location: Location = Location()
    losses: tuple[str, ...] = ("",)
    variants: tuple[int, ...] = (0,)  # H more or fewer


@dataclass(frozen=True)
class FragmentModel:
    series: tuple[Series, ...]
    charges: tuple[int, ...] = (1,)
    precursor_losses: tuple[str, ...] = ("",)
    precursor: bool = False
    immonium: bool = False
    ppm: float = 20.0
    internal: tuple[int, int] | None = None


_WATER = ("", "-H2O")


def _all(ions: str, losses: tuple[str, ...] = _WATER, **variants: tuple[int, ...]) -> tuple[Series, ...]:
    return tuple(Series(i, losses=losses, variants=variants.get(i, (0,))) for i in ions)


#: Series, losses, hydrogens more or fewer, and other ions of the usual ways of fragmentation.
MODELS = {
    "none": FragmentModel(()),
    "all": FragmentModel(_all("abcxyz", ("", "-H2O", "-NH3")), (1, 2), _WATER, True, True, internal=(2, 20)),
    "cid": FragmentModel((Series("a", Location(take=1), _WATER), *_all("by")), (1, 2), _WATER, True, internal=(2, 200)),
    "etd": FragmentModel(_all("cyz", c=(-1, 0, 2), z=(-1, 0, 1, 2)), (1, 2), ("", "-H2O", "-NH3"), True, internal=(2, 200)),
    "etcid": FragmentModel((Series("a", Location(take=1)), *_all("bcyz", c=(0, 1), z=(0, 1))), (1, 2), _WATER, True, internal=(2, 200)),
    "ead": FragmentModel(_all("abcxyz", z=(0, 1)), (1, 2), _WATER, True, True),
    "eacid": FragmentModel(_all("abcxyz", z=(0, 1)), (1, 2), _WATER, True),
    "uvpd": FragmentModel(_all("abcxyz", ("",), a=(0, 1, 2), b=(0, 2), x=(-1, 0, 1, 2), y=(-2, -1, 0)), (1, 2), _WATER, True, True),
}


def combined(a: FragmentModel, b: FragmentModel) -> FragmentModel:
    """A model with all that either has: series of an ion and place are one, with the losses and variants of both."""
    every: dict[tuple[str, Location], Series] = {}
    for s in (*a.series, *b.series):
        have = every.get((s.ion, s.location))
        both = (s.losses, s.variants) if have is None else (tuple(dict.fromkeys(have.losses + s.losses)), tuple(sorted({*have.variants, *s.variants})))
        every[s.ion, s.location] = Series(s.ion, s.location, *both)
    inside = [m.internal for m in (a, b) if m.internal]
    internal = (min(x for x, _ in inside), max(y for _, y in inside)) if inside else None
    return FragmentModel(tuple(every.values()), tuple(sorted({*a.charges, *b.charges})), tuple(dict.fromkeys(a.precursor_losses + b.precursor_losses)), a.precursor or b.precursor, a.immonium or b.immonium, max(a.ppm, b.ppm), internal)


def residue_sums(sequence: Column | str) -> Column:
    """Struct of masses of the residues and their running sums; nulls for letters without a mass and all sums from there on."""

    def one(text: str | None) -> dict:
        if text is None:
            return {"masses": None, "sums": None}
        masses = [MONO.get(x) for x in text]
        known = next((k for k, m in enumerate(masses) if m is None), len(masses))
        return {"masses": masses, "sums": [*accumulate(masses[:known]), *[None] * (len(masses) - known)]}

    @F.arrow_udf("masses array<double>, sums array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return of_distinct(texts, one, pa.struct([("masses", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))]))

    return run(sequence)


def fragments(peptides: DataFrame, model: FragmentModel, key: list[str], sequence: str = "peptide") -> DataFrame:
    """key, length, ion, index (residues in it), position (of the last residue from the N-terminus), loss, variant, charge, neutral, mz.

    Prefix sums are made once for each sequence, in one pass, and serve all series; only the sequences are shuffled, so that the work is spread.
    """
    n = F.length(sequence)
    base = spread(peptides, *key).where(n > 0).select(*key, n.alias("length"), residue_sums(sequence).alias("r_"))
    base = base.select(*key, "length", F.col("r_.masses").alias("masses_"), F.col("r_.sums").alias("sums_")).withColumn("total_", F.element_at("sums_", -1))
    ladder = base.select(*key, "length", "total_", F.posexplode("sums_").alias("at_", "sum_")).withColumn("index_n", F.col("at_") + 1)
    out = None
    for s in model.series:
        forward = s.ion in N_TERMINAL
        offset = (N_TERMINAL | C_TERMINAL)[s.ion]
        own = ladder.withColumn("index", F.col("index_n") if forward else F.col("length") - F.col("index_n"))
        own = own.where(s.location.condition()).withColumn("sum_", F.col("sum_") if forward else F.col("total_") - F.col("sum_"))
        kinds = F.array(*(F.struct(F.lit(loss).alias("loss"), F.lit(v).alias("variant"), F.lit(offset - LOSSES[loss] + v * _H).alias("offset_")) for loss in s.losses for v in s.variants))
        own = own.select(*key, "length", F.lit(s.ion).alias("ion"), "index", F.when(F.lit(forward), F.col("index")).otherwise(F.col("length") - F.col("index") + 1).alias("position"), "sum_", F.explode(kinds).alias("k_"))
        own = own.select(*key, "length", "ion", "index", "position", "k_.loss", "k_.variant", (F.col("sum_") + F.col("k_.offset_")).alias("neutral"))
        out = own if out is None else out.unionByName(own)
    if model.precursor:
        own = base.select(*key, "length", F.lit("precursor").alias("ion"), F.col("length").alias("index"), F.lit(None).cast("int").alias("position"), "total_", F.explode(F.array(*(F.struct(F.lit(x).alias("loss"), F.lit(LOSSES[x]).alias("m_")) for x in model.precursor_losses))).alias("k_"))
        own = own.select(*key, "length", "ion", "index", "position", "k_.loss", F.lit(0).alias("variant"), (F.col("total_") + WATER - F.col("k_.m_")).alias("neutral"))
        out = own if out is None else out.unionByName(own)
    if model.immonium:
        own = base.select(*key, "length", F.posexplode("masses_").alias("at_", "mass_"))
        own = own.select(*key, "length", F.lit("immonium").alias("ion"), F.lit(1).alias("index"), (F.col("at_") + 1).alias("position"), F.lit("").alias("loss"), F.lit(0).alias("variant"), (F.col("mass_") + IMMONIUM).alias("neutral"))
        out = own if out is None else out.unionByName(own)
    if model.internal:
        lo, hi = model.internal
        starts = base.select(*key, "length", "sums_", F.posexplode("sums_").alias("at_", "sum_")).where((F.col("at_") >= 0) & (F.col("at_") < F.col("length") - 2))
        ends = F.filter(F.sequence(F.col("at_") + lo, F.least(F.col("at_") + hi, F.col("length") - 2)), lambda e: e >= F.col("at_") + lo)
        own = starts.where(F.col("at_") + lo <= F.col("length") - 2).select(*key, "length", "sum_", "sums_", "at_", F.explode(ends).alias("end_"))
        own = own.select(*key, "length", F.lit("internal").alias("ion"), (F.col("end_") - F.col("at_")).cast("int").alias("index"), (F.col("end_") + 1).cast("int").alias("position"), F.lit("").alias("loss"), F.lit(0).alias("variant"), (F.element_at("sums_", F.col("end_") + 1) - F.col("sum_")).alias("neutral"))
        out = own if out is None else out.unionByName(own)
    if out is None:  # a model without fragments
        out = base.select(*key, "length", F.lit("").alias("ion"), *(F.lit(0).alias(c) for c in ("index", "position")), F.lit("").alias("loss"), F.lit(0).alias("variant"), F.lit(0.0).alias("neutral")).limit(0)
    out = out.where("neutral > 0").withColumn("charge", F.explode(F.array(*(F.lit(z) for z in model.charges))))
    return out.withColumn("mz", (F.col("neutral") + F.col("charge") * F.lit(PROTON)) / F.col("charge"))


def label(ion: str = "ion", index: str = "index", loss: str = "loss", charge: str = "charge") -> Column:
    """Such as b3-H2O^2."""
    z = F.when(F.col(charge) > 1, F.concat(F.lit("^"), F.col(charge).cast("string"))).otherwise("")
    return F.concat(F.col(ion), F.when(F.col(ion) == "precursor", "").otherwise(F.col(index).cast("string")), F.col(loss), z)


def side_chain_losses() -> dict[str, list[float]]:
    """Mass of what a side chain loses behind its beta carbon, by residue: all but CH2, or one branch of a branched one.

    Residues without such a part, aromatic ones and proline have none.
    """

    def mass(text: str) -> float:
        return formula_mass(parse_formula(text))

    backbone = mass("C2H2NO") + mass("CH2")
    out = {aa: [formula_mass(parse_formula(FORMULA[aa])) - backbone] for aa in "RNDCQEKMLS"}
    return out | {"V": [mass("CH3")], "I": [mass("CH3"), mass("C2H5")], "T": [mass("OH"), mass("CH3")]}


def satellite_fragments(peptides: DataFrame, key: list[str], sequence: str = "peptide", charges: tuple[int, ...] = (1,)) -> DataFrame:
    """key, ion (d: a + H less a side-chain part of its last residue; w: z + H less one of its first), index, loss (which part, from 0), charge, mz."""
    masses = F.create_map(*(F.lit(x) for kv in MONO.items() for x in kv))
    lost = F.create_map(*(x for aa, m in side_chain_losses().items() for x in (F.lit(aa), F.array(*map(F.lit, m)))))
    own = peptides.where(F.length(sequence) > 1).select(*key, F.length(sequence).alias("n_"), F.posexplode(F.filter(F.split(sequence, ""), lambda x: x != "")).alias("at_", "aa_"))
    upto = Window.partitionBy(*key).orderBy("at_")
    own = own.withColumn("m_", F.element_at(masses, F.col("aa_"))).withColumn("before_", F.sum("m_").over(upto)).withColumn("total_", F.sum("m_").over(Window.partitionBy(*key)))
    own = own.select("*", F.posexplode(F.element_at(lost, F.col("aa_"))).alias("loss", "lost_"))
    d = own.where("at_ < n_ - 1").select(*key, F.lit("d").alias("ion"), (F.col("at_") + 1).alias("index"), "loss", (F.col("before_") + N_TERMINAL["a"] + _H - F.col("lost_")).alias("neutral"))
    w = own.where("at_ > 0").select(*key, F.lit("w").alias("ion"), (F.col("n_") - F.col("at_")).alias("index"), "loss", (F.col("total_") - F.col("before_") + F.col("m_") + C_TERMINAL["z"] + _H - F.col("lost_")).alias("neutral"))
    out = d.unionAll(w).withColumn("charge", F.explode(F.array(*(F.lit(z) for z in charges))))
    return out.withColumn("mz", (F.col("neutral") + F.col("charge") * F.lit(PROTON)) / F.col("charge")).drop("neutral")


def with_losses(fragments_: DataFrame, losses: dict[str, float]) -> DataFrame:
    """fragments (neutral, loss, charge) and each of them less every given neutral loss that leaves a positive mass."""
    kinds = F.array(F.struct(F.lit("").alias("name"), F.lit(0.0).alias("m")), *(F.struct(F.lit(n).alias("name"), F.lit(m).alias("m")) for n, m in losses.items()))
    out = fragments_.withColumn("k_", F.explode(kinds)).withColumn("neutral", F.col("neutral") - F.col("k_.m")).withColumn("loss", F.concat("loss", "k_.name")).drop("k_").where("neutral > 0")
    return out.withColumn("mz", (F.col("neutral") + F.col("charge") * F.lit(PROTON)) / F.col("charge"))


def cleaved_linkers(links: DataFrame, stubs: list[tuple[float, float]]) -> DataFrame:
    """links (mass_a, mass_b: neutral chains without the linker) and, for each way the linker breaks into two stubs, `neutral_a` and `neutral_b`; both ways round."""
    ways = sorted({w for a, b in stubs for w in ((a, b), (b, a))})
    kinds = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ways))
    out = links.withColumn("s_", F.explode(kinds))
    return out.withColumn("neutral_a", F.col("mass_a") + F.col("s_.a")).withColumn("neutral_b", F.col("mass_b") + F.col("s_.b")).drop("s_")


def modified_fragments(peptides: DataFrame, model: FragmentModel, key: list[str], sequence: str = "peptide", losses: dict[str, float] | None = None) -> DataFrame:
    """key, ion_index, chain, length, ion, index, inside, loss, variant, charge, neutral, mz, error: fragments of ProForma texts with modifications, open places and cross-links.

    Each text becomes one ladder of prefixes and suffixes in one pass, and every part of it meets the model's rules (series, places, losses, hydrogens, charges) of its side: an array
    of constants, so only the texts are shuffled, which spreads the work. losses: masses of loss names beside those known. inside: the open modifications that lie in the fragment. A text that can't be read gives one
    row with `error`; fragments that would have no mass are left out.
    """
    known = LOSSES | (losses or {})
    kind = "ion string, side string, loss string, variant int, offset double, skip_n int, skip_c int, take int".split(", ")
    names = [k.split()[0] for k in kind]
    rules = [
        (s.ion, "n" if s.ion in N_TERMINAL else "c", loss, v, (N_TERMINAL | C_TERMINAL)[s.ion] - known[loss] + v * _H, s.location.skip_n, s.location.skip_c, s.location.take)
        for s in model.series
        for loss in s.losses
        for v in s.variants
    ] + [("precursor", "whole", loss, 0, -known[loss], 0, -1, None) for loss in (model.precursor_losses if model.precursor else ())]
    table = F.array(*(F.struct(*(F.lit(x).cast(k.split()[1]).alias(n) for n, x, k in zip(names, r, kind))) for r in rules)) if rules else F.array().cast("array<struct<" + ",".join(k.replace(" ", ":") for k in kind) + ">>")
    own = spread(peptides, *key).select(*key, ladders(sequence).alias("l_")).select(*key, F.explode_outer("l_.parts").alias("p_"), F.col("l_.error").alias("error"))
    index, length = F.col("p_.index"), F.col("p_.length")
    fits = lambda r: (r["side"] == F.col("p_.side")) & (index > r["skip_n"]) & (index < length - r["skip_c"]) & (r["take"].isNull() | (index <= r["take"]))
    out = own.select(*key, "p_", "error", F.explode_outer(F.when(F.col("error").isNull(), F.filter(table, fits))).alias("r_")).where("error is not null or r_ is not null")
    neutral = F.col("p_.mass") + F.col("r_.offset")
    out = out.select(
        *key, F.col("p_.ion").alias("ion_index"), "p_.chain", "p_.length", F.col("r_.ion").alias("ion"), "p_.index", "p_.inside", "r_.loss", "r_.variant", neutral.alias("neutral"), "error"
    ).where("error is not null or neutral > 0")
    charges = F.when(F.col("error").isNull(), F.array(*map(F.lit, model.charges))).otherwise(F.array(F.lit(None).cast("int")))
    out = out.withColumn("charge", F.explode(charges))
    return out.withColumn("mz", (F.col("neutral") + F.col("charge") * F.lit(PROTON)) / F.col("charge"))
