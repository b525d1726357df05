"""Glycan structures: trees of sugars, and the fragments that breaking their bonds gives.

A structure is read from its condensed notation (the sugar that is bound to the peptide last, branches in square brackets, links in round ones) into an array of
nodes in which a parent comes before its children. What breaking bonds leaves are connected parts of the tree. They may be exponentially many, but what is measured is their
composition: from the leaves to the root, each node gets the compositions of all connected parts that begin there, each with its number of broken bonds and
the number of parts that are so. Branches are folded in one by one, so the work follows the number of distinct compositions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.chemistry import formula_mass, parse_formula
from massloom.functions.modifications import SUGARS
from massloom.functions.text import of_distinct
from massloom.session import spread

#: Short names of sugars in structures and the classes of equal mass that they are of.
NAMES = {
    "Man": "Hex", "Gal": "Hex", "Glc": "Hex", "Hex": "Hex", "All": "Hex", "Tal": "Hex",
    "GlcNAc": "HexNAc", "GalNAc": "HexNAc", "ManNAc": "HexNAc", "HexNAc": "HexNAc",
    "Fuc": "dHex", "Rha": "dHex", "Qui": "dHex", "dHex": "dHex",
    "Xyl": "Pent", "Ara": "Pent", "Rib": "Pent", "Pent": "Pent",
    "GlcA": "HexA", "GalA": "HexA", "IdoA": "HexA", "HexA": "HexA",
    "GlcN": "HexN", "GalN": "HexN", "ManN": "HexN", "HexN": "HexN",
    "Neu5Ac": "NeuAc", "NeuAc": "NeuAc", "Neu5Gc": "NeuGc", "NeuGc": "NeuGc",
}
_NAME = re.compile("|".join(sorted(map(re.escape, NAMES), key=len, reverse=True)))
_LINK = re.compile(r"\([^()\[\]]*\)|\([^()\[\]]*$")
NODES = "array<struct<sugar:string,parent:int>>"


def read_structure(text: str) -> list[tuple[str, int]]:
    """The sugars of a structure and their parents' places (-1: the one at the peptide, which is first)."""
    out: list[tuple[str, int]] = []

    def part(at: int, closing: bool) -> tuple[list, int]:
        """A chain of sugars, each with the branches that stand before it, up to a bracket or the end."""
        chain: list[tuple[str, list]] = []
        branches: list = []
        while at < len(text):
            if text[at] == "]":
                if not closing:
                    raise ValueError(f"] without [ in {text!r} at {at}")
                break
            if text[at] == "[":
                inner, at = part(at + 1, True)
                if at >= len(text):
                    raise ValueError(f"[ without ] in {text!r}")
                branches.append(inner)
                at += 1
                continue
            m = _NAME.match(text, at)
            if not m:
                raise ValueError(f"no sugar in {text!r} at {at}")
            chain.append((m[0], branches))
            branches, at = [], m.end()
            if link := _LINK.match(text, at):
                at = link.end()
        if not chain or branches:
            raise ValueError(f"a branch or chain without its sugar in {text!r}")
        return chain, at

    def place(chain: list, parent: int) -> None:
        for sugar, branches in reversed(chain):
            out.append((sugar, parent))
            parent = len(out) - 1
            for b in branches:
                place(b, parent)

    place(part(0, False)[0], -1)
    return out


def write_structure(nodes: list[tuple[str, int]]) -> str:
    """The notation without links; of a node's branches the last one continues its chain."""
    below: list[list[int]] = [[] for _ in nodes]
    for k, (_, parent) in enumerate(nodes):
        if parent >= 0:
            below[parent].append(k)
    done = [""] * len(nodes)
    for k in reversed(range(len(nodes))):
        own = [done[c] for c in below[k]]
        done[k] = "".join(own[-1:] + [f"[{x}]" for x in own[:-1]]) + nodes[k][0]
    return done[0] if nodes else ""


def composition_of(nodes: list[tuple[str, int]]) -> dict[str, int]:
    return dict(Counter(NAMES[s] for s, _ in nodes))


def part_compositions(nodes: list[tuple[str, int]]) -> list[Counter]:
    """For each node, of the connected parts whose highest node it is: (composition, broken bonds below) and how many there are."""
    kinds = sorted({NAMES[s] for s, _ in nodes})
    own: list[Counter] = []
    for s, _ in nodes:
        own.append(Counter({(tuple(int(k == NAMES[s]) for k in kinds), 0): 1}))
    for k in reversed(range(1, len(nodes))):
        parent = own[nodes[k][1]]
        joined: Counter = Counter()
        for (counts, breaks), n in parent.items():
            joined[counts, breaks + 1] += n  # the branch is broken off
            for (more, below), m in own[k].items():
                joined[tuple(x + y for x, y in zip(counts, more)), breaks + below] += n * m
        own[nodes[k][1]] = joined
    return [Counter({("".join(f"{kinds[x]}{n}" for x, n in enumerate(counts) if n), breaks): n for (counts, breaks), n in c.items()}) for c in own]


def structures(text: Column | str) -> Column:
    """Struct of nodes (sugar, parent), composition and error of structure texts; null stays null."""

    def one(t: str) -> dict:
        try:
            nodes = read_structure(t)
        except ValueError as e:
            return {"nodes": None, "composition": None, "error": str(e)}
        counts = composition_of(nodes)
        return {"nodes": [{"sugar": s, "parent": p} for s, p in nodes], "composition": "".join(f"{k}{n}" for k, n in sorted(counts.items())), "error": None}

    @F.pandas_udf(f"nodes {NODES}, composition string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([one(t) if t is not None else dict.fromkeys(("nodes", "composition", "error")) for t in s], columns=["nodes", "composition", "error"])

    return run(text)


def structure_texts(nodes: Column | str) -> Column:
    """The notation of arrays of nodes (sugar, parent)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda own: write_structure([(x["sugar"], x["parent"]) for x in own]), na_action="ignore")

    return run(nodes)


def structure_fragments(glycans: DataFrame, column: str = "glycan", peptide_mass: str | None = None, by_node: bool = True) -> DataFrame:
    """glycans and `ion`, `node`, `part`, `breaks`, `ways`, `neutral`, `error`: what breaking any bonds of a structure gives.

    B: parts whose highest bond is broken, with any further breaks (internal ones have some): node is the place of their highest sugar, from 0 at the peptide. Y (where a peptide
    mass is given): the peptide with what is left of the tree, with a break at least; with part '' and one break the whole glycan is gone. part: composition by classes of
    equal mass; ways: how many different parts have it. Without by_node, those of all nodes are one row (node is null). neutral: sugars as residues. A text that is no structure gives one row with `error`; null gives none.
    """
    masses = {k: formula_mass(parse_formula(f)) for k, f in SUGARS.items()}
    names = ("ion", "node", "part", "breaks", "ways", "mass", "error")

    def weight(part: str) -> float:
        return sum(masses[m[0]] * int(m[1]) for m in re.findall(r"([A-Za-z]+)(\d+)", part))

    def one(text: str | None) -> list[dict] | None:
        if text is None:
            return None
        try:
            found = part_compositions(read_structure(text))
        except ValueError as e:
            return [dict.fromkeys(names) | {"error": str(e)}]
        out = [("Y", None, "", 1, 1, 0.0, None)] if peptide_mass else []
        if not by_node:
            for (part, breaks), ways in sum(found, Counter()).items():
                out.append(("B", None, part, breaks, ways, weight(part), None))
            out += [("Y", None, part, breaks, ways, weight(part), None) for (part, breaks), ways in found[0].items() if peptide_mass and breaks]
            return [dict(zip(names, x)) for x in out]
        for node, own in enumerate(found):
            for (part, breaks), ways in own.items():
                mass = weight(part)
                out.append(("B", node, part, breaks, ways, mass, None))
                if peptide_mass and not node and breaks:
                    out.append(("Y", node, part, breaks, ways, mass, None))
        return [dict(zip(names, x)) for x in out]

    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.string())

    @F.arrow_udf("array<struct<ion:string,node:int,part:string,breaks:int,ways:long,mass:double,error:string>>")
    def run(texts: pa.Array) -> pa.Array:
        return of_distinct(texts, one, pa.list_(pa.struct(list(zip(names, kinds)))))

    own = spread(glycans).withColumn("f_", F.explode(run(column)))
    neutral = F.col("f_.mass") + (F.when(F.col("f_.ion") == "Y", F.col(peptide_mass)).otherwise(0.0) if peptide_mass else 0.0)
    return own.select(*glycans.columns, *(F.col(f"f_.{c}").alias(c) for c in names[:5]), neutral.alias("neutral"), F.col("f_.error").alias("error"))
