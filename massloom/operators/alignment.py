"""Mass-based alignment of sequences: pairs, templates and consecutive genes. `alignment_batch` has the kernel of many pairs, `alignment_index` the best
templates, `profiles` multiple alignments.

Two sequences are aligned by dynamic programming with affine gaps. Besides a pair of residues, a step may hold a block of up
to `steps` residues of each side whose masses agree: a rotation if the residues are the same, else isobaric. Which blocks agree is
found for all places at once from running sums of masses, so that the loop over cells meets only blocks that do; it
runs as an Arrow-batched Python function, one row per pair of sequences.

Sequences are ProForma texts of one chain. B and Z have the masses of both of their residues; modifications add to their residue's mass, terminal ones
to the first and last one's, and a modification that only may be there (a label #...) gives masses with and without it.
Texts that are none, unknown modifications and nulls give a row with `error` and no alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions.chemistry import AMBIGUOUS, MONO, STANDARD
from massloom.functions.modifications import modification_mass
from massloom.functions.proforma import parse

#: Rows of the BLOSUM62 matrix for the residues A R N D C Q E G H I L K M F P S T W Y V.
_BLOSUM62 = """
4 -1 -2 -2 0 -1 -1 0 -2 -1 -1 -1 -1 -2 -1 1 0 -3 -2 0
-1 5 0 -2 -3 1 0 -2 0 -3 -2 2 -1 -3 -2 -1 -1 -3 -2 -3
-2 0 6 1 -3 0 0 0 1 -3 -3 0 -2 -3 -2 1 0 -4 -2 -3
-2 -2 1 6 -3 0 2 -1 -1 -3 -4 -1 -3 -3 -1 0 -1 -4 -3 -3
0 -3 -3 -3 9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1 1 0 0 -3 5 2 -2 0 -3 -2 1 0 -3 -1 0 -1 -2 -1 -2
-1 0 0 2 -4 2 5 -2 0 -3 -3 1 -2 -3 -1 0 -1 -3 -2 -2
0 -2 0 -1 -3 -2 -2 6 -2 -4 -4 -2 -3 -3 -2 0 -2 -2 -3 -3
-2 0 1 -1 -3 0 0 -2 8 -3 -3 -1 -2 -1 -2 -1 -2 -2 2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3 4 2 -3 1 0 -3 -2 -1 -3 -1 3
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4 -2 2 0 -3 -2 -1 -2 -1 1
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5 -1 -3 -1 0 -1 -3 -2 -2
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5 0 -2 -1 -1 -1 -1 1
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6 -4 -2 -2 1 3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7 -1 -1 -4 -3 -2
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4 1 -3 -2 -2
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5 -2 -2 0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11 2 -3
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7 -1
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
#: Rows of the same matrix for the letters that stand for two residues, over A R N D C Q E G H I L K M F P S T W Y V B Z J.
_STANDING = {
    "B": "-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4 1 -3",
    "Z": "-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4 -3",
    "J": "-1 -2 -3 -3 -1 -2 -3 -4 -3 3 3 -3 2 0 -3 -2 -1 -2 -1 2 -3 -3 3",
}


def _matrix() -> dict[tuple[str, str], int]:
    """All letters: U counts as C, O as K, and X has -1 with any other."""
    out = {(a, b): int(v) for a, row in zip(STANDARD, _BLOSUM62.strip().split("\n")) for b, v in zip(STANDARD, row.split())}
    for a, row in _STANDING.items():
        for b, v in zip(STANDARD + "BZJ", row.split()):
            out[a, b] = out[b, a] = int(v)
    known = {**{x: x for x in STANDARD + "BZJ"}, "U": "C", "O": "K"}
    out = {(a, b): out[x, y] for a, x in known.items() for b, y in known.items()}
    return out | {k: -1 for x in [*known, "X"] for k in ((x, "X"), ("X", x))}


def read_matrix(text: str) -> dict[tuple[str, str], int]:
    """A matrix in the usual text form (lines of #, a line of letters, then a letter and its scores a line); letters that it lacks score its least with all."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    if len(lines) < 2:
        raise ValueError("no matrix")
    letters, out = lines[0], {}
    for a, *scores in lines[1:]:
        if len(scores) != len(letters) or a not in letters:
            raise ValueError(f"{len(letters)} scores expected behind one of {''.join(letters)}: {a} {' '.join(scores)}")
        out |= {(a, b): int(v) for b, v in zip(letters, scores)}
    least = min(out.values())
    every = STANDARD + "BZJUOX"
    return {(a, b): out.get((a, b), out.get((b, a), least)) for a in every for b in every}


BLOSUM62 = _matrix()
IDENTITY = {(a, b): int(a == b) for a in STANDARD + "BZJUOX" for b in STANDARD + "BZJUOX"}


@dataclass(frozen=True)
class Ends:
    """For each end, whether the alignment must reach the end of both sequences, of a or b alone, of either one, or of none.

    On the right, reaching the end of a is reaching that of both: so are the recorded results of these types.
    """

    left: str = "both"
    right: str = "both"


TYPES = {
    "global": Ends(),
    "local": Ends("none", "none"),
    "either_global": Ends("either", "either"),
    "global_a": Ends("a", "a"),
    "global_b": Ends("b", "b"),
    "extend_a": Ends("b", "a"),
    "extend_b": Ends("a", "b"),
    "global_left": Ends("both", "none"),
    "global_right": Ends("none", "both"),
    "ragged_left": Ends("either", "both"),
    "ragged_right": Ends("both", "either"),
}


@dataclass(frozen=True)
class Scoring:
    mismatch: int = 0
    mass_mismatch: int = 0
    mass_base: int = 1
    rotated: int = 3
    isobaric: int = 2
    gap_start: int = -4
    gap_extend: int = -1
    ppm: float = 10.0
    #: Which side may carry modifications of its own: "same", "database_to_peptide" (b) or "peptide_to_database" (a).
    pair: str = "same"
    matrix: dict[tuple[str, str], int] = field(default_factory=lambda: BLOSUM62, hash=False)


@dataclass
class Alignment:
    start_a: int
    start_b: int
    path: list[tuple[str, int, int, int]]  # kind, residues of a, residues of b, score of the step
    score: int
    maximum: float

    @property
    def normalised(self) -> float:
        return min(1.0, self.score / self.maximum) if self.maximum else 0.0

    @property
    def cigar(self) -> str:
        """Runs of = X m I D with their length, and each block with its size: 2r, 3i, or 2:1i for sides of two and one."""
        out: list[list] = []
        for kind, n, m, _ in self.path:
            if kind in "=XmID" and out and out[-1][1] == kind:
                out[-1][0] += 1
            else:
                out.append([1 if kind in "=XmID" else n if n == m else f"{n}:{m}", kind])
        return "".join(f"{n}{k}" for n, k in out)


_STEP = re.compile(r"(\d+)(?::(\d+))?([=XmIDri])")


def read_cigar(text: str) -> list[tuple[str, int, int]]:
    """The steps (kind, residues of a, residues of b) that a cigar text stands for."""
    out: list[tuple[str, int, int]] = []
    at = 0
    while at < len(text):
        m = _STEP.match(text, at)
        if not m or (m[2] and m[3] != "i"):
            raise ValueError(f"no alignment path: {text!r} at {at}")
        n, at = int(m[1]), m.end()
        one = {"I": (0, 1), "D": (1, 0)}.get(m[3], (1, 1))
        out += [(m[3], n, int(m[2] or n))] if m[3] in "ri" else [(m[3], *one)] * n
    return out


@dataclass
class Residues:
    """letters; each one's modifications; each one's possible masses."""

    letters: str
    modifications: list[tuple[str, ...]]
    masses: list[list[float]]


def _options(letter: str) -> list[float]:
    return [MONO[x] for x in AMBIGUOUS[letter]] if letter in AMBIGUOUS else [MONO[letter]]


def residues(text: str) -> Residues:
    """Of a ProForma text of one chain."""
    if text and all(c in MONO or c in AMBIGUOUS for c in text):
        return Residues(text, [()] * len(text), [_options(c) for c in text])
    if not text:
        return Residues("", [], [])
    ions = parse(text)
    if len(ions) != 1 or len(ions[0].chains) != 1:
        raise ValueError("more than one chain")
    c = ions[0].chains[0]

    def mass(m: str) -> list[float]:
        known = modification_mass(m)
        if known is None and not m.startswith("#"):
            raise ValueError(f"no mass is known for {m}")
        return [0.0, known or 0.0] if "#" in m and not m.partition("#")[2].startswith("XL") else [known or 0.0]

    out = []
    for k, (letter, own) in enumerate(zip(c.residues, c.modifications)):
        masses = _options(letter)
        for m in [*own, *(c.n_term if k == 0 else []), *(c.c_term if k + 1 == len(c.residues) else [])]:
            masses = [x + y for x in masses for y in mass(m)]
        for m, rules in c.fixed:
            if letter in rules:
                masses = [x + y for x in masses for y in mass(m)]
        out.append(sorted(set(masses)))
    return Residues(c.sequence, [tuple(m) for m in c.modifications], out)


def _blocks(r: Residues, steps: int) -> list[list[list[float]]]:
    """For sizes 1 to steps, the possible masses of the block that ends at each residue from the size on."""
    out = [r.masses]
    for _ in range(1, min(steps, len(r.masses))):
        before = out[-1]
        out.append([sorted({x + y for x in before[k] for y in r.masses[k + len(out)]}) for k in range(len(before) - 1)])
    return out


def _agreeing(a: Residues, b: Residues, steps: int, ppm: float) -> tuple[np.ndarray, dict[tuple[int, int], list[tuple[int, int]]]]:
    """Which pairs of residues agree in mass, and by cell the larger blocks (sizes in a and b) that end there and agree."""
    blocks_a, blocks_b = _blocks(a, steps), _blocks(b, steps)
    single, found = np.zeros((len(a.letters), len(b.letters)), bool), {}
    for p, own in enumerate(blocks_a, 1):
        lo_a, hi_a = np.array([m[0] for m in own]), np.array([m[-1] for m in own])
        lo_a, hi_a, many_a = lo_a - np.abs(lo_a) * (ppm / 1e6), hi_a + np.abs(hi_a) * (ppm / 1e6), any(len(m) > 1 for m in own)
        for q, other in enumerate(blocks_b, 1):
            lo_b, hi_b = np.array([m[0] for m in other]), np.array([m[-1] for m in other])
            near = np.argwhere((lo_a[:, None] <= hi_b) & (lo_b <= hi_a[:, None]))
            if many_a or any(len(m) > 1 for m in other):  # ranges that overlap; now the masses themselves
                near = [(i, j) for i, j in near.tolist() if any(abs(x - y) <= abs(x) * ppm / 1e6 for x in own[i] for y in other[j])]
            else:
                near = near.tolist()
            for i, j in near:
                if p == q == 1:
                    single[i, j] = True
                else:
                    found.setdefault((i + p, j + q), []).append((p, q))
    return single, found


def align(a: str | Residues, b: str | Residues, kind: str = "global", scoring: Scoring = Scoring(), steps: int = 4) -> Alignment:
    """Kinds of steps: = equal, X mismatch, m the same residue of another mass, i isobaric, r rotated, I only in b, D only in a.

    Of equal scores a gap in b goes before one in a, gaps before pairs and pairs before blocks; of equal ends the last one counts.
    """
    a, b = residues(a) if isinstance(a, str) else a, residues(b) if isinstance(b, str) else b
    ends, n, m = TYPES[kind], len(a.letters), len(b.letters)
    single, blocks = _agreeing(a, b, steps, scoring.ppm) if n and m else (np.zeros((n, m), bool), {})
    single, gap, longer = single.tolist(), scoring.gap_extend, scoring.gap_start
    same = [list(zip(x.letters, x.modifications)) for x in (a, b)]
    score = [[0] * (m + 1) for _ in range(n + 1)]
    step: list[list[tuple[str, int, int, int] | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1) if ends.left in ("both", "a") else ():
        score[i][0], step[i][0] = longer + i * gap, ("D", 1, 0, gap + (longer if i == 1 else 0))
    for j in range(1, m + 1) if ends.left in ("both", "b") else ():
        score[0][j], step[0][j] = longer + j * gap, ("I", 0, 1, gap + (longer if j == 1 else 0))
    top, where = 0, (0, 0)
    for i in range(1, n + 1):
        above, own, x = score[i - 1], score[i], a.letters[i - 1]
        for j in range(1, m + 1):
            up, left = step[i - 1][j], step[i][j - 1]
            down = gap if up and up[0] == "D" else gap + longer
            right = gap if left and left[0] == "I" else gap + longer
            best, how = above[j] + down, ("D", 1, 0, down)
            if own[j - 1] + right > best:
                best, how = own[j - 1] + right, ("I", 0, 1, right)
            y = b.letters[j - 1]
            if single[i - 1][j - 1]:
                name, gain = ("=", scoring.matrix[x, y]) if x == y else ("i", scoring.mass_base + scoring.isobaric)
            elif x == y and ((scoring.pair == "database_to_peptide" and b.modifications[j - 1]) or (scoring.pair == "peptide_to_database" and a.modifications[i - 1])):
                name, gain = "m", scoring.matrix[x, y] + scoring.mass_mismatch
            else:
                name, gain = "X", scoring.matrix[x, y] + scoring.mismatch
            if above[j - 1] + gain > best:
                best, how = above[j - 1] + gain, (name, 1, 1, gain)
            if how[0] != "=":
                for p, q in blocks.get((i, j), ()):
                    turned = p == q and sorted(same[0][i - p : i]) == sorted(same[1][j - q : j])
                    gain = scoring.mass_base + (scoring.rotated * p if turned else scoring.isobaric * (p + q) // 2)
                    if score[i - p][j - q] + gain > best:
                        best, how = score[i - p][j - q] + gain, ("r" if turned else "i", p, q, gain)
            if best >= top:
                top, where = best, (i, j)
            if ends.left != "none" or best > 0:
                own[j], step[i][j] = best, how
    i, j = n, m
    if ends.right == "none":
        i, j = where
    elif ends.right in ("b", "either"):
        i = max(range(n + 1), key=lambda k: (score[k][m], k))
        if ends.right == "either":
            k = max(range(m + 1), key=lambda k: (score[n][k], k))
            i, j = (i, m) if score[i][m] >= score[n][k] else (n, k)
    total, path = score[i][j], []
    while (s := step[i][j]) is not None and not (ends.left == "none" and score[i][j] < 0):
        path.append(s)
        i, j = i - s[1], j - s[2]
    own = [sum(scoring.matrix[c, c] for c in s.letters[k : k + sum(p[w] for p in path)]) for s, k, w in ((a, i, 1), (b, j, 2))]
    return Alignment(i, j, path[::-1], total if path else 0, int(sum(own) / 2))


def statistics(path: list[tuple[str, int, int, int]]) -> dict[str, int]:
    """identical, mass_similar, similar (pairs with a score above 0), gaps and length (the longer side of each step)."""
    out = dict.fromkeys(("identical", "mass_similar", "similar", "gaps", "length"), 0)
    for kind, n, m, gain in path:
        wide = max(n, m)
        out["length"] += wide
        out["identical"] += kind in "=m"
        out["mass_similar"] += wide if kind in "=ir" else 0
        out["similar"] += kind in "=mX" and gain > 0
        out["gaps"] += kind in "ID"
    return out


ALIGNED = "start_a int, start_b int, cigar string, score int, normalised double, identical int, mass_similar int, similar int, gaps int, length int, error string"


def align_pairs(pairs: DataFrame, a: str = "a", b: str = "b", kind: str = "global", scoring: Scoring = Scoring(), steps: int = 4, kind_column: str | None = None) -> DataFrame:
    """pairs and the alignment of each; kind_column: the type by row."""

    names, whole = [c.split()[0] for c in ALIGNED.split(", ")], [c.split()[0] for c in ALIGNED.split(", ") if c.endswith(" int")]

    @F.pandas_udf(ALIGNED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from massloom.operators.alignment_batch import align_many

        for xs, ys, kinds in batches:
            rows: list[tuple] = [()] * len(xs)
            for k, of in xs.groupby(kinds.values).indices.items():
                pairs = list(zip(xs.iloc[of], ys.iloc[of]))
                for at, al in zip(of, align_many(pairs, k, scoring, steps)):
                    if isinstance(al, str):
                        rows[at] = (*[None] * (len(names) - 1), al)
                        continue
                    s = statistics(al.path)
                    rows[at] = (al.start_a, al.start_b, al.cigar, al.score, al.normalised, s["identical"], s["mass_similar"], s["similar"], s["gaps"], s["length"], None)
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in whole})

    # a filter on what it gives would be taken below exchanges, and each pair aligned again there
    run = run.asNondeterministic()
    return pairs.withColumn("al_", run(a, b, F.col(kind_column) if kind_column else F.lit(kind))).select(*pairs.columns, "al_.*")


def _met(queries: DataFrame, templates: DataFrame, strip: int = 1000) -> DataFrame:
    """Every query with every template, by a join on strips of about so many templates to which all queries go."""
    strips = max(1, -(-templates.count() // strip))
    own = queries.withColumn("strip_", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    return own.join(templates.withColumn("strip_", F.pmod(F.xxhash64("template_id"), F.lit(strips)).cast("int")), "strip_").drop("strip_")


def align_to_templates(queries: DataFrame, templates: DataFrame, kind: str = "either_global", **how: object) -> DataFrame:
    """Every query (query_id, query) against every template (template_id, template), all of them: its cost is their
    product. The best ones alone are found by `alignment_index.best_templates`, which leaves most pairs out."""
    return align_pairs(_met(queries, templates), "query", "template", kind, **how)


def distance(identical: str = "identical", mass_similar: str = "mass_similar", a: str = "a", b: str = "b") -> Column:
    """1 - mean of identical and mass-similar residues over the shorter length."""
    return 1 - (F.col(identical) + F.col(mass_similar)) / 2 / F.least(F.length(a), F.length(b))


def consecutive(queries: DataFrame, genes: list[DataFrame], keep: int = 1, together: tuple[str, ...] = (), **how: object) -> DataFrame:
    """query_id, gene (from 0), rank, template_id and the alignment: gene by gene, the rest of each query behind its best hit so far.

    genes: a table of templates (template_id, template) for each gene; one step of DataFrame operations per gene. together: columns of all these tables (such as species and chain) in which
    later genes of a query must be equal to its first hit's; a template where one is null goes with none, and the first gene of a query is free.
    """
    left, out = queries.select("query_id", "query", F.lit(0).alias("from_"), *(F.lit(None).cast("string").alias(f"of_{c}") for c in together)), None
    for k, templates in enumerate(genes):
        rest = left.select("query_id", "query", "from_", *(f"of_{c}" for c in together), F.substring(F.col("query"), F.col("from_") + 1, F.length("query")).alias("rest_"))
        met = _met(rest.where("length(rest_) > 0"), templates.select("template_id", "template", *(F.col(c).cast("string").alias(f"own_{c}") for c in together)))
        for c in together:
            met = met.where(F.col(f"of_{c}").isNull() | (F.col(f"of_{c}") == F.col(f"own_{c}")))
        met = align_pairs(met, "rest_", "template", "local", **how)
        used = F.aggregate(F.expr(r"regexp_extract_all(cigar, '([0-9:]+)([A-Za-z=])', 0)"), F.lit(0), lambda acc, s: acc + F.when(s.endswith("I"), F.lit(0)).otherwise(F.regexp_extract(s, r"^(\d+)", 1).cast("int")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("normalised"), F.desc("score"), "template_id"))
        ranked = met.withColumn("end_", F.col("from_") + F.col("start_a") + used).withColumn("rank", rank).where(F.col("rank") <= keep)
        own = ranked.select("query_id", F.lit(k).alias("gene"), "rank", "template_id", (F.col("from_") + F.col("start_a")).alias("start_query"), F.col("end_").alias("end_query"), "cigar", "score", "normalised")
        out = own if out is None else out.unionByName(own)
        first = ranked.where("rank = 1").select("query_id", F.col("end_").alias("to_"), *(F.coalesce(f"of_{c}", f"own_{c}").alias(f"to_{c}") for c in together))
        left = left.join(first, "query_id", "left").select("query_id", "query", F.coalesce("to_", "from_").alias("from_"), *(F.coalesce(f"to_{c}", f"of_{c}").alias(f"of_{c}") for c in together))
    return out


def sequence_variance(aligned: DataFrame, group: list[str]) -> DataFrame:
    """group, column (from 0), residue, n: what stands in each column of aligned rows."""
    letters = aligned.select(*group, F.posexplode(F.split("aligned", "")).alias("column", "residue"))
    return letters.where("residue <> ''").groupBy(*group, "column", "residue").agg(F.count("*").alias("n"))
