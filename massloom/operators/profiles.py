"""Multiple alignment by mass: clusters of aligned sequences are profiles of columns, and two profiles are aligned as wholes.

A column's profile is the set of residues that stand there, and for each size the set of blocks of residues that end there, over all rows of the cluster; rows that agree count
once, so a cell of the dynamic programming costs what the column holds in variants, not in rows. A cell takes the best pair of residues of both columns, or a block of each
whose masses agree, as in `alignment`. Merging two clusters puts the same columns into all rows of a side: where a block of one side is longer, the other
side's residues stay together and are followed by `·`; `-` stands for nothing.

Distances of all pairs of a group are rows that Spark aligns; then each group's clusters are merged, nearest first, in one task that gets the group's
sequences and distances. The order of merges is a result of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.operators.alignment import TYPES, Residues, Scoring, _blocks, align_pairs, residues

_LOW = -(1 << 40)
FILL, GAP = "·", "-"


@dataclass
class Row:
    """One aligned sequence: a sign for each column, and how many residues stand up to its end."""

    key: object
    sequence: Residues
    text: str
    upto: list[int]

    @classmethod
    def of(cls, key: object, sequence: Residues) -> Row:
        return cls(key, sequence, sequence.letters, list(range(1, len(sequence.letters) + 1)))


def _kinds(rows: list[Row]) -> tuple[list[tuple], list[list[float]], np.ndarray]:
    """Kinds of residue, their masses, and which columns have them. In columns before a row's first residue, that one stands."""
    place: dict[tuple, int] = {}
    masses, wide = [], len(rows[0].text)
    has: list[list[int]] = [[] for _ in range(wide)]
    for r in rows:
        for c, n in enumerate(r.upto):
            k = max(n, 1) - 1
            kind = (r.sequence.letters[k], r.sequence.modifications[k], tuple(r.sequence.masses[k]))
            if kind not in place:
                place[kind] = len(place)
                masses.append(r.sequence.masses[k])
            has[c].append(place[kind])
    out = np.zeros((wide, len(place)), bool)
    for c, own in enumerate(has):
        out[c, own] = True
    return list(place), masses, out


def _best(gain: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """For each column of a and b, the most that any of their kinds gain together."""
    out = np.full((len(in_a), len(in_b)), _LOW)
    for k in range(in_a.shape[1]):
        by_column = np.where(in_b, gain[k][None, :], _LOW).max(1)
        out[in_a[:, k]] = np.maximum(out[in_a[:, k]], by_column)
    return out


def _pairs(a: list[Row], b: list[Row], scoring: Scoring) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By cell: the best pair of agreeing mass, whether it is of equal residues, and the best other pair."""
    (ka, ma, in_a), (kb, mb, in_b) = _kinds(a), _kinds(b)
    same, near, other = (np.full((len(ka), len(kb)), _LOW) for _ in range(3))
    for x, (letter, mods, _) in enumerate(ka):
        for y, (letter_b, mods_b, _) in enumerate(kb):
            if any(abs(p - q) <= abs(p) * scoring.ppm / 1e6 for p in ma[x] for q in mb[y]):
                if letter == letter_b:
                    same[x, y] = scoring.matrix[letter, letter_b]
                else:
                    near[x, y] = scoring.mass_base + scoring.isobaric
            else:
                heavier = letter == letter_b and ((scoring.pair == "database_to_peptide" and mods_b) or (scoring.pair == "peptide_to_database" and mods))
                other[x, y] = scoring.matrix[letter, letter_b] + (scoring.mass_mismatch if heavier else scoring.mismatch)
    equal = _best(same, in_a, in_b)
    agreeing = np.maximum(equal, _best(near, in_a, in_b))
    return agreeing, (equal == agreeing) & (equal > _LOW), _best(other, in_a, in_b)


def _ending(rows: list[Row], steps: int) -> list[dict[tuple, tuple[list[float], list[int]]]]:
    """By size: of each distinct block, its masses and the columns where it ends."""
    out: list[dict[tuple, tuple[list[float], list[int]]]] = [{} for _ in range(steps)]
    for r in rows:
        s = r.sequence
        blocks = _blocks(s, steps) if s.letters else []
        for c, n in enumerate(r.upto):
            for size in range(1, min(n, steps) + 1):
                key = tuple(sorted(zip(s.letters[n - size : n], s.modifications[n - size : n]))) + tuple(blocks[size - 1][n - size])
                out[size - 1].setdefault(key, (blocks[size - 1][n - size], []))[1].append(c)
    return out


def _agreeing_blocks(a: list[Row], b: list[Row], scoring: Scoring, steps: int) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """By cell (columns from 1), the sizes of blocks that end there and agree, and what they gain."""
    ends_a, ends_b, found = _ending(a, steps), _ending(b, steps), {}
    for q, theirs in enumerate(ends_b, 1):
        keys = [(m, key) for key, (masses, _) in theirs.items() for m in masses]
        keys.sort(key=lambda x: x[0])
        at = np.array([m for m, _ in keys])
        for p, mine in enumerate(ends_a, 1):
            if p == q == 1 or not len(at):
                continue
            for key, (masses, columns) in mine.items():
                for m in masses:
                    off = abs(m) * scoring.ppm / 1e6
                    for _, other in keys[np.searchsorted(at, m - off) : np.searchsorted(at, m + off, "right")]:
                        turned = p == q and key[:p] == other[:q]
                        gain = scoring.mass_base + (scoring.rotated * p if turned else scoring.isobaric * (p + q) // 2)
                        for i in columns:
                            for j in theirs[other][1]:
                                cell = found.setdefault((i + 1, j + 1), {})
                                cell[p, q] = max(gain, cell.get((p, q), _LOW))
    return found


def align_profiles(a: list[Row], b: list[Row], kind: str, scoring: Scoring, steps: int) -> tuple[int, int, list[tuple[int, int]], int]:
    """First columns, steps (columns of a, columns of b) and score of the best alignment of two clusters."""
    n, m, ends = len(a[0].text), len(b[0].text), TYPES[kind]
    agreeing, equal, other = _pairs(a, b, scoring) if n and m else (np.zeros((n, m)),) * 3
    blocks = {k: sorted(v.items()) for k, v in (_agreeing_blocks(a, b, scoring, steps) if n and m else {}).items()}
    agreeing, equal, other = agreeing.tolist(), equal.tolist(), other.tolist()
    gap, start = scoring.gap_extend, scoring.gap_start
    score, step = [[0] * (m + 1) for _ in range(n + 1)], [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    if ends.left == "both":
        for i in range(1, n + 1):
            score[i][0], step[i][0] = start + gap * i, (1, 0)
        for j in range(1, m + 1):
            score[0][j], step[0][j] = start + gap * j, (0, 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            up = score[i - 1][j] + gap + (0 if step[i - 1][j] == (1, 0) else start)
            left = score[i][j - 1] + gap + (0 if step[i][j - 1] == (0, 1) else start)
            best, how = (up, (1, 0)) if up >= left else (left, (0, 1))
            before, done = score[i - 1][j - 1], False
            if before + agreeing[i - 1][j - 1] > best:
                best, how, done = before + agreeing[i - 1][j - 1], (1, 1), equal[i - 1][j - 1]
            if not done:
                if before + other[i - 1][j - 1] > best:
                    best, how = before + other[i - 1][j - 1], (1, 1)
                for (p, q), gain in blocks.get((i, j), ()):
                    if score[i - p][j - q] + gain > best:
                        best, how = score[i - p][j - q] + gain, (p, q)
            score[i][j], step[i][j] = best, how
    i, j = n, m
    if ends.right == "either":
        i = max(range(n + 1), key=lambda k: (score[k][m], k))
        k = max(range(m + 1), key=lambda k: (score[n][k], k))
        i, j = (i, m) if score[i][m] >= score[n][k] else (n, k)
    total, path = score[i][j], []
    while step[i][j] != (0, 0):
        path.append(step[i][j])
        i, j = i - path[-1][0], j - path[-1][1]
    return i, j, path[::-1], total


def _spread(row: Row, path: list[tuple[int, int]], which: int, first: int, other_first: int) -> Row:
    """The row in the columns of the merged clusters; columns before and behind the path stay."""
    text, upto = [GAP * other_first, row.text[:first]], [0] * other_first + row.upto[:first]
    at = first
    for step in path:
        own, other = step[which], step[1 - which]
        part, ends = row.text[at : at + own], row.upto[at : at + own]
        more = max(0, other - own)
        if not own:
            part, ends = GAP * other, [upto[-1] if upto else 0] * other
        elif more:
            stays = "".join(c for c in part if c not in FILL + GAP)
            if own > 1 and stays:  # the block stands together, so all of it is there from its first column on
                part, ends = stays + FILL * (own + more - len(stays)), [ends[-1]] * (own + more)
            else:
                inside = part[-1] != GAP
                part, ends = part + (FILL if inside else GAP) * more, ends + [ends[-1]] * more
        text.append(part)
        upto += ends
        at += own
    return Row(row.key, row.sequence, "".join(text) + row.text[at:], upto + row.upto[at:])


def merge(a: list[Row], b: list[Row], kind: str = "global", scoring: Scoring = Scoring(), steps: int = 4) -> tuple[list[Row], int]:
    """Two clusters as one, and the score of their alignment."""
    start_a, start_b, path, score = align_profiles(a, b, kind, scoring, steps)
    rows = [_spread(r, path, 0, start_a, start_b) for r in a] + [_spread(r, path, 1, start_b, start_a) for r in b]
    wide = max(len(r.text) for r in rows)
    for r in rows:
        r.upto += [r.upto[-1] if r.upto else 0] * (wide - len(r.text))
        r.text = r.text.ljust(wide, GAP)
    return rows, score


def cluster(rows: list[Row], distance: np.ndarray, kind: str, scoring: Scoring, steps: int, most: float | None = None) -> tuple[list[list[Row]], list[tuple[int, int, int, float, int]]]:
    """Clusters, and the merges: number, least place of either side's rows, distance, score.

    distance: a symmetric matrix. The two nearest clusters are merged again and again, up to a distance of `most`; of equal distances the pair whose later cluster
    comes first, then whose earlier one does. A merged cluster's distance to another is half of both sides' less their own.
    """
    far = distance.astype(float).copy()
    far[np.triu_indices(len(rows))] = np.inf  # row: the later cluster, column: the earlier one
    own = [[r] for r in rows]
    merges, least = [], list(range(len(rows)))
    while len(own) > 1:
        late, early = np.unravel_index(far.argmin(), far.shape)
        d = float(far[late, early])
        if most is not None and d > most:
            break
        own[early], score = merge(own[early], own[late], kind, scoring, steps)
        merges.append((len(merges), least[early], least[late], d, score))
        full = np.where(np.isinf(far), far.T, far)
        joint = (full[early] + full[late] - d) / 2
        for k in range(len(own)):
            if k not in (early, late):
                far[max(k, early), min(k, early)] = joint[k]
        far = np.delete(np.delete(far, late, 0), late, 1)
        del own[late], least[late]
    return own, merges


def distances(sequences: DataFrame, group: str, key: str, sequence: str, kind: str = "global", scoring: Scoring = Scoring(), steps: int = 4) -> DataFrame:
    """group, key_a, key_b (the lesser), distance of each pair of a group: 1 - mean of identical and mass-similar residues over the shorter length; null for texts that are no sequences."""
    a = sequences.select(F.col(group).alias("group_"), F.col(key).alias("key_a"), F.col(sequence).alias("a"))
    b = sequences.select(F.col(group).alias("group_b"), F.col(key).alias("key_b"), F.col(sequence).alias("b"))
    pairs = a.join(b, F.col("group_").eqNullSafe(F.col("group_b")) & (F.col("key_a") > F.col("key_b"))).drop("group_b")
    out = align_pairs(pairs, "a", "b", kind, scoring, steps)
    letters = lambda c: F.length(F.regexp_replace(c, r"\[[^\]]*\]-?|[^A-Z]", ""))
    d = 1 - (F.col("identical") + F.col("mass_similar")) / 2 / F.greatest(F.least(letters("a"), letters("b")), F.lit(1))
    return out.select(F.col("group_").alias(group), "key_a", "key_b", d.alias("distance"))


def multiple_alignment(
    sequences: DataFrame, group: str, key: str, sequence: str, kind: str = "global", scoring: Scoring = Scoring(), steps: int = 4, most: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Aligned rows (group, key, cluster, aligned, error), and the merges that made them (group, merge, left, right, distance, score).

    Keys are distinct within a group. Ends: `global`, `either_global`, `ragged_left` or `ragged_right`. left and right: the least keys of the merged clusters. Texts that are no
    sequence, and nulls, give a row with `error` and take no part. A group's sequences and distances (the square of its size) go to one task: groups are families, not corpora.
    """
    if kind not in ("global", "either_global", "ragged_left", "ragged_right"):
        raise ValueError("at each end, clusters end together or either one first")
    fields = {f.name: f.dataType for f in sequences.schema}
    found = distances(sequences, group, key, sequence, kind, scoring, steps)
    schema = T.StructType(
        [T.StructField(group, fields[group]), T.StructField(key, fields[key])]
        + [T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("aligned", T.StringType()), ("error", T.StringType()), ("merge", T.IntegerType()))]
        + [T.StructField("left", fields[key]), T.StructField("right", fields[key]), T.StructField("distance", T.DoubleType()), T.StructField("score", T.IntegerType())]
    )

    def run(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        own, out, rows = own.sort_values(key), [], []
        for g, k, text in zip(own[group], own[key], own[sequence]):
            try:
                if text is None:
                    raise ValueError("no sequence")
                rows.append(Row.of(k, residues(text)))
                if not rows[-1].text:
                    rows.pop()
                    raise ValueError("no residues")
            except (ValueError, KeyError) as e:
                out.append((g, k, None, None, str(e), None, None, None, None, None))
        place = {r.key: n for n, r in enumerate(rows)}
        far = np.full((len(rows), len(rows)), np.inf)
        for x, y, d in zip(pairs["key_a"], pairs["key_b"], pairs["distance"]):
            if x in place and y in place:
                far[place[x], place[y]] = far[place[y], place[x]] = d
        g = own[group].iloc[0] if len(own) else None
        clusters, merges = cluster(rows, far, kind, scoring, steps, most)
        out += [(g, r.key, n, r.text, None, None, None, None, None, None) for n, c in enumerate(clusters) for r in c]
        out += [(g, None, None, None, None, n, rows[a].key, rows[b].key, d, score) for n, a, b, d, score in merges]
        pdf = pd.DataFrame(out, columns=schema.names)
        return pdf.astype({"cluster": "Int32", "merge": "Int32", "score": "Int32"})

    every = sequences.select(group, key, sequence).groupBy(group).cogroup(found.groupBy(group)).applyInPandas(run, schema)
    return every.where("merge is null").select(group, key, "cluster", "aligned", "error"), every.where("merge is not null").select(group, "merge", "left", "right", "distance", "score")
