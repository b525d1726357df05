"""Best templates of each query by alignment score.

Sequences of one mass for each residue are scored in full, all pairs of a pack and a strip at once (`alignment_batch.score_all`): that takes less than the bounds of these pairs would. For
sequences of several possible masses, which are aligned one by one, bounds leave pairs out. A pair's score has an upper bound from what both sequences hold, wherever it stands: a residue counts fully only as often as both have its letter; any other residue
can at most be in its best mismatch, or, if a block of masses around it agrees with a block of the other side, in an isobaric block. Each side's residues are summed so, and as every step
of an alignment belongs to both sides, half of both sums is never exceeded; gaps only cost. Templates are visited by falling bound until it falls below the
query's kth score so far; that score starts from the templates that share most residue triples with the query. Pairs that are visited are aligned in batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.chemistry import AMBIGUOUS
from massloom.operators.alignment import ALIGNED, Residues, Scoring, _blocks, align_pairs, residues
from massloom.operators.alignment_batch import _LETTERS, _PLACE, Table, align_rows, letter_scores, score_all
from massloom.session import scratch

_BINS = 8192


class Masses:
    """Of each sequence of a list, the letters that it counts and the mass bins of its blocks of up to `steps` residues."""

    def __init__(self, own: list[Residues], steps: int, ppm: float):
        self.counts = np.zeros((len(own), len(_LETTERS)), np.int64)
        self.length = np.array([len(r.letters) for r in own], np.int64)
        width = math.log1p(ppm / 1e6) * 1.001
        self.bins: list[list[list[np.ndarray]]] = []
        self.blocks = np.zeros((len(own), _BINS), bool)  # of two residues and more
        self.singles = np.zeros((len(own), _BINS), np.int32)  # which letters
        for k, r in enumerate(own):
            for c in r.letters:
                self.counts[k, _PLACE[c]] += 1
            # blocks that may have no positive mass agree with nothing but each other; bin 0 and 1 are theirs
            by_size = [[np.array(sorted({int(math.log(m) / width) if m > 0 else 0 for m in masses})) for masses in row] for row in (_blocks(r, steps) if r.letters else [])]
            self.bins.append(by_size)
            for size, row in enumerate(by_size):
                for at, bins in enumerate(row):
                    for off in (-1, 0, 1):
                        if size:
                            self.blocks[k, (bins + off) % _BINS] = True
                        else:
                            self.singles[k, (bins + off) % _BINS] |= 1 << _PLACE[r.letters[at]]


class Bounds:
    """Upper bounds of alignment scores, of any type, under one scoring, between sequences that hold the letters of `present`."""

    def __init__(self, scoring: Scoring, steps: int, present: np.ndarray):
        table = letter_scores(scoring)[:-1, :-1]
        most = np.where(np.eye(len(table), dtype=bool) | ~present[None, :], -1000, table).max(1)
        self.plain = np.maximum(0, most + scoring.mismatch).astype(float)
        gain = [[scoring.mass_base + scoring.isobaric * (p + q) // 2 for q in range(1, steps + 1)] for p in range(1, steps + 1)]
        #: A residue's share of a block of size p, if both sides share its gain by residues, and if this side has all of it.
        self.shares = [(max(2 * g / (p + q) for q, g in enumerate(row, 1)), max(row) / p) for p, row in enumerate(gain, 1)]
        turned = max([0.0] + [(scoring.mass_base + scoring.rotated * p) / p for p in range(2, steps + 1)])
        own = table.diagonal() + max(0, scoring.mismatch, scoring.mass_mismatch)
        self.equal = np.maximum(np.maximum(own, turned), self.plain)

    def _sides(self, counts: np.ndarray, shared: np.ndarray, best: np.ndarray) -> np.ndarray:
        """best: by way of sharing, pair and letter, what a residue of the letter may gain outside of its equals. Both ways' sums."""
        return (shared * np.maximum(self.equal, best) + (counts - shared) * best).sum(2)

    def of_query(self, q: Residues, own: Masses, k: int, others: Masses, letters: np.ndarray) -> np.ndarray:
        """For query k of `own`, the bound with each of the others; letters: theirs, padded."""
        shared, many = np.minimum(own.counts[k], others.counts), len(others.length)
        plain = np.append(self.plain, 0.0)
        mine = np.broadcast_to(plain[[_PLACE[c] for c in q.letters]], (2, many, len(q.letters))).copy()
        theirs = np.broadcast_to(plain[letters], (2, *letters.shape)).copy()
        for size, row in enumerate(own.bins[k], 1):
            for at, bins in enumerate(row):
                hit = others.blocks[:, bins % _BINS].any(1)
                masks = np.bitwise_or.reduce(others.singles[:, bins % _BINS], axis=1)
                hit |= (masks & ~np.int32(1 << _PLACE[q.letters[at]]) if size == 1 else masks) != 0
                for way in (0, 1):
                    np.maximum(mine[way, :, at : at + size], np.where(hit, self.shares[size - 1][way], 0.0)[:, None], out=mine[way, :, at : at + size])
        for size, (bins, single) in enumerate(others.padded, 1):
            masks = own.singles[k][bins]
            hit = own.blocks[k][bins] | ((masks & ~single if size == 1 else masks) != 0)
            hit = (hit & others.valid[size - 1]).any(2)
            for way in (0, 1):
                value = np.where(hit, self.shares[size - 1][way], 0.0)
                for off in range(size):
                    part = theirs[way, :, off : off + hit.shape[1]]
                    np.maximum(part, value, out=part)
        best_mine, best_theirs = np.zeros((2, many, len(_LETTERS))), np.zeros((2, many, len(_LETTERS) + 1))
        for at, c in enumerate(q.letters):
            np.maximum(best_mine[:, :, _PLACE[c]], mine[:, :, at], out=best_mine[:, :, _PLACE[c]])
        each = np.arange(many)
        for at in range(letters.shape[1]):
            of = letters[:, at]
            best_theirs[:, each, of] = np.maximum(best_theirs[:, each, of], theirs[:, :, at])
        a, b = self._sides(own.counts[k], shared, best_mine), self._sides(others.counts, shared, best_theirs[:, :, :-1])
        return np.floor(np.minimum((a[0] + b[0]) / 2, np.minimum(a[1], b[1])) + 1e-9).astype(np.int64)


def _pad(others: Masses, letters: np.ndarray, steps: int) -> None:
    """The bins of all blocks as arrays: by size, sequence, place and possible mass."""
    others.padded, others.valid = [], []
    for size in range(1, steps + 1):
        wide = max(0, letters.shape[1] - size + 1)
        deep = max([1] + [len(b) for own in others.bins if len(own) >= size for b in own[size - 1]])
        bins, valid = np.zeros((len(others.bins), wide, deep), np.int64), np.zeros((len(others.bins), wide, deep), bool)
        for k, own in enumerate(others.bins):
            for at, b in enumerate(own[size - 1] if len(own) >= size else ()):
                bins[k, at, : len(b)], valid[k, at, : len(b)] = b % _BINS, True
        single = (1 << np.minimum(letters, len(_LETTERS)))[:, :, None].astype(np.int32) if size == 1 else None
        others.padded.append((bins, single))
        others.valid.append(valid)


def search(queries: list[Residues], templates: list[Residues], keep: int, kind: str, scoring: Scoring, steps: int, least: np.ndarray | None = None) -> tuple[list[list[tuple[int, int]]], int]:
    """For each query up to `keep` of (score, place of the template), best first, ties to the earlier place; and how many pairs were aligned.

    least: scores below which nothing counts (the minimum where none is known).
    """
    kinds: dict[tuple, int] = {}
    a, b = Table(queries, kinds), Table(templates, kinds)
    own, others = Masses(queries, steps, scoring.ppm), Masses(templates, steps, scoring.ppm)
    bounds = Bounds(scoring, steps, (own.counts.sum(0) + others.counts.sum(0)) > 0)
    low = np.full(len(queries), np.iinfo(np.int64).min) if least is None else least.astype(np.int64).copy()
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    if not queries or not templates:
        return best, 0
    if len(templates) < len(queries):  # bounds are the same from either side, and the fewer are gone through one by one
        _pad(own, a.letters, steps)
        most = np.stack([bounds.of_query(t, others, k, own, a.letters) for k, t in enumerate(templates)], axis=1)
    else:
        _pad(others, b.letters, steps)
        most = np.stack([bounds.of_query(q, own, k, others, b.letters) for k, q in enumerate(queries)])
    order = np.argsort(-most, axis=1, kind="stable")
    alive, done, step, aligned = np.arange(len(queries)), 0, max(2, keep), 0
    while done < len(templates) and len(alive):
        alive = alive[most[alive, order[alive, done]] >= low[alive]]
        if not len(alive):
            break
        of = order[alive, done : done + step]
        row, place = np.nonzero(most[alive[:, None], of] >= low[alive, None])
        q, t = alive[row], of[row, place]
        score, _ = align_rows(a, q, b, t, kind, scoring, steps, len(kinds), paths=False)
        aligned += len(q)
        for k, s, at in zip(q.tolist(), score.tolist(), t.tolist()):
            if s >= low[k]:
                best[k].append((-s, at))
        for k in np.unique(q).tolist():
            best[k] = sorted(best[k])[:keep]
            if len(best[k]) == keep:
                low[k] = max(low[k], -best[k][-1][0])
        done, step = done + step, step * 2
    return [[(-s, at) for s, at in x] for x in best], aligned


def _by_masses(own: list[Residues]) -> tuple[list[int], list[int]]:
    """Places of sequences of one mass for each residue, and of the others."""
    one = [all(len(m) == 1 for m in r.masses) for r in own]
    return [k for k, x in enumerate(one) if x], [k for k, x in enumerate(one) if not x]


def ranked(queries: list[Residues], templates: list[Residues], keep: int, kind: str, scoring: Scoring, steps: int, least: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """What `search` finds, by way of all scores where both sides have one mass for each residue."""
    (one_q, more_q), (one_t, more_t) = _by_masses(queries), _by_masses(templates)
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    low = np.full(len(queries), np.iinfo(np.int64).min) if least is None else least.astype(np.int64).copy()
    if one_q and one_t:
        kinds: dict[tuple, int] = {}
        score = score_all(Table([queries[k] for k in one_q], kinds), Table([templates[k] for k in one_t], kinds), kind, scoring, steps)
        first = np.argsort(-score, axis=1, kind="stable")[:, :keep]
        for k, places, own in zip(one_q, first.tolist(), np.take_along_axis(score, first, 1).tolist()):
            best[k] = [(s, one_t[at]) for s, at in zip(own, places)]
            if len(best[k]) == keep:
                low[k] = max(low[k], own[-1])
    for of_q, of_t in ((one_q, more_t), (more_q, list(range(len(templates))))):
        if of_q and of_t:
            found, _ = search([queries[k] for k in of_q], [templates[k] for k in of_t], keep, kind, scoring, steps, low[of_q])
            for k, hits in zip(of_q, found):
                best[k] = sorted([*best[k], *((s, of_t[at]) for s, at in hits)], key=lambda x: (-x[0], x[1]))[:keep]
    return best


def _read(texts: list[str | None]) -> list[Residues | None]:
    out: list[Residues | None] = []
    for t in texts:
        try:
            r = residues(t) if t is not None else None
        except (ValueError, KeyError):
            r = None
        out.append(r if r is None or all(c in _PLACE for c in r.letters) else None)
    return out


def _triples(df: DataFrame, key: str, text: str) -> DataFrame:
    own = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda k: F.substring(F.col(text), k, F.lit(3)))
    return df.where(F.length(text) > 2).select(key, F.explode(F.array_distinct(own)).alias("triple"))


def best_templates(
    queries: DataFrame,
    templates: DataFrame,
    keep: int = 5,
    kind: str = "either_global",
    scoring: Scoring = Scoring(),
    steps: int = 4,
    pack: int = 1024,
    strip: int = 4096,
    common: int = 1000,
) -> DataFrame:
    """query_id, rank, template_id, query, template and the alignment: the `keep` templates of highest score for each query, ties to the lesser template_id.

    queries: query_id, query; templates: template_id, template (ids are distinct, sequences as in `alignment`). The rows are those of ranking all alignments: bounds leave
    out only pairs that can't be among them. A query that is null or no sequence gives one row with `error`; such templates are left out. Queries meet templates in groups of about `pack` by `strip`
    of them, whatever their numbers. Of queries that may have several masses, a threshold starts from the templates that share triples with them; triples that more than `common` templates have
    don't propose any, which costs time, never a result. Both tables are written to the shared folder first, so that what makes them runs once.
    """
    spark, root = queries.sparkSession, scratch(queries.sparkSession)

    def written(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{root}/{name}")
        return spark.read.schema(table.schema).parquet(f"{root}/{name}")

    queries, templates = written(queries.select("query_id", "query"), "queries"), written(templates.select("template_id", "template"), "templates")
    n_queries, n_templates = queries.count(), templates.count()
    pack *= max(1, min(4, strip // max(1, n_templates)))  # where templates don't fill a strip, a group has more queries
    n_packs, n_strips = max(1, -(-n_queries // pack)), max(1, -(-n_templates // strip))
    spread = min(n_packs, 10_000)  # alignments cost more than their bytes tell, so their tasks are counted by rows

    theirs = _triples(templates, "template_id", "template")
    rare = theirs.join(theirs.groupBy("triple").agg(F.count("*").alias("many")).where(F.col("many") <= common).select("triple"), "triple")
    several = queries.where(F.col("query").rlike(f"[{''.join(AMBIGUOUS)}#]"))
    shared = _triples(several, "query_id", "query").join(rare, "triple").groupBy("query_id", "template_id").agg(F.count("*").alias("triples"))
    first = shared.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("triples"), "template_id"))).where(F.col("place") <= 2 * keep)
    least = None
    if not several.isEmpty():
        scored = align_pairs(first.join(queries, "query_id").join(templates, "template_id").select("query_id", "query", "template").repartition(spread, "query_id"), "query", "template", kind, scoring, steps).where("score is not null")
        least = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") == keep).select("query_id", F.col("score").alias("least"))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.join(least, "query_id", "left") if least is not None else queries.withColumn("least", F.lit(None).cast("int"))
    left = left.select("query_id", "query", "least", F.pmod(F.xxhash64("query_id"), F.lit(n_packs)).cast("int").alias("pack"), every(n_strips).alias("strip"))
    right = templates.select("template_id", "template", F.pmod(F.xxhash64("template_id"), F.lit(n_strips)).cast("int").alias("strip"), every(n_packs).alias("pack"))
    id_q, id_t = queries.schema["query_id"].dataType, templates.schema["template_id"].dataType
    schema = T.StructType([T.StructField("query_id", id_q), T.StructField("template_id", id_t), T.StructField("score", T.IntegerType())])

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.sort_values("template_id")
        (qs, ts), out = (_read(own["query"].tolist()), _read(others["template"].tolist())), []
        good_q, good_t = [k for k, r in enumerate(qs) if r], [k for k, r in enumerate(ts) if r]
        low = own["least"].fillna(np.iinfo(np.int32).min).to_numpy(np.int64)[good_q]
        found = ranked([qs[k] for k in good_q], [ts[k] for k in good_t], keep, kind, scoring, steps, low)
        for k, hits in zip(good_q, found):
            out += [(own["query_id"].iloc[k], others["template_id"].iloc[good_t[at]], s) for s, at in hits]
        return pd.DataFrame(out, columns=["query_id", "template_id", "score"])

    tasks = min(n_packs * n_strips, 10_000)
    left, right = (x.repartition(tasks, "pack", "strip") for x in (left, right))
    met = left.groupBy("pack", "strip").cogroup(right.groupBy("pack", "strip")).applyInPandas(run, schema)
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "template_id"))).where(F.col("rank") <= keep).drop("score")
    rows = queries.join(best, "query_id", "left").join(templates, "template_id", "left").repartition(spread, "query_id")
    # a query without any hit is aligned with itself to learn what is wrong with it; where nothing is, there were no templates
    out = align_pairs(rows.withColumn("with_", F.coalesce("template", F.when(F.col("template_id").isNull(), F.col("query")))), "query", "with_", kind, scoring, steps)
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    return out.where("template_id is not null or error is not null").select("query_id", "rank", "template_id", "query", "template", *names)
