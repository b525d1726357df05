"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) train a linear classifier on hashed words and beginnings of words, by
how often they are in a text. With the class prior p, the risk is p R_P(+) + max(0, R_U(-) - p R_P(-)); where the second part falls below 0 the step
goes the other way on it (non-negative estimator). The prior is the share of toxic rows among the labelled ones of
the training fold. The classifier is fitted on a bounded draw of texts (`positives`, `unlabelled` are the expected numbers);
features are those whose shares in P and U differ by more than chance.

Null and empty texts have no words and get the score of the bias alone. Rows with null ids or repeated rows are scored like others;
null labels do not count, and an id labelled twice is toxic if one of its labels says so. Without a positive example every
score is next to 0. A very long text is a batch by itself, an empty table gives no rows, and further columns of either table, clashing names included, are ignored (`drop_toxic` keeps those
of the documents). Labels of the held-out fold are never read, and neither are lang, source or ids as inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.folds import drawn, remainder
from massloom.llm.textcols import PUNCTUATION, U64, Words, chunks, mix, utf8
from massloom.llm.workspace import Workspace


#: Bytes at the start of a longer word that are a feature too, so that inflected and compound words share one.
STEMS = (4, 6, 8)
#: A feature more for each time that a word or stem is met, up to so many.
LEVELS = 4


@dataclass(frozen=True)
class NnPU:
    folds: int = 5
    held_out: int = 0
    positives: int = 8_000
    unlabelled: int = 16_000
    features: int = 20_000
    min_z: float = 4.5
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-3


def _bases(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word of each text, and of the first bytes of longer words; repeated ones included."""
    words = Words(*utf8(batch.column("text")), gaps=PUNCTUATION)
    every, rows = [words.hashes(lower=True)], [words.row_of()]
    for n in STEMS:
        own, of = words.beginnings(n, lower=True)
        every.append(mix(own + U64(n)))
        rows.append(rows[0][of])
    return np.concatenate(rows), np.concatenate(every)


def _levels(row: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, base and number of times (up to LEVELS) of the bases of each row."""
    order = np.lexsort((base, row))
    row, base = row[order], base[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (base[1:] != base[:-1]))))
    return row[first], base[first], np.minimum(np.diff(np.append(first, len(row))), LEVELS)


def _shares(sample: DataFrame) -> DataFrame:
    """base, level (from 0), p, u: in how many positive and unlabelled texts a base occurs more than `level` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: [np.zeros(0, t)] for k, t in (("base", U64), ("level", np.int64), ("p", np.int64))}
        for b in chunks(batches):
            row, base, n = _levels(*_bases(b))
            found["base"].append(np.repeat(base, n))
            found["level"].append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            found["p"].append(np.repeat(b.column("positive").to_numpy(zero_copy_only=False).astype(np.int64)[row], n))
        base, level, p = (np.concatenate(found[k]) for k in ("base", "level", "p"))
        _, at, back = np.unique(mix(base + level.astype(U64)), return_index=True, return_inverse=True)
        n, n_p = np.bincount(back, minlength=len(at)), np.bincount(back, p, minlength=len(at)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (base[at].view(np.int64), level[at].astype(np.int32), n_p, n - n_p)], ["base", "level", "p", "u"])

    counts = sample.select("positive", "text").mapInArrow(run, "base long, level int, p long, u long")
    return counts.groupBy("base", "level").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


class Linear:
    """A bias, and weights of bases by how often they occur: table[k, n] is what base k adds if it occurs n times."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        """keys: sorted; weights: (keys, LEVELS)."""
        self.keys, self.bias = keys, bias
        self.table = np.concatenate((np.zeros((len(keys), 1)), np.cumsum(weights, axis=1)), axis=1)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & U64(0xFFFF)).astype(np.int64)] = True

    def found(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, number of the key and times of the bases that are keys."""
        row, base = _bases(batch)
        some = self.maybe[(base & U64(0xFFFF)).astype(np.int64)]
        row, base = row[some], base[some]
        at = np.searchsorted(self.keys, base)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == base if len(self.keys) else np.zeros(len(base), bool)
        row, at, n = _levels(row[known], at[known].astype(U64))
        return row, at.astype(np.int64), n

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        row, at, n = self.found(batch)
        z = self.bias + np.bincount(row, self.table[at, n], minlength=batch.num_rows)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _present(sample: DataFrame, keys: np.ndarray) -> DataFrame:
    """positive, features (key * LEVELS + level) of each text."""
    sent = sample.sparkSession.sparkContext.broadcast(Linear(keys, np.zeros((len(keys), LEVELS)), 0.0))  # bounded by how.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, at, n = sent.value.found(b)
            feature = np.repeat(at * LEVELS, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bounds = np.searchsorted(np.repeat(row, n), np.arange(b.num_rows + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("positive"), own], ["positive", "features"])

    return sample.select("positive", "text").mapInArrow(run, "positive boolean, features array<int>")


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, how: NnPU) -> tuple[np.ndarray, float]:
    """Weights and bias; each text as its distinct features, numbered from 0 to size - 1."""
    data = []
    for texts in (positive, unlabelled):
        row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        data.append((row, np.concatenate([*texts, np.zeros(0, np.int32)]).astype(np.int64), len(texts)))
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    def outputs(row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        return bias + np.bincount(row, w[col], minlength=n)

    def pulled(d: np.ndarray, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        return np.append(np.bincount(col, d[row], minlength=size), d.sum()) / n

    for step in range(1, how.steps + 1):
        zp, zu = (outputs(*x) for x in data)
        sp, su = (1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (zp, zu))
        # logistic loss: log(1 + exp(-z)) for +, log(1 + exp(z)) for -
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        toward = pulled(su, *data[1]) - prior * pulled(sp, *data[0])
        g = prior * pulled(sp - 1, *data[0]) + toward if negative >= 0 else -toward
        g[:-1] += how.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w, bias


def train(docs: DataFrame, labels: DataFrame, how: NnPU = NnPU()) -> Linear:
    """docs: doc_id, text; labels: doc_id, toxic."""
    work = Workspace(docs.sparkSession, "toxicity")
    nothing = np.zeros(0, U64)
    known = labels.where("doc_id is not null and toxic is not null").where(remainder("doc_id", how.folds) != how.held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Linear(nothing, np.zeros((0, LEVELS)), -40.0)
    prior = min(0.9, max(0.001, toxic / n))
    chosen = known.where("toxic = 1").where(drawn("doc_id", how.positives / toxic, 1)).select("doc_id")
    fold = docs.where(remainder("doc_id", how.folds) != how.held_out).select("doc_id", "text")
    pos = fold.join(F.broadcast(chosen), "doc_id").select("text", F.lit(True).alias("positive"))  # about `positives` ids
    unl = fold.where(drawn("doc_id", how.unlabelled / max(1, fold.count()), 2)).select("text", F.lit(False).alias("positive"))
    sample = work.save(pos.unionAll(unl), "sample")
    size = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    if not n_p or not n_u:
        return Linear(nothing, np.zeros((0, LEVELS)), -40.0 if not n_p else 0.0)
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    best = _shares(sample).withColumn("z", z).where(F.col("z") >= how.min_z).orderBy(F.desc("z"), "base", "level").limit(how.features)
    rows = [(r["base"], r["level"]) for r in best.select("base", "level").collect()]
    keys = np.unique(np.array([b for b, _ in rows], np.int64).view(U64))
    number = {k: i for i, k in enumerate(keys.view(np.int64).tolist())}
    used = np.full(len(keys) * LEVELS, -1)
    used[[number[b] * LEVELS + level for b, level in rows]] = np.arange(len(rows))
    got = _present(sample, keys).toArrow()
    is_pos = got.column("positive").to_pylist()
    texts = [used[x.values.to_numpy()] if len(x) else np.zeros(0, np.int64) for x in got.column("features")]
    texts = [x[x >= 0] for x in texts]
    w, bias = fit([x for x, p in zip(texts, is_pos) if p], [x for x, p in zip(texts, is_pos) if not p], len(rows), prior, how)
    work.close()
    return Linear(keys, np.where(used >= 0, np.append(w, 0.0)[used], 0.0).reshape(-1, LEVELS), bias)


def with_score(docs: DataFrame, model: Linear, column: str = "score") -> DataFrame:
    """docs and the score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by how.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.scores(b))], [*b.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, how: NnPU = NnPU()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every text."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels, how))
    return scored.select("doc_id", (remainder("doc_id", how.folds) == how.held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, how: NnPU = NnPU()) -> DataFrame:
    """The rows of docs whose score is below 0.5."""
    own = "score"
    while own in docs.columns:
        own += "_"
    return with_score(docs, train(docs, labels, how), own).where(F.col(own) < 0.5).drop(own)
