"""Language-model scores of a class-based bigram model.

Tokens are lower-cased words and one end per text. Every training word belongs to a unit: the most frequent words are
units of their own, the others share one by their last bytes and length, the end is one too. Exchange clustering puts units
into classes: each unit in turn moves to the class that gains most likelihood of the class bigrams. Then every other training
word is clustered by itself: all at once, each moves to the class that gains most by its own neighbours' classes, to which `prior` neighbours
of its ending are added. The class bigrams are counted anew after that; words without a training text keep their ending's class. A token's probability is
P(class | previous token's class) * P(word | class); the first smoothed by the classes' own shares, the second by half a
count, with half a count for unseen words. A text begins after an end.

Counts cover every training text. Word counts are exchanged once per word and shard of documents, so that a shard
gets the counts of its own words alone, however large the vocabulary; clustering sees a table of unit pairs, at most units ** 2.

A text of any length is one batch of its shard. Null texts count as empty (one end token). Null ids are scored like others; their fold is that of the empty text. Repeated
rows count as often as they occur; an empty table gives no rows; further columns are ignored. Without a training text the model
knows nothing and base scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.folds import remainder
from massloom.llm.shards import shard_of
from massloom.llm.textcols import U64, Words, chunks, mix, utf8
from massloom.llm.workspace import Workspace

END = U64(0xE0D)


@dataclass(frozen=True)
class Brown:
    folds: int = 5
    held_out: int = 1
    frequent: int = 639
    endings: int = 128
    classes: int = 48
    sweeps: int = 4
    prior: float = 5.0
    shard_mb: float = 16.0
    #: Rows of one word (one from each shard or sum of shards) that meet in a task.
    fan: int = 256

    @property
    def units(self) -> int:
        return self.frequent + self.endings + 1


class Tokens:
    """Hash and ending of every token of a batch, with the end at the end of each row; rows: bounds."""

    def __init__(self, texts: pa.Array, how: Brown):
        words = Words(*utf8(texts))
        hashes = words.hashes(lower=True)
        n = np.diff(words.rows)
        self.rows = words.rows + np.arange(len(words.rows))
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)
        self.hashes = np.full(self.rows[-1], END, U64)
        self.hashes[at] = hashes
        size = words.end - words.start
        last = np.zeros(len(hashes), np.int64)
        for k in (1, 2):
            has = size >= k
            byte = words.buf[words.end[has] - k].astype(np.int64)
            last[has] = last[has] * 256 + byte + 32 * ((byte >= 65) & (byte <= 90))  # lower-case A-Z
        shape = mix(last.astype(U64) * U64(4) + np.minimum(size // 4, 3).astype(U64)) % U64(how.endings)
        self.endings = np.full(self.rows[-1], how.endings, np.int64)
        self.endings[at] = shape.astype(np.int64)


def units(hashes: np.ndarray, endings: np.ndarray, frequent: np.ndarray, how: Brown) -> np.ndarray:
    """frequent: sorted hashes. Units: the frequent words, then endings, then the end."""
    out = how.frequent + endings
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        known = frequent[at] == hashes
        out[known] = at[known]
    return out


def _counts(docs: DataFrame, how: Brown) -> DataFrame:
    """shard, word, ending, n: the words of each shard and their number in its training texts."""

    def run(texts: pa.Table) -> pa.Table:
        words: dict[str, list] = {"h": [], "e": [], "n": []}
        for b in chunks(iter(texts.to_batches())):
            t = Tokens(b.column("text"), how)
            h, at, inverse = np.unique(t.hashes, return_index=True, return_inverse=True)
            train = np.repeat(b.column("train").to_numpy(zero_copy_only=False), np.diff(t.rows))
            words["h"].append(h)
            words["e"].append(t.endings[at])
            words["n"].append(np.bincount(inverse, train, minlength=len(h)).astype(np.int64))
        every = [np.concatenate(words[k]) for k in "hen"]
        h, at, inverse = np.unique(every[0], return_index=True, return_inverse=True)
        n = np.bincount(inverse, every[2], minlength=len(h)).astype(np.int64)
        return pa.table({"shard": pa.array([texts.column("shard")[0].as_py()] * len(h), pa.int64()), "word": h.view(np.int64), "ending": every[1][at].astype(np.int32), "n": n})

    return docs.groupBy("shard").applyInArrow(run, "shard long, word long, ending int, n long")


def _pairs(docs: DataFrame, frequent: np.ndarray, how: Brown) -> DataFrame:
    """pair (previous unit * units + unit), n: of the training texts."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most how.frequent numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = how.units
        total = np.zeros(size * size, np.int64)
        for b in chunks(batches):
            t = Tokens(b.column("text"), how)
            u = units(t.hashes, t.endings, sent.value, how)
            before = np.empty_like(u)
            before[1:], before[:1] = u[:-1], size - 1  # a text follows the end of another
            np.add(total, np.bincount(before * size + u, minlength=size * size), out=total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    return docs.where("train").select("text").mapInArrow(run, "pair int, n long")


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each unit; counts: how often unit j follows unit i."""
    size = len(counts)
    own = np.argsort(np.argsort(-counts.sum(axis=0), kind="stable"), kind="stable") % classes
    grid = np.zeros((classes, classes))
    np.add.at(grid, (own[:, None], own[None, :]), counts)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for u in range(size):
            if not counts[u].any() and not counts[:, u].any():
                continue
            right, left, itself = np.bincount(own, counts[u], minlength=classes), np.bincount(own, counts[:, u], minlength=classes), counts[u, u]
            a = own[u]
            right[a] -= itself
            left[a] -= itself
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= itself
            rows, cols = grid.sum(axis=1), grid.sum(axis=0)
            gain = (f(grid + right) - f(grid)).sum(axis=1) + (f(grid + left[:, None]) - f(grid)).sum(axis=0)
            d = np.diagonal(grid)
            gain += f(d + right + left + itself) - f(d + right) - f(d + left) + f(d)
            gain -= f(rows + right.sum() + itself) - f(rows) + f(cols + left.sum() + itself) - f(cols)
            b = int(np.argmax(gain))
            b = a if gain[b] <= gain[a] + 1e-9 else b
            own[u], moved = b, moved + (a != b)
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += itself
        if not moved:
            break
    return own


@dataclass
class Model:
    frequent: np.ndarray
    classes: np.ndarray  # of each unit
    follows: np.ndarray  # log10 P(class | previous class)
    class_count: np.ndarray
    class_words: np.ndarray
    total: int
    vocabulary: int


def fit(frequent: np.ndarray, pairs: np.ndarray, unit_words: np.ndarray, total: int, vocabulary: int, how: Brown) -> Model:
    """pairs: how often unit j follows unit i; unit_words: the number of training words in each unit."""
    own = exchange(pairs, how.classes, how.sweeps)
    grid = np.zeros((how.classes, how.classes))
    np.add.at(grid, (own[:, None], own[None, :]), pairs)
    return of_grid(frequent, own, grid, np.bincount(own, unit_words, minlength=how.classes), total, vocabulary, how)


def of_grid(frequent: np.ndarray, own: np.ndarray, grid: np.ndarray, words: np.ndarray, total: int, vocabulary: int, how: Brown) -> Model:
    """grid: how often class j follows class i; words: the number of training words in each class."""
    count = grid.sum(axis=0)
    share = (count + 1) / (count.sum() + how.classes)
    follows = np.log10((grid + how.prior * share) / (grid.sum(axis=1) + how.prior)[:, None])
    return Model(frequent, own, follows, count, words, total, vocabulary)


def _neighbours(docs: DataFrame, model: Model, how: Brown) -> DataFrame:
    """word, ending, at, n: how often (n) each class stands before (at < classes) or after each word; of training texts, a row per word and shard."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Table) -> pa.Table:
        m, found = sent.value, []
        for b in chunks(iter(texts.to_batches())):
            t = Tokens(b.column("text"), how)
            unit = units(t.hashes, t.endings, m.frequent, how)
            own = m.classes[unit].astype(np.int64)
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[t.rows[:-1]] = m.classes[how.units - 1]  # an end stands before and after every text
            k = np.flatnonzero((unit >= how.frequent) & (unit < how.units - 1))
            found.append((t.hashes[k], t.endings[k], before[k], how.classes + own[k + 1]))
        hashes, endings, left, right = (np.concatenate(x) for x in zip(*found))
        word, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        wide = 2 * how.classes
        pair, n = np.unique(np.concatenate((inverse * wide + left, inverse * wide + right)), return_counts=True)
        bounds = pa.array(np.searchsorted(pair, np.arange(len(word) + 1) * wide).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(kind))) for x, kind in ((pair % wide, np.int16), (n, np.int32))]
        shard = pa.array([texts.column("shard")[0].as_py()] * len(word), pa.int64())
        return pa.table({"shard": shard, "word": word.view(np.int64), "ending": endings[first].astype(np.int32), "at": lists[0], "n": lists[1]})

    return docs.where("train").groupBy("shard").applyInArrow(run, "shard long, word long, ending int, at array<smallint>, n array<int>")


def _folded(near: DataFrame, parts: int, how: Brown) -> DataFrame:
    """near by part (of the words), summed over the shards in steps of `fan`, until a word has no more than `fan` rows; how many steps follows from the number of shards (as many as parts)."""

    def run(rows: pa.Table) -> pa.Table:
        word, first, inverse = np.unique(rows.column("word").to_numpy(), return_index=True, return_inverse=True)
        lists, many = rows.column("at").combine_chunks(), rows.column("n").combine_chunks()
        wide = 2 * how.classes
        key = np.repeat(inverse, lists.value_lengths().to_numpy()) * wide + lists.flatten().to_numpy()
        pair, at = np.unique(key, return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, many.flatten().to_numpy())
        bounds = pa.array(np.searchsorted(pair, np.arange(len(word) + 1) * wide).astype(np.int32))
        own = {k: pa.array([rows.column(k)[0].as_py()] * len(word), pa.int64()) for k in ("part", "shard")}
        return pa.table({**own, "word": word, "ending": rows.column("ending").to_numpy()[first], "at": pa.ListArray.from_arrays(bounds, pa.array((pair % wide).astype(np.int16))), "n": pa.ListArray.from_arrays(bounds, pa.array(n))})

    near = near.select(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part"), "shard", "word", "ending", "at", F.col("n").cast("array<long>").alias("n"))
    shards = parts
    while shards > how.fan:
        shards = -(-shards // how.fan)
        near = near.withColumn("shard", F.floor(F.col("shard") / how.fan)).groupBy("part", "shard").applyInArrow(run, "part long, shard long, word long, ending int, at array<smallint>, n array<long>")
    return near


def gains(grid: np.ndarray, prior: float) -> np.ndarray:
    """What one neighbour (2 * classes rows: classes before, then after) adds to the likelihood of a word's being in each class."""
    g = grid + prior * (grid.sum(axis=1, keepdims=True) + 1) * (grid.sum(axis=0) + 1) / (grid.sum() + len(grid)) / (grid.sum() + len(grid))
    # a word has as many neighbours before as after: those carry the columns' totals, these the rows'
    return np.concatenate((np.log(g) - np.log(g.sum(axis=0)), (np.log(g) - np.log(g.sum(axis=1))[:, None]).T))


def _word_classes(near: DataFrame, grid: np.ndarray, of_endings: np.ndarray, how: Brown) -> DataFrame:
    """word, cls of every word in near; of_endings: the neighbours that each ending adds."""
    sent = near.sparkSession.sparkContext.broadcast((gains(grid, how.prior), of_endings))

    def run(rows: pa.Table) -> pa.Table:
        gain, added = sent.value
        word, at, inverse = np.unique(rows.column("word").to_numpy(), return_index=True, return_inverse=True)
        ending, lists, many = rows.column("ending").to_numpy(), rows.column("at").combine_chunks(), rows.column("n").combine_chunks()
        inverse = np.repeat(inverse, lists.value_lengths().to_numpy())
        column, n = lists.flatten().to_numpy().astype(np.int64), many.flatten().to_numpy()
        order = np.argsort(inverse, kind="stable")
        ascending = inverse[order]
        value = np.empty((len(word), how.classes), np.float32)
        step = 1 << 14
        for k in range(0, len(word), step):  # rows of a block of words
            a, b = np.searchsorted(ascending, (k, min(k + step, len(word))))
            mine, size = order[a:b], min(step, len(word) - k)
            have = np.bincount((inverse[mine] - k) * 2 * how.classes + column[mine], n[mine], minlength=size * 2 * how.classes)
            value[k : k + size] = (have.reshape(size, -1) + added[ending[at[k : k + size]]]) @ gain
        return pa.table({"word": word, "cls": value.argmax(axis=1).astype(np.int32)})

    return near.groupBy("part").applyInArrow(run, "word long, cls int")


def _class_of(t: Tokens, word: np.ndarray, cls: np.ndarray, m: Model, how: Brown) -> np.ndarray:
    """word: sorted; cls: -1 for words that have their unit's class."""
    own = cls[np.searchsorted(word, t.hashes)]
    return np.where(own >= 0, own, m.classes[units(t.hashes, t.endings, m.frequent, how)])


def _class_pairs(docs: DataFrame, counts: DataFrame, model: Model, how: Brown) -> DataFrame:
    """pair (previous class * classes + class), n: of the training texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        m, total = sent.value, np.zeros(how.classes**2, np.int64)
        word, cls = known.column("word").to_numpy().view(U64), known.column("cls").to_numpy()
        order = np.argsort(word)
        for b in chunks(iter(texts.to_batches())):
            t = Tokens(b.column("text"), how)
            own = _class_of(t, word[order], cls[order], m, how)
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[t.rows[:-1]] = m.classes[how.units - 1]
            total += np.bincount(before * how.classes + own, minlength=len(total))
        return pa.table({"pair": np.arange(len(total)).astype(np.int32), "n": total})

    return docs.where("train").groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(run, "pair int, n long")


def _score(docs: DataFrame, counts: DataFrame, model: Model, how: Brown) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by units and classes

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        m = sent.value
        word, c = known.column("word").to_numpy().view(U64), known.column("c").to_numpy()
        order = np.argsort(word)
        word, c, cls = word[order], c[order], known.column("cls").to_numpy()[order]
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for b in chunks(iter(texts.to_batches())):
            t = Tokens(b.column("text"), how)
            n = c[np.searchsorted(word, t.hashes)]
            base = np.log10((n + 0.5) / (m.total + 0.5 * (m.vocabulary + 1)))
            own = _class_of(t, word, cls, m, how)
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[t.rows[:-1]] = m.classes[how.units - 1]
            emitted = np.log10((n + 0.5) / (m.class_count[own] + 0.5 * (m.class_words[own] + 1)))
            at = t.rows[:-1]
            out["doc_id"].append(b.column("doc_id"))
            out["held_out"].append(pa.array(~b.column("train").to_numpy(zero_copy_only=False)))
            for k, x in (("n_tokens", np.ones(len(n), np.int64)), ("n_known", (n > 0).astype(np.int64)), ("base_score", base), ("score", emitted + m.follows[before, own])):
                out[k].append(pa.array(np.add.reduceat(x, at)))
        return pa.table({k: pa.chunked_array(v) for k, v in out.items()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def language_model(docs: DataFrame, how: Brown = Brown()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of every text."""
    work = Workspace(docs.sparkSession, "brown")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (remainder("doc_id", how.folds) != how.held_out).alias("train"))
    docs = docs.withColumn("shard", shard_of(docs, "doc_id", how.shard_mb))
    met = work.save(_counts(docs, how), "counts")
    # summed before the exchange and joined back, so that a word that every shard has does not meet in one task
    totals = met.groupBy("word").agg(F.sum("n").alias("c"), F.min("shard").alias("least"))
    counted = met.join(totals, "word").select("shard", "word", "ending", "c", (F.col("shard") == F.col("least")).alias("once"))
    counted = work.save(counted, "words")
    work.drop(met)
    met = counted
    known = met.where("once and c > 0")
    per_ending = known.groupBy("ending").agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect()  # at most endings + 1 rows
    total, vocabulary = sum(r["c"] for r in per_ending), sum(r["v"] for r in per_ending)
    top = known.where(F.col("ending") < how.endings).orderBy(F.desc("c"), "word").select("word", "ending").limit(how.frequent).collect()
    frequent = np.sort(np.array([r["word"] for r in top], np.int64).view(U64))
    unit_words = np.zeros(how.units)
    for r in per_ending:
        unit_words[how.frequent + r["ending"]] = r["v"]
    for r in top:
        unit_words[how.frequent + r["ending"]] -= 1
    unit_words[: len(frequent)] = 1
    pairs = np.zeros(how.units**2)
    for r in _pairs(docs, frequent, how).groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most units ** 2 rows
        pairs[r.column("pair").to_numpy()] = r.column("n").to_numpy()
    model = fit(frequent, pairs.reshape(how.units, how.units), unit_words, total, vocabulary, how)
    if total:
        pairs = pairs.reshape(how.units, how.units)
        to_class = np.eye(how.classes)[model.classes]
        endings = slice(how.frequent, how.frequent + how.endings)
        of_endings = np.concatenate(((to_class.T @ pairs[:, endings]).T, pairs[endings] @ to_class), axis=1)
        of_endings *= how.prior / np.maximum(of_endings.sum(axis=1, keepdims=True) / 2, 1)
        parts = met.agg(F.max("shard")).first()[0] + 1
        near = _folded(_neighbours(docs, model, how), parts, how)
        chosen = work.save(_word_classes(near, to_class.T @ pairs @ to_class, of_endings, how), "classes")
        classed = work.save(met.join(chosen, "word", "left").select("shard", "word", "c", "once", F.coalesce("cls", F.lit(-1)).alias("cls")), "classed")
        work.drop(met)
        words = np.bincount(model.classes[[*range(len(frequent)), how.units - 1]], minlength=how.classes).astype(float)
        for r in classed.where("once and cls >= 0").groupBy("cls").count().collect():  # at most `classes` rows
            words[r["cls"]] += r["count"]
        grid = np.zeros(how.classes**2)
        for r in _class_pairs(docs, classed.select("shard", "word", "cls"), model, how).groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most classes ** 2 rows
            grid[r["pair"]] = r["n"]
        model = of_grid(frequent, model.classes, grid.reshape(how.classes, -1), words, total, vocabulary, how)
    else:
        classed = met.withColumn("cls", F.lit(-1))
    scored = _score(docs, classed.select("shard", "word", "c", "cls"), model, how)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
