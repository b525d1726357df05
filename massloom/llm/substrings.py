"""Substring deduplication with repeated-phrase automata.

A window is `window` consecutive words of a document. Every window names one phrase of `phrase` words in it, the one of
smallest hash (the leftmost of equal ones), so equal windows name equal phrases; only about one phrase in twenty is ever named. Phrases
named in two documents or more are exchanged first; then the windows that name such a phrase, one
row per window and shard of documents, which gives the windows that recur and the smallest document each starts in. So far all is hashes, and only proposes:
the words under a document's recurring windows are passages, which go, as words, to the shards whose documents have them too.
For every shard an Aho-Corasick automaton (pyahocorasick) of its passages, cut into chunks of half a window, streams the words of all of the shard's
documents. Wherever a window of a passage stands in a document, a whole chunk of it does, so every occurrence is found; of the windows around
what was found, those whose words are a window of a smaller document's passage are cut. Only
windows found by the automaton and compared as words decide, and the work follows the words, however often they repeat.

Words are runs of bytes other than ASCII white space. Null texts have no words. Documents without an id are compared with
nothing and keep all words; rows that repeat an id are one document and don't count as each other's copies. Every input row
gives one row, a very long text too (it is a shard's batch by itself); an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.shards import shard_of
from massloom.llm.textcols import U64, Words, chunks, mix, ngrams, utf8
from massloom.llm.workspace import Workspace, small


@dataclass(frozen=True)
class Phrases:
    window: int = 50
    phrase: int = 10
    shard_mb: float = 4.0
    #: Ids of documents that share a phrase, up to this many, are broadcast (8 bytes each); more are joined by shuffle.
    broadcast_ids: int = 1_000_000


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n neighbours."""
    wide = 1
    while wide * 2 <= n:
        x, wide = np.minimum(x[:-wide], x[wide:]), wide * 2
    return np.minimum(x[: len(x) - (n - wide)], x[n - wide :]) if wide < n else x


class Named:
    """Of the texts of a batch: word hashes; per text, window hashes and the place of the phrase that each window names."""

    def __init__(self, texts: pa.Array, how: Phrases):
        self.words = Words(*utf8(texts))
        self.hashes = self.words.hashes()
        self.phrases, self.phrase_rows = ngrams(self.hashes, self.words.rows, how.phrase)
        self.windows, self.window_rows = ngrams(self.hashes, self.words.rows, how.window)
        self.span = how.window - how.phrase + 1

    def text(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window hashes, phrase hashes, and for each window the place of its phrase."""
        own = self.windows[self.window_rows[k] : self.window_rows[k + 1]]
        phrases = self.phrases[self.phrase_rows[k] : self.phrase_rows[k + 1]]
        if not len(own):
            return own, phrases, np.zeros(0, np.int64)
        bits = U64(int(len(phrases)).bit_length())
        ranked = mix(phrases + U64(5)) >> bits << bits | np.arange(len(phrases), dtype=U64)
        return own, phrases, (sliding_min(ranked, self.span) & ((U64(1) << bits) - U64(1))).astype(np.int64)


def _named_phrases(docs: DataFrame, how: Phrases) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            named, ids, found = Named(b.column("text"), how), b.column("doc").to_numpy(), []
            for k in range(b.num_rows):
                _, phrases, at = named.text(k)
                found.append(np.unique(phrases[np.unique(at)]))
            cols = [np.concatenate(found).view(np.int64), np.repeat(ids, [len(x) for x in found])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["phrase", "doc"])

    return docs.mapInArrow(run, "phrase long, doc long")


def _recurring(own: DataFrame, phrases: DataFrame, how: Phrases) -> DataFrame:
    """shard, window, lo, hi: of the windows that name a recurring phrase, the smallest and largest document of the shard."""

    def run(texts: pa.Table, named: pa.Table) -> pa.Table:
        known = np.unique(named.column("phrase").to_numpy().view(U64))
        hashes, ids = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for b in chunks(iter(texts.to_batches())):
            batch, doc = Named(b.column("text"), how), b.column("doc").to_numpy()
            for k in range(b.num_rows):
                own, phrases, at = batch.text(k)
                hit = own[np.isin(phrases, known)[at]] if len(own) else own
                hashes.append(hit)
                ids.append(np.full(len(hit), doc[k]))
        h, d = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
        last = np.append(first[1:], len(h))[: len(first)] - 1
        shard = texts.column("shard")[0] if texts.num_rows else named.column("shard")[0]
        return pa.table({"shard": pa.array([shard.as_py()] * len(first), pa.int64()), "window": h[first].view(np.int64), "lo": d[first], "hi": d[last]})

    return own.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(run, "shard long, window long, lo long, hi long")


def _passages(docs: DataFrame, spans: DataFrame, how: Phrases) -> DataFrame:
    """shard, doc, words: the stretches of each first document that its recurring windows (spans: first, shard, windows) cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            named, lists = Named(b.column("text"), how), b.column("windows")
            buf, shards, ids, found = named.words.buf.tobytes(), [], [], []
            for k, (shard, doc) in enumerate(zip(b.column("shard").to_pylist(), b.column("doc").to_pylist())):
                own = named.windows[named.window_rows[k] : named.window_rows[k + 1]]
                at = np.flatnonzero(np.isin(own, lists[k].values.to_numpy().view(U64)))
                if not len(at):  # another row of the same id
                    continue
                apart = np.flatnonzero(np.diff(at) > how.window)
                lo, hi = at[np.concatenate(([0], apart + 1))], at[np.append(apart, len(at) - 1)] + how.window - 1
                lo, hi = named.words.start[named.words.rows[k] + lo], named.words.end[named.words.rows[k] + hi]
                found += [buf[x:y].decode() for x, y in zip(lo.tolist(), hi.tolist())]
                shards += [shard] * len(lo)
                ids += [doc] * len(lo)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["shard", "doc", "words"])

    firsts = small(spans.select("first").distinct(), how.broadcast_ids)
    own = docs.join(firsts, F.col("doc") == F.col("first"), "left_semi")
    return own.join(spans, F.col("doc") == F.col("first")).select("doc", "text", "shard", "windows").mapInArrow(run, "shard long, doc long, words string")


class Automaton:
    """Of the passages of a shard: (document, words).

    The machine knows each distinct chunk of half a window, so it is no larger, and a document's stream through it no slower, for passages that repeat themselves. Each distinct
    window of the passages is kept once, with a place of the smallest document that has it.
    """

    def __init__(self, passages: list[tuple[int, bytes]], how: Phrases):
        self.how, self.chunk, self.number = how, (how.window + 1) // 2, {}
        parts = [[self.number.setdefault(w, len(self.number) + 1) for w in words.split()] for _, words in passages]
        self.words = np.array([n for own in parts for n in own], np.int32)
        rows = np.concatenate(([0], np.cumsum([len(own) for own in parts], dtype=np.int64)))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for key in {tuple(own[at : at + self.chunk]) for own in parts for at in range(0, len(own) - self.chunk + 1, self.chunk)}:
            self.machine.add_word(key)
        if len(self.machine):
            self.machine.make_automaton()
        names, bounds = ngrams(mix(self.words.astype(U64)), rows, how.window)
        place = np.arange(len(names)) + np.repeat(rows[:-1] - bounds[:-1], np.diff(bounds))
        docs = np.repeat(np.array([doc for doc, _ in passages], np.int64), np.diff(bounds))
        order = np.lexsort((docs, names))
        order = order[np.concatenate((np.ones(min(1, len(order)), bool), names[order][1:] != names[order][:-1]))] if len(order) else order
        self.names, self.place, self.docs = names[order], place[order], docs[order]

    def covered(self, words: list[bytes], doc: int) -> np.ndarray:
        """Which of a document's words are to go: those in windows around a chunk that the machine has found, whose words are those of a smaller document's window."""
        gone, window = np.zeros(len(words), bool), self.how.window
        if not len(self.machine) or len(words) < window or not len(self.names):
            return gone
        numbers = tuple(map(self.number.get, words, repeat(0)))
        ends = np.fromiter((end for end, _ in self.machine.iter(numbers)), np.int64)
        if not len(ends):
            return gone
        own = np.array(numbers, np.int32)
        # a window that holds the chunk that ends at `end` starts from end - window + 1 on, and at its first word at the latest
        edge = np.zeros(len(own) + 1, np.int32)
        np.add.at(edge, np.maximum(ends - window + 1, 0), 1)
        np.add.at(edge, ends - self.chunk + 2, -1)
        starts = np.flatnonzero(np.cumsum(edge)[: len(own) - window + 1])
        names, _ = ngrams(mix(own.astype(U64)), np.array([0, len(own)]), window)
        at = np.minimum(np.searchsorted(self.names, names[starts]), len(self.names) - 1)
        known = (self.names[at] == names[starts]) & (self.docs[at] < doc)
        starts, at = starts[known], self.place[at[known]]
        count = np.zeros(len(own) + 1, np.int64)
        fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(starts)), bool), (np.diff(starts) != 1) | (np.diff(at) != 1))))
        if len(fresh) * 8 < len(starts):  # neighbours here and there: stretches are compared as wholes
            for x, y in zip(fresh.tolist(), np.append(fresh[1:], len(starts)).tolist()):
                s, p, n = int(starts[x]), int(at[x]), y - x + window - 1
                same = np.zeros(n + 2, np.int8)
                same[1:-1] = own[s : s + n] == self.words[p : p + n]
                edge = np.flatnonzero(np.diff(same))
                for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if hi - lo >= window:
                        count[s + lo] += 1
                        count[s + hi] -= 1
        else:
            each = np.arange(window)
            for k in range(0, len(starts), 1 << 13):
                s, p = starts[k : k + (1 << 13)], at[k : k + (1 << 13)]
                s = s[(own[s[:, None] + each] == self.words[p[:, None] + each]).all(1)]
                np.add.at(count, s, 1)
                np.add.at(count, s + window, -1)
        return np.cumsum(count)[:-1] > 0


_OUT = "n_words long, n_removed long, kept string"


def _whole(docs: DataFrame) -> DataFrame:
    """Of documents that are compared with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            split = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            kept = [b" ".join(x).decode() for x in split]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(map(len, split), pa.int64()), pa.array([0] * len(split), pa.int64()), pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(run, f"doc long, {_OUT}")


def _cut(docs: DataFrame, passages: DataFrame, how: Phrases) -> DataFrame:
    """docs: doc, text, shard; passages: shard, doc, words."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        machine = Automaton(list(zip(known.column("doc").to_pylist(), known.column("words").cast(pa.binary()).to_pylist())), how)
        out = []
        for b in chunks(iter(texts.to_batches())):
            n_words, n_removed, kept = [], [], []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                gone = machine.covered(words, doc)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(words, (~gone).tolist()) if n_removed[-1] else words))
            cols = [b.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            out.append(pa.RecordBatch.from_arrays(cols, ["doc", "n_words", "n_removed", "kept"]))
        return pa.Table.from_batches(out, pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return docs.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(run, f"doc long, {_OUT}")


def dedup_substrings(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    work = Workspace(docs.sparkSession, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    named = docs.where("doc is not null")
    every = work.save(_named_phrases(named, how), "phrases")
    # `every` has a phrase once per row of documents
    twice = every.groupBy("phrase").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("phrase")
    shared = work.save(every.join(twice, "phrase"), "shared")
    work.drop(every)
    ids = work.save(shared.select("doc").distinct(), "ids")
    of = shard_of(docs, "doc", how.shard_mb)
    sharded = named.withColumn("shard", of)
    own = sharded.join(small(ids, how.broadcast_ids), "doc", "left_semi")
    phrases = shared.select(of.alias("shard"), "phrase").distinct()
    met = work.save(_recurring(own, phrases, how), "windows")
    work.drop(shared)
    # summed before the exchange: a window that every shard has is no more rows in one task than there are tasks
    first = met.groupBy("window").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last").select("window", "first")
    spans = met.join(first, "window").where("first < hi").groupBy("first", "shard").agg(F.collect_list("window").alias("windows"))
    spans = work.save(spans, "spans")
    work.drop(met, ids)
    passages = work.save(_passages(named, spans, how), "passages")
    work.keep(passages)
    cut = _cut(sharded, passages, how)
    return _whole(docs.where("doc is null")).unionAll(cut).select(F.col("doc").alias("doc_id"), "n_words", "n_removed", "kept")


def removed_report(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(docs, how).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
