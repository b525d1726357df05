"""Best-fit packing by minimum bin slack.

Token sequences are cut into pieces of at most `length` tokens. How many pieces there are of each
length is a table of at most `length` rows, so the search for full combinations runs once on that
table, whatever the number of documents: a bitset subset-sum over the lengths still available finds
the fullest bin that holds the longest one, and that bin is repeated as often as the counts allow.
Each piece then finds its place from its rank among the pieces of equal length.

Null texts count as empty (one end token). Repeated rows are packed as often as they occur, rows of
null ids like others. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.llm.textcols import U64, Words, chunks, utf8
from massloom.llm.workspace import Workspace


_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: Letters are a pre-token, and so is the punctuation after them (but an apostrophe can belong to a contraction).
_PLAIN = re.compile(rb"(?:[a-z]|" + _LATIN + rb")+([!-&(-/:-@\[-`{-~]*)")


class Slots:
    """Entry numbers by 64-bit hash, in an open-addressing table that is read and filled a vector at a time."""

    def __init__(self, bits: int):
        self.mask = U64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for unknown ones; keys are not 0."""
        out, left, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            have = self.keys[at]
            hit = have == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (have != 0)
            left, at = left[on], at[on] + 1 & int(self.mask)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct and unknown."""
        at = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], at[~won] + 1 & int(self.mask)


class CachedEncoder:
    """Token ids of texts, by white-space separated chunk with A-Z in lower case.

    Right for tokenizers that lower-case, whose pre-tokenizer drops white space, never joins text across it and keeps letters and
    punctuation apart. The ids of about `most` chunks are remembered, under 64-bit hashes; beyond that
    the chunks not met since the last such moment are forgotten.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.bits = int(2 * most).bit_length()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tok.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.clear()

    def clear(self) -> None:
        """Forget all chunks: a task leaves no memory behind in its worker, which others use after it."""
        self.slots, self.n, self.used = Slots(self.bits), 0, 0
        self.keys, self.first, self.count = np.zeros(1 << 16, U64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.met, self.pool = np.zeros(1 << 16, bool), np.zeros(1 << 18, np.uint32)

    def _ids(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all chunks together, and the start and number of each one's."""
        found = [_PLAIN.fullmatch(w) for w in new]
        plain = np.array([m is not None for m in found], bool)
        ids, count = np.zeros(0, np.uint32), np.zeros(len(new), np.int64)
        if plain.any():
            # these are one or two pre-tokens each: they go together, and the last tokens of pre-tokens tell them apart
            text = b" ".join(w for w, m in zip(new, found) if m).decode()
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = np.cumsum([1 + (m.end(1) > m.start(1)) for m in found if m]) - 1
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == last[-1] + 1:
                count[plain] = np.diff(ends[last], prepend=-1)
            else:
                plain[:], ids = False, ids[:0]
        parts = [e.ids for e in self.tok.encode_batch_fast([w.decode() for w, p in zip(new, plain) if not p], add_special_tokens=False)]
        count[~plain] = [len(x) for x in parts]
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        start = np.zeros(len(new), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate((ids, np.fromiter(itertools.chain.from_iterable(parts), np.uint32))), start, count

    def _remember(self, keys: np.ndarray, flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        n, m, used, size = self.n, len(keys), self.used, len(flat)
        while n + m > len(self.first):
            self.keys, self.first, self.count, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.keys, self.first, self.count, self.met))
        while used + size > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.keys[n : n + m], self.first[n : n + m], self.count[n : n + m] = keys, used + start, count
        self.pool[used : used + size] = flat
        self.slots.add(keys, np.arange(n, n + m))
        self.n, self.used = n + m, used + size

    def _forget(self) -> None:
        stay = np.flatnonzero(self.met[: self.n])
        keys, count = self.keys[stay], self.count[stay].astype(np.int64)
        flat, start = self._take(stay), np.cumsum(count) - count
        self.slots, self.n, self.used = Slots(self.bits), 0, 0
        self.met[:] = False
        self._remember(keys, flat, start, count)

    def _take(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries, one after another."""
        count = self.count[entries].astype(np.int64)
        ends = np.cumsum(count)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[entries] - ends + count, count)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        words = Words(*utf8(texts))
        keys = words.hashes(lower=True)
        keys[keys == 0] = 1
        if self.n > self.most:
            self._forget()
        where = self.slots.find(keys)
        if len(missing := np.flatnonzero(where < 0)):
            new, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            buf = words.buf.tobytes()
            chunks_ = [buf[words.start[k] : words.end[k]].lower() for k in missing[at].tolist()]
            self._remember(new, *self._ids(chunks_))
            where[missing] = self.n - len(new) + back
        self.met[where] = True
        ends = np.concatenate(([0], np.cumsum(self.count[where].astype(np.int64))))
        out = np.split(self._take(where), ends[words.rows[1:-1]]) if len(texts) else []
        if b"<|" in words.buf.tobytes():  # such texts may spell a special token
            for k, t in enumerate(texts.to_pylist()):
                if t and "<|" in t:
                    out[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
        return out


_encoders: dict[str, CachedEncoder] = {}


def _encoder(path: str) -> CachedEncoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece; `part` and `nth` number the pieces of equal length within the task that made them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for b in chunks(batches, limit=1 << 20):
            doc, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "nth", "ids")}
            for k, ids in enumerate(enc.encode(b.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), length)):
                    own = ids[at : at + length]
                    doc.append(k)
                    for name, v in (("piece", piece), ("start", at), ("length", len(own)), ("ids_crc32", zlib.crc32(own.tobytes())), ("nth", seen[len(own)])):
                        out[name].append(int(v))
                    if with_ids:
                        out["ids"].append(own.astype(np.int32))
                    seen[len(own)] += 1
            cols = [b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")), pa.array([part] * len(doc), pa.int32()), pa.array(out["nth"], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                cols, names = [*cols, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)
        enc.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def fullest(have: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, how often) whose sum comes closest to room from below; have: length -> available."""
    reach, steps = 1, []
    for size in sorted((s for s in have if s <= room), reverse=True):
        many, part = min(have[size], room // size), 1
        while many and not reach >> room & 1:
            part = min(part, many)
            steps.append((reach, size, part))
            reach |= (reach << size * part) & ((1 << room + 1) - 1)
            many, part = many - part, part * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, size, part in reversed(steps):
        if not before >> at & 1:
            at -= size * part
            used[size] = used.get(size, 0) + part
    return sorted(used.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as (contents, how many such bins); contents as (length, how often)."""
    have, bins = {k: v for k, v in counts.items() if v}, []
    while have:
        longest = max(have)
        have[longest] -= 1
        inside = dict(fullest({k: v for k, v in have.items() if v}, capacity - longest))
        have[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        times = min(have[k] // m for k, m in inside.items())
        for k, m in inside.items():
            have[k] -= m * times
            if not have[k]:
                del have[k]
        bins.append((sorted(inside.items(), reverse=True), times))
    return bins


def placement(bins: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, how often in a bin, first bin, offset in the bin), by length and rank."""
    rows, rank, first = [], {}, 0
    for inside, times in bins:
        offset = 0
        for size, many in inside:
            rows.append((size, rank.get(size, 0), many, first, offset))
            rank[size] = rank.get(size, 0) + many * times
            offset += size * many
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    tokenizer: the path of a `tokenizers` file that drops white space, present on every machine.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.save(pieces(docs, tokenizer, length, end_id, with_ids), "pieces")
    # at most one row per task and length
    held = work.save(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "held")
    total = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    table = spark.sparkContext.broadcast(placement(minimum_bin_slack(total, length)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select(F.col("part").alias("p_"), F.col("length").alias("l_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, (F.col("part") == F.col("p_")) & (F.col("length") == F.col("l_"))).drop("p_", "l_", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = table.value
        keys = where[:, 0] << 44 | where[:, 1]
        for b in batches:
            size, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            row = where[np.searchsorted(keys, size << 44 | rank, "right") - 1] if len(size) else np.zeros((0, 5), np.int64)
            bin_, slot = np.divmod(rank - row[:, 1], row[:, 2])
            cols = {n: b.column(n) for n in b.schema.names if n != "rank"}
            cols |= {"sequence_id": pa.array(row[:, 3] + bin_), "offset": pa.array(row[:, 4] + slot * size)}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
