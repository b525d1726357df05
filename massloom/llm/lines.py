"""Fuzzy line deduplication.

Lines are split at \\n. A line's normal form is its runs of letters and digits in lower case, joined by spaces: ASCII other than
letters and digits parts words, A-Z and the capitals of Latin-1 are folded, all other characters stand for themselves. Lines with equal
normal forms, of whatever length, are one node, found by aggregation; lines without a word stay. Nodes of at least `min_words` words
are also linked if their normal forms' edit similarity (1 - distance / longer length) reaches `percent`; a Chinese, Japanese or Korean
character counts as a word there.

Candidates are found by SimHash blocks. A line is cut into pieces at its local extremes (a word whose hash is the least of those within `reach` places),
so that a cut moves only if words next to it change; a block is the 64-bit SimHash of
one piece, with the word after it. By the pigeonhole principle
lines that differ in fewer places than they have pieces share a block. All pieces of at least `least` words are a line's blocks, however many they are. A line
of at most `short` words has further blocks, of all its words and of all but each one. The 64-bit SimHashes of two
whole lines of more than `short` words may differ in at most `bits` bits; of their words, as bitmaps tell, at most `unshared` percent may be
in one of them only; and their lengths differ as far as the edit similarity allows. Pairs of lines that share a block are met by hubs (`components.meet_hubs`), each in the first block that both share. Every link is confirmed by edit distance; README has the measured recall of the candidates. Of each connected group the first occurrence, by (doc_id, text's hash, line), stays.

Null texts stay null and empty ones empty. Rows without an id keep all lines. Rows that repeat an id with the same text are one document and
keep the same lines; with different texts they are documents of their own. A very long line or text is handled whole: in a batch by
itself. An empty table gives an empty one. Other columns pass through unchanged, whatever their names (`n_chars`, if there, follows the new text).
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.components import components, meet_hubs, merged
from massloom.llm.edits import bounded, distances_within
from massloom.llm.textcols import PUNCTUATION, U64, Words, chunks, mix, powers, utf8
from massloom.llm.workspace import Workspace, small

#: Ids of a bucket of which all pairs are looked at in one task, and possible pairs for each of its ids that are taken from there; larger or closer buckets are met by hubs.
MOST_FULL, MOST_PAIRS = 2000, 4
#: Documents whose lines are to be confirmed, up to this many, are broadcast; more are joined by shuffle.
BROADCAST_DOCS = 300_000
#: The same for ids (8 bytes each, 16 with their component).
BROADCAST_IDS = 500_000
#: Letters of the shorter sides of pairs that a task compares.
LETTERS = 2_000_000


@dataclass(frozen=True)
class FuzzyLines:
    bits: int = 22
    unshared: int = 25
    percent: int = 80
    min_words: int = 5
    reach: int = 2
    least: int = 3
    short: int = 12


#: A-Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Lines:
    """Lines of a batch of texts: start, end (without the \\n), row of each, number in its row; and their words."""

    def __init__(self, texts: pa.Array):
        self.buf, bounds = utf8(texts)
        size, stops = np.diff(bounds), np.flatnonzero(self.buf == 10)
        rows = np.flatnonzero(size)
        # a text's last line ends where the text does; others end at a \\n
        ends = np.concatenate((stops, bounds[1:][rows]))
        kind = np.concatenate((np.zeros(len(stops), np.int8), np.ones(len(rows), np.int8)))
        order = np.lexsort((kind, ends))
        self.end, last = ends[order], kind[order] == 1
        self.start = np.zeros(len(self.end), np.int64)
        self.start[1:] = np.where(last[:-1], self.end[:-1], self.end[:-1] + 1)
        self.row = rows[np.concatenate(([0], np.cumsum(last)[:-1]))] if len(last) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.row, np.arange(len(size) + 1))
        self.number = np.arange(len(self.row)) - self.first[self.row]

    @functools.cached_property
    def words(self) -> Words:
        low = self.buf.copy()
        capital = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)
        low[1:][capital] += 0x20
        return Words(low, np.concatenate((self.start, [len(low)])), gaps=PUNCTUATION)

    @property
    def n_words(self) -> np.ndarray:
        # between a line's end and the next one's start there is only the \\n, which is a gap
        return np.diff(self.words.rows)

    def worded(self) -> np.ndarray:
        """Which lines have a word."""
        if not len(self.start):
            return np.zeros(0, bool)
        # behind a line there is at most its \\n
        return np.logical_or.reduceat(np.append(~PUNCTUATION[self.buf], False), self.start) & (self.end > self.start)

    def texts(self, which: np.ndarray) -> pa.Array:
        """Some lines as they are."""
        data, bounds = _picked(self.buf, self.end - self.start, which, self.start)
        return _strings(data, bounds)

    def forms(self) -> pa.Array:
        """The normal form of every line; each must have a word."""
        w = self.words
        keep, data = ~PUNCTUATION[w.buf], LOWER[w.buf]
        last = np.zeros(len(w.start), bool)
        last[w.rows[1:] - 1] = True
        gap = w.end[~last]  # behind each word but a line's last there is a gap
        keep[gap], data[gap] = True, 32
        return _strings(data[keep], np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[w.bounds])


class Units:
    """Hashes of the words of some lines, in a row; CJK characters are units of their own. at: first unit of each line, n: how many."""

    def __init__(self, lines: Lines, hashes: np.ndarray, which: np.ndarray):
        w = lines.words
        self.hashes, rows = hashes, w.rows
        lead = np.flatnonzero((w.buf >= 0xE3) & (w.buf <= 0xED))
        if len(lead):
            cut = np.union1d(lead, lead + 3)
            word = np.searchsorted(w.start, cut, "right") - 1
            cut = cut[(word >= 0) & (cut < w.end[word])]
            parts = Words(w.buf, w.bounds, gaps=PUNCTUATION)
            parts.start = np.union1d(w.start, cut)
            parts.end = np.minimum(np.append(parts.start[1:], len(w.buf)), w.end[np.searchsorted(w.start, parts.start, "right") - 1])
            self.hashes, rows = parts.hashes(lower=True), np.searchsorted(parts.start, w.bounds)
        n = np.diff(rows)[: len(lines.n_words)]
        if not which.all():
            self.hashes = self.hashes[np.repeat(which, n)]
        self.n = n[which]
        self.at = np.cumsum(self.n) - self.n


def lanes(hashes: np.ndarray, at: np.ndarray, n: np.ndarray, bits: int = 16) -> np.ndarray:
    """How often each of 64 bits is set in the runs of n (fewer than 2 ** bits) hashes that begin at `at`: (bits, runs), counters of so many bits side by side."""
    mask, out, total = U64(sum(1 << k for k in range(0, 64, bits))), np.empty((bits, len(at)), U64), np.zeros(len(hashes) + 1, U64)
    for k in range(bits):
        np.cumsum(hashes >> U64(k) & mask, out=total[1:])  # counters run over, their differences don't
        out[k] = total[at + n] - total[at]
    return out


def majority_of_bytes(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same of counters of 8 bits."""
    mask, out = U64(0x0101010101010101), np.zeros(len(n), U64)
    more = (0x7F - n // 2).astype(U64) * mask
    for k in range(8):
        out |= (ones[k] + more >> U64(7) & mask) << U64(k)
    return out


def majority(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits that are set in more than half of n, of counts by lanes()."""
    mask, out = U64(0x0001000100010001), np.zeros(len(n), U64)
    more = (0x7FFF - n // 2).astype(U64) * mask  # lifts a counter's highest bit if it is more than half
    for k in range(16):
        out |= (ones[k] + more >> U64(15) & mask) << U64(k)
    return out


def simhashes(hashes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Majority of each bit over each line's word hashes; at: first word of each line, n: how many (at least 1)."""
    if not len(at):
        return np.zeros(0, U64)
    if n.max() < 1 << 15:
        return majority(lanes(hashes, at, n), n)
    out = np.zeros(len(at), U64)
    for k in range(64):
        ones = np.add.reduceat((hashes >> U64(k) & U64(1)).astype(np.int64), at)
        out |= (2 * ones > n).astype(U64) << U64(k)
    return out


def cuts(units: Units, reach: int) -> np.ndarray:
    """Which units begin a piece: the first of each line, and local extremes."""
    rank, begin = mix(units.hashes + U64(3)), np.zeros(len(units.hashes), bool)
    begin[units.at] = True
    row, low = np.repeat(np.arange(len(units.n), dtype=np.int32), units.n), np.ones(len(rank), bool)
    for k in range(1, reach + 1):
        same = row[k:] == row[:-k]
        low[:-k] &= ~same | (rank[:-k] <= rank[k:])
        low[k:] &= ~same | (rank[k:] < rank[:-k])
    return begin | low


def blocks(units: Units, how: FuzzyLines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of each line; line and hash of each of its blocks (lines ascending; a line that repeats a piece has its block again)."""
    if not len(units.n):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    begin = np.flatnonzero(cuts(units, how.reach))
    size, line = np.diff(begin, append=len(units.hashes)), np.repeat(np.arange(len(units.n)), units.n)[begin]
    if size.max() < 1 << 8 and units.n.max() < 1 << 15:
        ones, half = lanes(units.hashes, begin, size, 8), U64(0x00FF00FF00FF00FF)
        total = np.zeros((16, len(begin) + 1), U64)  # of each line's pieces in counters of 16 bits
        np.cumsum(ones & half, axis=1, out=total[:8, 1:])
        np.cumsum(ones >> U64(8) & half, axis=1, out=total[8:, 1:])
        at = np.searchsorted(line, np.arange(len(units.n) + 1))
        piece, whole = majority_of_bytes(ones, size), majority(total[:, at[1:]] - total[:, at[:-1]], units.n)
    elif size.max() < 1 << 15 and units.n.max() < 1 << 15:
        ones = lanes(units.hashes, begin, size)
        piece, whole = majority(ones, size), majority(np.add.reduceat(ones, np.searchsorted(line, np.arange(len(units.n))), axis=1), units.n)
    else:
        piece, whole = simhashes(units.hashes, begin, size), simhashes(units.hashes, units.at, units.n)
    use = size >= how.least
    after = units.hashes[np.minimum(begin + size, len(units.hashes) - 1)] * (begin + size < (units.at + units.n)[line])
    keys, rows = [mix(piece + mix(after + size.astype(U64)))[use]], [line[use]]
    for n in range(how.min_words, how.short + 1):
        own = np.flatnonzero(units.n == n)
        if not len(own):
            continue
        h, place = units.hashes[units.at[own][:, None] + np.arange(n)], mix(np.arange(1, n + 1, dtype=U64))
        left, right = np.zeros((len(own), n + 1), U64), np.zeros((len(own), n), U64)
        np.cumsum(mix(h + place), axis=1, out=left[:, 1:])
        if n > 1:
            right[:, :-1] = np.cumsum(mix(h[:, 1:] + place[:-1])[:, ::-1], axis=1)[:, ::-1]
        keys += [left[:, n], (left[:, :n] + right).ravel()]  # the whole line, and all words but each one
        rows += [own, np.repeat(own, n)]
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(row.astype(np.uint16) if len(units.n) < 1 << 16 else row, kind="stable")
    return whole, row[order], key[order]


#: Odd; a form is named by two sums of its words' hashes times powers of these.
NAME_BASES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
NAME_BASES_INV = tuple(pow(base, -1, 1 << 64) for base in NAME_BASES)
CELLS = 256
BITMAP = [f"p{k}" for k in range(CELLS // 64)]


def bitmaps(units: Units) -> np.ndarray:
    """Of each line (n, 4) whether the number of words in each of 256 cells is odd; a word that only one of two lines has changes one bit."""
    cell = (mix(units.hashes + U64(9)) & U64(CELLS - 1)).astype(np.int64)
    line = np.repeat(np.arange(len(units.n)), units.n)
    odd = np.bincount(line * CELLS + cell, minlength=len(units.n) * CELLS).reshape(-1, CELLS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The stretches of data (8 bytes an entry) between bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The stretches of UTF-8 data between bounds."""
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def _joined(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    parts = []
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(x):
            bounds = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)
            parts.append(np.frombuffer(x.buffers()[2] or b"", np.int64, (int(bounds[-1]) - int(bounds[0])) // 8, int(bounds[0])))
    return np.concatenate([np.zeros(0, np.int64), *parts]).reshape(-1, width)


def _gathered(found: Iterator[tuple[np.ndarray, ...]], limit: int = 8 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """The same arrays, some joined until they have `limit` bytes."""
    have, size = [], 0
    for x in found:
        have.append(x)
        size += sum(y.nbytes for y in x)
        if size > limit:
            yield tuple(map(np.concatenate, zip(*have)))
            have, size = [], 0
    if have:
        yield tuple(map(np.concatenate, zip(*have)))


def _dealt(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows by the shard of their key; where each shard's rows begin there, and their end; the shards."""
    shard = (np.ascontiguousarray(key).view(U64) % U64(shards)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return order, np.append(at, len(order)), pa.array(shard[order][at], pa.int32())


def _picked(data: np.ndarray, many: np.ndarray, rows: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with `many` entries each, one behind the other or from `start` on, the entries of some rows in their order, and their bounds."""
    start, size = np.cumsum(many) - many if start is None else start, many[rows]
    bounds = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(start[rows] - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def _first_lines(docs: DataFrame, how: FuzzyLines, shards: int) -> DataFrame:
    """One row per normal form: the first line that has it (d, h, l), characters n, words w, SimHash s and bitmap (null for short ones), blocks keys (8 bytes each).

    Forms of a batch go to the shards of their names, a batch's share of a shard as one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in chunks(batches):
            lines = Lines(b.column("text"))
            w = lines.words
            keep = np.flatnonzero(lines.n_words)
            if not len(keep):
                continue
            hashes, n = w.hashes(lower=True), lines.n_words[keep]
            at = np.cumsum(n) - n
            total, names = np.zeros(len(hashes) + 1, U64), []
            for base, inverse in zip(NAME_BASES, NAME_BASES_INV):
                np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
                names.append(mix((total[at + n] - total[at]) * powers(inverse, len(hashes))[at] + n.astype(U64)))
            k1, k2 = names
            doc, text = (b.column(c).to_numpy()[lines.row[keep]] for c in ("doc_id", "h"))
            number = lines.number[keep]
            order = np.lexsort((number, text, doc, k2, k1))
            same = np.concatenate((np.ones(1, bool), (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)))
            own = np.sort(order[same])
            within_char = np.concatenate(([0], np.cumsum((w.buf & 0xC0) == 0x80, dtype=np.int32)))
            letters = w.end - w.start - (within_char[w.end] - within_char[w.start])
            sizes = np.add.reduceat(letters, at) + n - 1
            which = np.zeros(len(lines.n_words), bool)
            which[keep[own]] = True
            units = Units(lines, hashes, which)
            fuzzy = np.flatnonzero(units.n >= how.min_words)
            if len(fuzzy) < len(units.n):
                mine = np.repeat(units.n >= how.min_words, units.n)
                units.hashes, units.n = units.hashes[mine], units.n[fuzzy]
                units.at = np.cumsum(units.n) - units.n
            whole, line, key = blocks(units, how)
            sim, many = np.zeros(len(own), U64), np.zeros(len(own), np.int64)
            sim[fuzzy], many[fuzzy] = whole, np.bincount(line, minlength=len(fuzzy))
            words, sketch = np.zeros(len(own), np.int64), np.zeros((len(own), len(BITMAP)), np.int64)
            words[fuzzy], sketch[fuzzy] = units.n, bitmaps(units)
            table = np.column_stack([k1[own].view(np.int64), k2[own].view(np.int64), doc[own], text[own], number[own] << 32 | sizes[own], words << 32 | many, sim.view(np.int64), sketch])
            yield table, key.view(np.int64)

    def parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in _gathered(run(batches)):
            order, at, shard = _dealt(table[:, 0], shards)
            keys, bounds = _picked(key, table[:, 5] & 0xFFFFFFFF, order)
            yield pa.RecordBatch.from_arrays([shard, _binary(table[order], at * table.shape[1]), _binary(keys, bounds[at])], ["shard", "rows", "keys"])

    def once(found: pa.Table) -> pa.Table:
        rows, keys = _joined(found.column("rows"), 7 + len(BITMAP)), _joined(found.column("keys"), 1)[:, 0]
        k1, k2, d, h, at, many = rows.T[:6]
        order = np.lexsort((at, h, d, k2, k1))
        own = order[np.concatenate((np.ones(1, bool), (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)))]
        words, low = many[own] >> 32, 0xFFFFFFFF
        cols = [d[own], h[own], (at[own] >> 32).astype(np.int32), (at[own] & low).astype(np.int32), words.astype(np.int32)]
        masked = [pa.array(x, mask=words <= how.short) for x in rows[own, 6:].T]
        return pa.Table.from_arrays([*map(pa.array, cols), *masked, _binary(*_picked(keys, many & low, own))], ["d", "h", "l", "n", "w", "s", *BITMAP, "keys"])

    dealt = docs.select("doc_id", "h", "text").mapInArrow(parcels, "shard int, rows binary, keys binary")
    return dealt.groupBy("shard").applyInArrow(once, f"d bigint, h bigint, l int, n int, w int, s bigint, {', '.join(f'{p} bigint' for p in BITMAP)}, keys binary")


def _pairs_of(at: np.ndarray, many: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of places in buckets of `many` rows from `at` on, about `limit` at a time: first and second place, and the bucket."""
    cost = np.cumsum(many * (many - 1) // 2)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + limit, "right")))
        own = np.arange(begin, end)
        of = np.repeat(own, many[own])
        place = np.arange(len(of)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        left, behind = at[of] + place, many[of] - 1 - place
        first = np.repeat(left, behind)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(behind) - behind, behind), np.repeat(of, behind)
        begin = end


def _near(how: FuzzyLines, n: np.ndarray, s: np.ndarray, brief: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lengths n and SimHashes s (of lines that aren't brief) of places x and y let them be linked."""
    out = np.abs(n[x] - n[y]) <= np.maximum(n[x], n[y]) * (100 - how.percent) // 100
    return out & (brief[x] | brief[y] | (np.bitwise_count(s[x].view(U64) ^ s[y].view(U64)) <= how.bits))


def _across(rest: DataFrame, how: FuzzyLines, shards: int) -> DataFrame:
    """a, b of the ids of a bucket that are in different components and that lengths, SimHashes and bitmaps let be linked; rest: bucket, id, s, n, w, bitmap, component."""

    def meet(found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        key, id_, component, n, w = (found.column(c).to_numpy() for c in ("bucket", "id", "component", "n", "w"))
        brief, (s, *bitmap) = found.column("s").is_null().to_numpy(), (found.column(c).fill_null(0).to_numpy() for c in ("s", *BITMAP))
        # so many bits differ, on average, if that share of the words is in one line only
        expected = (1 - np.exp(np.arange(2 * int(w.max()) + 1) * (-2 * how.unshared / 100 / CELLS))) * (CELLS / 2)
        at, pairs = np.flatnonzero(np.concatenate((np.ones(1, bool), np.diff(key) != 0))), [np.zeros((0, 2), np.int64)]
        for x, y, _ in _pairs_of(at, np.diff(at, append=len(key))):
            apart = component[x] != component[y]
            x, y = x[apart], y[apart]
            near = _near(how, n, s, brief, x, y)
            x, y = x[near], y[near]
            odd = sum(np.bitwise_count((p[x] ^ p[y]).view(U64)).astype(np.int64) for p in bitmap)
            near = brief[x] | brief[y] | (odd <= expected[w[x] + w[y]])
            a, b = id_[x[near]], id_[y[near]]
            pairs.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
        pairs = np.concatenate(pairs)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(meet, "a bigint, b bigint")


def _met(nodes: DataFrame, how: FuzzyLines, shards: int) -> DataFrame:
    """What the lines that share a block (bucket) have to do with each other; blocks of one line give nothing.

    a, b, star: two ids that lengths and SimHashes let be linked, and whether one is the least of a bucket that both share. All such pairs of a bucket are there if it has
    at most MOST_FULL ids and MOST_PAIRS times as many pairs as ids; of other buckets those with the least id, and a, bucket, s, n for each other id, with star for buckets of more than MOST_FULL ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
        for b in batches:
            keys = b.column("keys")
            many = np.diff(np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]) // 8
            own = np.column_stack([b.column(c).to_numpy() for c in ("id", "s", "size")])
            yield (np.column_stack([_joined(keys, 1), np.repeat(own, many, axis=0)]),)

    def parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (table,) in _gathered(run(batches)):
            if len(table):
                order, at, shard = _dealt(table[:, 0], shards)
                yield pa.RecordBatch.from_arrays([shard, _binary(table[order], at * table.shape[1])], ["shard", "rows"])

    def meet(found: pa.Table) -> pa.Table:
        rows = _joined(found.column("rows"), 4)
        order = np.argsort(rows[:, 0])
        same = np.diff(rows[order, 0]) == 0
        rows = rows[order[np.append(same, False) | np.insert(same, 0, False)]]  # most blocks have one line
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate((np.ones(min(1, len(rows)), bool), (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)))]
        key, id_, s = rows.T[:3].copy()
        n, brief = rows[:, 3] & 0xFFFFFFFF, rows[:, 3] >> 32 <= how.short
        first = np.concatenate((np.ones(min(1, len(rows)), bool), np.diff(key) != 0))
        at = np.flatnonzero(first)
        many = np.diff(at, append=len(key))

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return _near(how, n, s, brief, x, y)

        full, pairs = many <= MOST_FULL, []
        whole = np.flatnonzero(full)
        for x, y, of in _pairs_of(at[whole], many[whole]):
            possible = near(x, y)
            x, y, of = x[possible], y[possible], whole[of[possible]]
            full &= np.bincount(of, minlength=len(at)) <= MOST_PAIRS * many
            pairs.append(np.column_stack([id_[x], id_[y], ~first[x]])[full[of] | first[x]])
        other = np.flatnonzero(~first & np.repeat(~full, many))
        hub, far = np.repeat(at, many)[other], np.repeat(many > MOST_FULL, many)[other]
        met = far & near(hub, other)
        pairs = np.concatenate([np.zeros((0, 3), np.int64), *pairs, np.column_stack([id_[hub[met]], id_[other[met]], np.zeros(met.sum(), np.int64)])])
        pairs = pairs[np.lexsort(pairs.T[::-1])]
        pairs = pairs[np.concatenate((np.ones(min(1, len(pairs)), bool), (np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 0)))]
        none, own = pa.nulls(len(pairs)), pa.table({"a": id_[other], "bucket": key[other], "s": pa.array(s[other], mask=brief[other]), "n": n[other].astype(np.int32)})
        linked = pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "star": pairs[:, 2] == 0, **{c: none.cast(own.schema.field(c).type) for c in ("bucket", "s", "n")}})
        own = own.add_column(1, "b", pa.nulls(len(other), pa.int64())).add_column(2, "star", pa.array(np.repeat(many > MOST_FULL, many)[other]))
        return pa.concat_tables([linked, own])

    size = F.shiftleft(F.col("w").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    dealt = nodes.select("id", F.coalesce("s", F.lit(0).cast("long")).alias("s"), size.alias("size"), "keys").mapInArrow(parcels, "shard int, rows binary")
    return dealt.groupBy("shard").applyInArrow(meet, "a bigint, b bigint, star boolean, bucket bigint, s bigint, n int")


def _forms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, form, words w and bitmap of the lines in wanted (d, h, lines), again for each row that repeats a document."""
    own = ["id", "w", *BITMAP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            lines, asked = Lines(b.column("text")), b.column("lines")
            row, of = np.repeat(np.arange(b.num_rows), asked.value_lengths().to_numpy()), asked.flatten()
            # only the lines that are asked for are parted into words
            forms = Lines(lines.texts(lines.first[row] + of.field("l").to_numpy())).forms()
            yield pa.RecordBatch.from_arrays([*map(of.field, own), forms], [*own, "form"])

    wanted = small(wanted.withColumnRenamed("h", "wanted_h"), BROADCAST_DOCS)
    joined = docs.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("wanted_h"))).select("text", "lines")
    return joined.mapInArrow(run, f"id bigint, w int, {', '.join(f'{p} bigint' for p in BITMAP)}, form string")


def _gathered_pairs(batches: Iterator[pa.RecordBatch], limit: int = 16 << 20) -> Iterator[pa.Table]:
    """Pairs are compared many at once: batches of about `limit` bytes."""
    have, size = [], 0
    for batch in batches:
        have.append(batch)
        size += batch.nbytes
        if size > limit:
            yield pa.Table.from_batches(have)
            have, size = [], 0
    if have:
        yield pa.Table.from_batches(have)


def _confirmed(work: Workspace, pairs: DataFrame, how: FuzzyLines) -> DataFrame:
    """a, b of the pairs (a, b, a_form, b_form) whose forms are similar enough. Those that aren't told by a bound of their distance are compared with others of like length."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered_pairs(batches):
            forms = list(zip(found.column("a_form").to_pylist(), found.column("b_form").to_pylist()))
            most = [max(len(x), len(y)) * (100 - how.percent) // 100 for x, y in forms]
            near, open_ = bounded(forms, most)
            rows = np.concatenate((np.flatnonzero(near), [k for k, _ in open_])).astype(np.int64)
            none = [None] * int(near.sum())
            cols = [none + [x for _, (x, _) in open_], none + [y for _, (_, y) in open_], none + [most[k] for k, _ in open_], none + [len(x) for _, (x, _) in open_]]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(found.column(c).combine_chunks().take(rows) for c in "ab"), *map(pa.array, cols, kinds)], ["a", "b", "short", "long", "most", "size"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered_pairs(batches):
            keep = distances_within(list(enumerate(zip(found.column("short").to_pylist(), found.column("long").to_pylist()))), found.column("most").to_pylist())
            yield pa.RecordBatch.from_arrays([found.column(c).combine_chunks() for c in "ab"], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = work.save(pairs.select("a", "b", "a_form", "b_form").mapInArrow(told, "a bigint, b bigint, short string, long string, most int, size int"), "told")
    known, rest = pairs.where("size is null").select("a", "b"), pairs.where("size is not null")
    letters = rest.agg(F.sum("size")).first()[0] or 0
    if not letters:
        return known
    alike = rest.repartitionByRange(1 + int(letters / LETTERS), "size").mapInArrow(compared, "a bigint, b bigint")
    return known.unionAll(alike)


def kept_lines(work: Workspace, docs: DataFrame, how: FuzzyLines) -> DataFrame:
    """d, h, lines: of the lines with a word of each document (id and hash of its text), the numbers of those that stay."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("doc_id is not null")
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = work.save(_first_lines(named, how, shards).withColumn("id", F.monotonically_increasing_id()), "nodes")
    met = work.save(_met(nodes, how, shards), "met")
    pairs = work.save(met.where("b is not null").groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    rest = met.where("b is null").select("bucket", F.col("a").alias("id"), "s", "n", F.col("star").alias("large"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(rest.select("id")).distinct()
    shared = work.save(nodes.join(ids, "id", "left_semi").select("id", "d", "h", "l", "w", *BITMAP), "shared")
    rest = work.save(rest.join(shared.select("id", "w", *BITMAP), "id"), "rest")
    work.drop(met)
    wanted = work.save(shared.groupBy("d", "h").agg(F.collect_list(F.struct("id", "l", "w", *BITMAP)).alias("lines")), "wanted")
    forms = work.save(_forms(named, wanted), "forms")
    if forms.count() > shared.count():
        forms = work.save(forms.dropDuplicates(["id"]), "forms")

    def alike(a: str, b: str) -> Column:
        odd = sum((F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in BITMAP), F.lit(0))
        # so many bits differ, on average, if that share of the words is in one line only
        expected = (1 - F.exp((F.col(f"{a}w") + F.col(f"{b}w")) * (-2 * how.unshared / 100 / CELLS))) * (CELLS / 2)
        return F.coalesce(odd <= expected, F.lit(True))

    def possible(a: str, b: str) -> Column:
        n, m = F.col(f"{a}n"), F.col(f"{b}n")
        near = F.bit_count(F.col(f"{a}s").bitwiseXOR(F.col(f"{b}s"))) <= how.bits
        return (F.abs(n - m) <= (F.greatest(n, m) * (100 - how.percent) / 100).cast("int")) & F.coalesce(near, F.lit(True)) & alike(a, b)

    def links(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        own = forms.join(small(asked, BROADCAST_IDS), "id", "left_semi")
        a, b = (own.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("form", "w", *BITMAP))) for x in "ab")
        return _confirmed(work, pairs.select("a", "b").join(a, "a").join(b, "b").where(alike("a_", "b_")), how)

    # a bucket's ids are held against its least one; after that, other pairs only if they aren't in one component yet
    label = components(work, work.save(links(pairs.where("star")), "found"))
    known = small(label.select("id", "component"), BROADCAST_IDS)
    others = pairs.where("not star").select("a", "b")
    for x in "ab":
        others = others.join(known.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")), x, "left")
    others = others.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    full = rest.where("not large").join(known, "id", "left").select("bucket", "id", "s", "n", "w", *BITMAP, F.coalesce("component", "id").alias("component"))
    others = work.save(others.unionAll(_across(full, how, shards)).distinct(), "others")
    found = work.save(links(others), "found")
    if found.limit(1).count():
        label = merged(work, label, found)
    large = work.save(rest.where("large").drop("large"), "large")
    label = meet_hubs(work, large, label, possible, links, turns=(32, 256, "rest"), once=True)
    labelled = work.save(shared.select("id", "d", "h", "l").join(label, "id").select("component", F.struct("d", "h", "l").alias("line")), "labelled")
    later = labelled.join(labelled.groupBy("component").agg(F.min("line").alias("first")), "component").where("line <> first")
    every = nodes.select("d", "h", F.col("l").alias("here"), F.lit(None).cast("int").alias("gone")).unionAll(later.select("line.d", "line.h", F.lit(None).cast("int"), "line.l"))
    return every.groupBy("d", "h").agg(F.array_except(F.collect_list("here"), F.collect_list("gone")).alias("lines"))


def _shortened(docs: DataFrame, how: FuzzyLines) -> tuple[DataFrame, str]:
    work = Workspace(docs.sparkSession, "lines")
    stay = work.save(kept_lines(work, docs, how), "stay")
    work.keep(stay)
    name = next(n for n in itertools.chain(["stay"], (f"stay{k}" for k in itertools.count())) if not {n, f"{n}_d", f"{n}_h"} & {*docs.columns})
    stay = stay.select(F.col("d").alias(f"{name}_d"), F.col("h").alias(f"{name}_h"), F.col("lines").alias(name))
    on = (docs["doc_id"].cast("long") == F.col(f"{name}_d")) & (F.xxhash64(docs["text"]) == F.col(f"{name}_h"))
    return docs.join(stay, on, "left").drop(f"{name}_d", f"{name}_h"), name


def _cut(batch: pa.RecordBatch, stay: str) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Of each row the text that is left, its number of lines before, and how many went."""
    lines, texts = Lines(batch.column("text")), batch.column("text").cast(pa.binary()).to_pylist()
    gone = lines.worded()
    lists = batch.column(stay)
    kept, size = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
    gone[lines.first[np.repeat(np.arange(len(size)), size)] + kept] = False
    gone[~batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[lines.row]] = False
    n_gone = np.bincount(lines.row[gone], minlength=len(texts))
    n_lines = np.diff(lines.first) + np.array([t == b"" for t in texts], int)
    for k in np.flatnonzero(n_gone):
        data = texts[k].split(b"\n")
        texts[k] = b"\n".join(x for x, g in zip(data, gone[lines.first[k] : lines.first[k + 1]].tolist()) if not g)
    return texts, n_lines, n_gone


def line_report(docs: DataFrame, how: FuzzyLines = FuzzyLines()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the UTF-8 text that is left; null for a null text)."""
    held, name = _shortened(docs.select("doc_id", "text"), how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts, n_lines, n_gone = _cut(b, name)
            sha = [None if t is None else hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_lines), pa.array(n_gone), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return held.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_removed long, kept_sha256 string")


def dedup_lines(docs: DataFrame, how: FuzzyLines = FuzzyLines()) -> DataFrame:
    """docs with shortened texts; a document of which every line went is dropped."""
    held, name = _shortened(docs, how)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts, _, n_gone = _cut(b, name)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            stays = pa.array([not (gone and not t.strip()) for t, gone in zip(texts, n_gone)], pa.bool_())
            cols = {c: new if c == "text" else b.column(c) for c in columns}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t.decode()) for t in texts], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(stays)

    return held.mapInArrow(run, T.StructType(docs.schema.fields))
