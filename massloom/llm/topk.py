"""Exact top-k inner products by block-at-a-time pruning.

Every vector component is a term, and vectors, in an order that puts like ones side by side, are cut into blocks of neighbouring places. A block keeps
its vectors (its forward index), and of every term the largest and the smallest value. Summed over a query's terms, the larger of query value times either
is a bound that no score in the block exceeds. A query takes blocks by falling bound, scores all vectors of a block from its
forward index, and stops where the bound falls below its kth best score; a block with just that bound counts only if it has a smaller id.

Blocks lie in strips of some MB, one row each of a written table. First, queries meet the strip they are in themselves, without a shuffle; that gives each a kth score
to start from. Then packs of queries meet the bounds of whole strips, and only packs with a query that a strip could still improve go there. Strips and packs are
both bounded, and met in groups of one strip and some packs, however many there are of either; no vectors, queries or links are collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.vectors import dimensions, integers, products, whole_vectors
from massloom.llm.workspace import Workspace

_NO_ID = np.iinfo(np.int64).max
_NO_SCORE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class TopK:
    k: int = 5
    scale: int = 256
    block_rows: int = 64
    strip_blocks: int = 128
    pack_queries: int = 1024
    #: Packs that a task has at a time, beside one strip.
    packs: int = 16
    #: Strips whose bounds a task has at a time.
    lane_strips: int = 1024
    #: Vectors by which all are ordered: those of the least hashes. They decide which vectors are neighbours, never a result.
    pivots: int = 256


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _unpack(x: bytes, kind: type, width: int = 0) -> np.ndarray:
    out = np.frombuffer(x, kind)
    return out.reshape(-1, width) if width else out


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, a score that no vector of the block exceeds."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


class Strip:
    """Consecutive blocks: ids, vectors, and term maxima and minima of each block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block_rows: int):
        self.ids, self.vectors = ids, vectors
        self.at = np.arange(0, len(ids), block_rows)
        self.high, self.low = np.maximum.reduceat(vectors, self.at), np.minimum.reduceat(vectors, self.at)
        self.first = np.minimum.reduceat(ids, self.at)
        self.rows = block_rows
        self.scored = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """scores and ids, k a query, best first, of what is better than `least` (scores and ids of the kth so far); places that stay empty have the id _NO_ID."""
        m = len(queries)
        score, ident = np.full((m, k), _NO_SCORE), np.full((m, k), _NO_ID)
        low_score, low_id = (x.copy() for x in least) if least is not None else (score[:, -1].copy(), ident[:, -1].copy())
        most = bounds(queries, self.high, self.low)
        order = np.argsort(-most, axis=1, kind="stable")
        most = np.take_along_axis(most, order, axis=1)
        alive, done, step = np.arange(m), 0, 1
        while done < len(self.at) and len(alive):
            alive = alive[most[alive, done] >= low_score[alive]]  # all later blocks have lower bounds
            block, bound = order[alive, done : done + step], most[alive, done : done + step]
            possible = (bound > low_score[alive, None]) | ((bound == low_score[alive, None]) & (self.first[block] < low_id[alive, None]))
            row, place = np.nonzero(possible)
            block, row = block[row, place], alive[row]
            found = []
            by_block = np.argsort(block, kind="stable")
            for of in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
                if len(of):
                    q, at = row[of], self.at[block[of[0]]]
                    ids = self.ids[at : at + self.rows]
                    got = products(queries[q], self.vectors[at : at + self.rows])
                    self.scored += got.size
                    better = ((got > low_score[q, None]) | ((got == low_score[q, None]) & (ids < low_id[q, None]))) & (ids != own[q, None])
                    a, b = np.nonzero(better)
                    found.append((q[a], got[a, b], ids[b]))
            done, step = done + step, step * 2
            if found:
                q, s, i = (np.concatenate(x) for x in zip(*found))
                hit = np.unique(q)
                q = np.concatenate((q, np.repeat(hit, k)))
                s, i = np.concatenate((s, score[hit].ravel())), np.concatenate((i, ident[hit].ravel()))
                by = np.lexsort((i, -s, s == _NO_SCORE, q))
                q, s, i = q[by], s[by], i[by]
                start = np.searchsorted(q, hit)
                keep = (start[:, None] + np.arange(k)).ravel()  # a query has k rows at least: those it had
                score[hit], ident[hit] = s[keep].reshape(-1, k), i[keep].reshape(-1, k)
                full = score[:, -1] > _NO_SCORE
                low_score[full], low_id[full] = score[full, -1], ident[full, -1]
        return score, ident


def _strips(own: DataFrame, work: Workspace, how: TopK, dims: int) -> DataFrame:
    """strip, n, ids, vectors, high, low (of the whole strip), first, asks (which rows are queries): one row for each strip."""
    drawn = own.orderBy(F.xxhash64("id", "embedding"), "id", "embedding").limit(how.pivots).select("embedding").collect()
    pivots = integers(pa.array([r[0] for r in drawn], pa.list_(pa.float64())), how.scale, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("embedding"), how.scale, dims)
            near = products(x, pivots)
            one = near.argmax(1)
            near[np.arange(len(x)), one] = _NO_SCORE
            cell = one * len(pivots) + near.argmax(1)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(x), [None, pa.py_buffer(_pack(x.astype(np.int32)))])
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("id"), b.column("asks"), rows.cast(pa.binary())], ["cell", "id", "asks", "vector"])

    cells = own.mapInArrow(place, "cell long, id long, asks boolean, vector binary")
    ordered = cells.repartitionByRange("cell", "id", "vector").sortWithinPartitions("cell", "id", "vector")
    most = how.block_rows * how.strip_blocks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []

        def strip(rows: pa.Table) -> pa.RecordBatch:
            nonlocal n
            ids, asks = rows.column("id").to_numpy(), rows.column("asks").to_numpy(zero_copy_only=False)
            vectors = b"".join(rows.column("vector").to_pylist())
            x = _unpack(vectors, np.int32, dims)
            n += 1
            row = [part << 32 | n, len(ids), _pack(ids), vectors, _pack(x.max(0)), _pack(x.min(0)), int(ids.min()), _pack(asks)]
            return pa.RecordBatch.from_pylist([dict(zip(("strip", "n", "ids", "vectors", "high", "low", "first", "asks"), row))], pa.schema({"strip": pa.int64(), "n": pa.int32(), "ids": pa.binary(), "vectors": pa.binary(), "high": pa.binary(), "low": pa.binary(), "first": pa.int64(), "asks": pa.binary()}))

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= most:
                rows = pa.Table.from_batches(held)
                while rows.num_rows >= most:
                    yield strip(rows.slice(0, most))
                    rows = rows.slice(most)
                held = rows.to_batches()
        if sum(x.num_rows for x in held):
            yield strip(pa.Table.from_batches(held))

    return work.save(ordered.mapInArrow(cut, "strip long, n int, ids binary, vectors binary, high binary, low binary, first long, asks binary"), "strips")


_FOUND = "pack long, place int, query_id long, vec_id long, score long"
_PACK = pa.schema({"pack": pa.int64(), "strip": pa.int64(), "own": pa.binary(), "queries": pa.binary(), "low_score": pa.binary(), "low_id": pa.binary(), "ids": pa.binary(), "scores": pa.binary()})


def _found(pack: int, own: np.ndarray, score: np.ndarray, ident: np.ndarray) -> pa.Table:
    at, rank = np.nonzero(score > _NO_SCORE)
    cols = [pa.array(np.full(len(at), pack)), pa.array(at.astype(np.int32)), pa.array(own[at]), pa.array(ident[at, rank]), pa.array(score[at, rank])]
    return pa.table(cols, names=["pack", "place", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, asks: Column, how: TopK = TopK()) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every row for which `asks` (a condition on vec_id) holds.

    A score is the inner product of floor(scale * x) of both vectors' components; ties go to the smaller vec_id. Rows whose vector is null or holds null
    or non-finite components take no part; fewer than k others give fewer rows. Rows with the query's own id are not its candidates. Of rows
    that repeat an id, each is a candidate (and a query) by itself. Rows without an id are candidates behind all others of their score (the id
    2^63 - 1 counts as none) and ask nothing. Shorter vectors end in zeros, components beyond 2^27 are held there. An empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    own = whole_vectors(vectors.select("vec_id", "embedding"))
    own = own.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(_NO_ID))).alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), "embedding")
    dims = dimensions(own)
    if not dims and not own.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, k = max(1, dims), how.k
    work = Workspace(spark, "topk")
    strips = _strips(own, work, how, dims)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                asking = np.flatnonzero(_unpack(r["asks"], bool))
                strip = Strip(_unpack(r["ids"], np.int64), _unpack(r["vectors"], np.int32, dims), how.block_rows)
                for n, at in enumerate(range(0, len(asking), how.pack_queries)):
                    of = asking[at : at + how.pack_queries]
                    ids, q = strip.ids[of], strip.vectors[of]
                    score, ident = strip.search(q, ids, k)
                    row = [r["strip"] * 256 + n, r["strip"], *map(_pack, (ids, q, score[:, -1], ident[:, -1], ident, score))]
                    yield pa.RecordBatch.from_pylist([dict(zip(_PACK.names, row))], _PACK)

    asked = strips.where("n > 0").mapInArrow(home, "pack long, strip long, own binary, queries binary, low_score binary, low_id binary, ids binary, scores binary")
    packs = work.save(asked, "packs")

    # packs meet the bounds of all strips, some of each at a time
    n_strips, n_packs = strips.count(), packs.count()
    lanes, stacks = -(-n_strips // how.lane_strips), max(1, -(-n_packs // how.packs))
    lane, stack = F.pmod(F.xxhash64("strip"), F.lit(lanes)), F.pmod(F.xxhash64("pack"), F.lit(stacks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packs.select("pack", "strip", "queries", "low_score", "low_id", stack.cast("int").alias("stack"), every(lanes).alias("lane"))
    right = strips.select("strip", "high", "low", "first", lane.cast("int").alias("lane"), every(stacks).alias("stack"))

    def possible(packs: pa.Table, strips: pa.Table) -> pa.Table:
        ids, first = strips.column("strip").to_numpy(), strips.column("first").to_numpy()
        high, low = (_unpack(b"".join(strips.column(c).to_pylist()), np.int32, dims) for c in ("high", "low"))
        goes, to = [], []
        for r in packs.to_pylist() if len(ids) else ():
            most, kth, kth_id = bounds(_unpack(r["queries"], np.int32, dims), high, low), _unpack(r["low_score"], np.int64)[:, None], _unpack(r["low_id"], np.int64)[:, None]
            hit = ids[((most > kth) | ((most == kth) & (first < kth_id))).any(0) & (ids != r["strip"])]
            goes += [r["pack"]] * len(hit)
            to.append(hit)
        return pa.table({"pack": pa.array(goes, pa.int64()), "to": pa.array(np.concatenate(to) if to else [], pa.int64())})

    visits = left.groupBy("lane", "stack").cogroup(right.groupBy("lane", "stack")).applyInArrow(possible, "pack long, to long")
    visits = work.save(visits, "visits")
    groups = visits.groupBy("to").agg(F.ceil(F.count("*") / how.packs).alias("groups"))
    visits = visits.join(groups, "to").withColumn("part", F.pmod(F.xxhash64("pack"), F.col("groups")))
    left = visits.join(packs.select("pack", "own", "queries", "low_score", "low_id"), "pack")
    right = strips.select(F.col("strip").alias("to"), "ids", "vectors").join(groups, "to").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")

    def visit(packs: pa.Table, strips: pa.Table) -> pa.Table:
        out = [_found(0, np.zeros(0, np.int64), np.zeros((0, k), np.int64), np.zeros((0, k), np.int64))]
        for s in strips.to_pylist() if packs.num_rows else ():
            strip = Strip(_unpack(s["ids"], np.int64), _unpack(s["vectors"], np.int32, dims), how.block_rows)
            for r in packs.to_pylist():
                ids = _unpack(r["own"], np.int64)
                least = _unpack(r["low_score"], np.int64), _unpack(r["low_id"], np.int64)
                out.append(_found(r["pack"], ids, *strip.search(_unpack(r["queries"], np.int32, dims), ids, k, least)))
        return pa.concat_tables(out)

    away = left.groupBy("to", "part").cogroup(right.groupBy("to", "part")).applyInArrow(visit, _FOUND)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = _found(r["pack"], _unpack(r["own"], np.int64), _unpack(r["scores"], np.int64, k), _unpack(r["ids"], np.int64, k))
                yield from found.to_batches()

    from pyspark.sql import Window

    every_one = packs.select("pack", "own", "ids", "scores").mapInArrow(at_home, _FOUND).unionAll(away)
    best = Window.partitionBy("pack", "place").orderBy(F.desc("score"), "vec_id")
    ranked = every_one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != int(_NO_ID), F.col("vec_id")).alias("vec_id"), "score")
