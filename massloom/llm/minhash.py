"""Near-duplicate documents by MinHash.

One permutation of the shingle hashes is cut into bins; each bin keeps its smallest hash, and an empty
bin takes the value of the first non-empty one in an order drawn for that bin (optimal densification).
Bands of bins are buckets. Within a bucket, edges run from hubs to the other documents (a star), so a
group of n copies makes about n pairs; `components.link_in_buckets` repeats stars until no linked
pair of the bucket is left apart. A parity bitmap of each set (how many hashes fall in each of 512 cells, odd or
even) bounds a pair's symmetric difference from below and drops pairs that can't be linked; every edge is
confirmed on the full shingle sets. Documents with equal sets are one node from the start.

Null and empty texts have no shingles and no links. A null id is never linked (component null, kept).
Each input row gives one row. Rows that repeat an id are one document, which has the links of all its texts; each row has its own set's size.
A very long text is a batch by itself; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.components import components, link_in_buckets
from massloom.llm.textcols import U64, Words, chunks, mix, ngrams, utf8
from massloom.llm.workspace import Workspace, small


#: Ids of documents to confirm, up to this many, are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class MinHash:
    """Linked: 100 * |A and B| >= percent * |A or B|.

    With 40 bands of 5 bins a pair at 80 % shares no band in about 1 of 8 million cases, at 85 % in 1 of 10 billion.
    """

    shingle_words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5


def shingle_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than n words are one shingle."""
    words = Words(*utf8(batch.column("text")))
    hashes = words.hashes(lower=True)
    grams, bounds = ngrams(hashes, words.rows, n)
    out = []
    for k in range(batch.num_rows):
        if bounds[k] < bounds[k + 1]:
            out.append(np.unique(grams[bounds[k] : bounds[k + 1]]))
        else:
            own = hashes[words.rows[k] : words.rows[k + 1]]
            whole = own[:1]
            for h in own[1:]:
                whole = mix(whole * U64(0x9E3779B97F4A7C15) + h)
            out.append(whole)
    return out


def probe_order(bins: int) -> np.ndarray:
    """For each bin, the order in which the others are asked when it is empty."""
    return np.argsort(mix(np.arange(bins * bins, dtype=U64) + U64(7)).reshape(bins, bins), axis=1)


def signatures(sets: list[np.ndarray], bins: int, probes: np.ndarray) -> np.ndarray:
    """The bins of each set, densified; a row of zeros for an empty set."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    row, value = np.repeat(np.arange(len(sets)), size), np.concatenate([*sets, np.zeros(0, U64)]).astype(U64)
    bin_ = ((value >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    cell = row * bins + bin_
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # values ascend within a row, and so do bins
    full = np.zeros(len(sets) * bins, bool)
    sig = np.zeros(len(sets) * bins, U64)
    full[cell[first]], sig[cell[first]] = True, value[first]
    full, sig = full.reshape(-1, bins), sig.reshape(-1, bins)
    r, c = np.nonzero(~full & (size > 0)[:, None])
    have = sig.copy()
    for k in range(bins):
        if not len(r):
            break
        ask = probes[c, k]
        hit = full[r, ask]
        sig[r[hit], c[hit]] = have[r[hit], ask[hit]]
        r, c = r[~hit], c[~hit]
    return sig


PARITY = [f"p{k}" for k in range(8)]


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """Bit maps (n, 8) of 64 bits: whether the number of hashes in each of 512 cells is odd."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = (np.concatenate([*sets, np.zeros(0, U64)]).astype(U64) & U64(511)).astype(np.int64)
    odd = np.bincount(row << 9 | cell, minlength=len(sets) << 9).reshape(-1, 512) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def sketch(docs: DataFrame, how: MinHash) -> DataFrame:
    """doc_id, h, n_shingles, k1 and k2 (128 bits that name the set), parity bitmap, buckets (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, probes = how.bands * how.rows, probe_order(how.bands * how.rows)
        for b in chunks(batches):
            sets = shingle_sets(b, how.shingle_words)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            keys = np.array([[mix(s + U64(k)).sum(dtype=U64) for k in (1, 2)] for s in sets], U64)
            sig = signatures(sets, bins, probes).reshape(-1, how.bands, how.rows)
            bucket = np.broadcast_to(np.arange(how.bands, dtype=U64), sig.shape[:2]).copy()
            for k in range(how.rows):
                bucket = mix(bucket * U64(0x9E3779B97F4A7C15) + sig[:, :, k])
            bounds = np.concatenate(([0], np.cumsum(np.where(size > 0, how.bands, 0)))).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket[size > 0].ravel().view(np.int64)))
            cols = [size, keys[:, 0].view(np.int64), keys[:, 1].view(np.int64), *parity(sets).T]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *map(pa.array, cols), buckets], ["doc_id", "h", "n_shingles", "k1", "k2", *PARITY, "buckets"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, f"doc_id long, h long, n_shingles long, k1 long, k2 long, {', '.join(f'{p} long' for p in PARITY)}, buckets array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sets = shingle_sets(b, n)
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*sets, np.zeros(0, U64)]).astype(U64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), own], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def near_duplicates(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rows = work.save(sketch(docs, how), "sketch")
    # a row is named by its document's id, or where ids repeat by a number of its own
    repeated = _repeats(rows)
    rows = work.save(rows.withColumn("id", F.monotonically_increasing_id()), "numbered") if repeated else rows.withColumn("id", F.col("doc_id"))
    named = rows.where("n_shingles > 0 and doc_id is not null")
    same = named.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    same = work.save(same, "same")
    # only sets that several rows share need a lookup; the others stand for themselves
    shared = same.where("rep <> last").select("k1", "k2", "n_shingles", "rep")
    node = work.save(rows.join(shared, ["k1", "k2", "n_shingles"], "left").select("doc_id", "id", "n_shingles", F.coalesce("rep", "id").alias("rep")), "nodes")
    reps = same.select("k1", "k2", "n_shingles", F.col("rep").alias("id"))
    members = named.join(reps, ["k1", "k2", "n_shingles", "id"], "left_semi").select(F.explode("buckets").alias("bucket"), "id")
    traits = named.select("id", "n_shingles", *PARITY)
    sets: list[DataFrame] = []

    def possible(a: str, b: str) -> Column:
        # 100 * both >= percent * (sum - both) means (100 + percent) * difference <= (100 - percent) * sum, and differ <= difference
        differ = sum((F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in PARITY), F.lit(0))
        n, m = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
        sizes = (n * 100 >= m * how.percent) & (m * 100 >= n * how.percent)
        return sizes & (differ * (100 + how.percent) <= (n + m) * (100 - how.percent))

    def links(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        if sets:
            ids = ids.join(sets[0].select("id"), "id", "left_anti")
        if repeated:
            ids = rows.join(ids, "id", "left_semi").select(F.col("doc_id").alias("d"), F.col("h").alias("own_h"), "id")
        else:
            ids = ids.select(F.col("id").alias("d"), "id")
        ids = work.save(ids, "ids")
        own = docs.join(small(ids, BROADCAST_IDS), (F.col("doc_id") == F.col("d")) & ((F.col("h") == F.col("own_h")) if repeated else F.lit(True)))
        more = full_sets(own, how.shingle_words)
        more = work.save(more.dropDuplicates(["id"]) if repeated else more, "sets")
        sets[:] = [sets[0].union(more) if sets else more]
        left = sets[0].select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = sets[0].select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        sized = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
        return sized.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * how.percent)

    label = link_in_buckets(work, members, traits, possible, links)
    found = node.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component"))
    if repeated:
        found = work.save(found, "found")
        found = _by_document(work, found)
    out = found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
    out = work.save(out, "result")
    work.keep(out)
    return out


def _by_document(work: Workspace, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component of rows whose component is a row's number: documents with a row in the same component are joined."""
    # within a row component all documents are linked to its least one; a document's rows may be in several
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("b"))
    edges = found.join(least, "component").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    label = components(work, edges).select(F.col("id").alias("doc_id"), F.col("component").alias("root"))
    return found.join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component"))


def drop_near_duplicates(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """The rows of docs, with their columns, that are kept: the smallest id of each group, and rows without an id."""
    work = Workspace(docs.sparkSession, "near-duplicates")
    gone = work.save(near_duplicates(docs, how).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    gone = small(gone, BROADCAST_IDS)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
