"""Vector code compression: product codes whose nearest entries are screened in float32 and decided in int64.

A vector's integer components are cut into equal consecutive parts, each of which is replaced by the index of its
nearest codebook entry. Distances are screened as |c|^2 / 2 - x.c, with x.c from one float32 matrix product a batch. Each such figure
comes with an interval that surely holds the exact one: a product of w components that is summed in any order, of factors that were
rounded once, errs by at most g / (1 - g) |x| |c| where g = (w + 2) 2^-24. Every entry whose interval reaches below the least upper end
is evaluated in int64, and of equal distances the lowest index wins, so codes and errors are those of integer arithmetic alone.

Codebooks start from the vectors of the least ids and are moved in rounds: every task sums the parts of each entry, the sums meet in an
aggregation of one row for each part, entry and task, and the new codebooks (their size depends on the parameters only) go to the tasks of
the next round. Nothing but that is collected; the vectors are read once a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.vectors import dimensions, integers, whole_vectors
from massloom.llm.workspace import Workspace, small


@dataclass(frozen=True)
class Codebook:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    #: Distinct labels up to this many are broadcast with their sums; more are joined by shuffle.
    broadcast_labels: int = 100_000


def overlapping(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries of `book` may be nearest to each row of x: those whose interval overlaps that of the best.

    Intervals of a row are as wide as that of the entry of largest norm: the product's error, the rounding of |c|^2 / 2 and that of their difference, all in float32.
    """
    g = (x.shape[1] + 2) * 2.0**-24
    cf, c32 = book.astype(np.float64), book.astype(np.float32)
    half = (cf * cf).sum(1) / 2
    most, size = np.sqrt(2 * half.max()), np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    width = 1.001 * ((g / (1 - g) + 2.0**-23) * size * most + 2.0**-22 * half.max()) + 1e-6
    gap = x.astype(np.float32) @ c32.T
    np.subtract(half.astype(np.float32), gap, out=gap)
    # rounded up, so that the float32 bound is no less than the exact one
    bound = np.nextafter((gap.min(1) + 2 * width).astype(np.float32), np.float32(np.inf))
    return gap <= bound[:, None]


def nearest(x: np.ndarray, book: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry of each row; ties to the lower index. Integers in, integers out."""
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), rows):
        own = x[at : at + rows]
        i, j = np.nonzero(overlapping(own, book))
        exact = np.empty(len(i), np.int64)
        for k in range(0, len(i), 1 << 16):
            step = own[i[k : k + (1 << 16)]] - book[j[k : k + (1 << 16)]]
            exact[k : k + (1 << 16)] = (step * step).sum(1)
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))  # each row has an entry at least
        least = np.minimum.reduceat(exact, first)
        best = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(first, len(i)))))
        best = best[np.concatenate(([True], i[best][1:] != i[best][:-1]))]
        index[at : at + len(own)], error[at : at + len(own)] = j[best], least
    return index, error


def _first_entries(own: DataFrame, how: Codebook, dims: int) -> np.ndarray:
    """parts x entries x components, from the vectors of the least ids."""
    rows = own.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(how.entries).collect()
    first = integers(pa.array([r[1] for r in rows], pa.list_(pa.float64())), how.scale, dims)
    return first.reshape(len(rows), how.parts, dims // how.parts).transpose(1, 0, 2)


def _moved(own: DataFrame, book: np.ndarray, how: Codebook, dims: int) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to the mean of its parts, rounded down."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
        for b in batches:
            x = integers(b.column("embedding"), how.scale, dims).reshape(b.num_rows, parts, width)
            for p in range(parts):
                index, _ = nearest(x[:, p], book[p])
                np.add.at(sums[p], index, x[:, p])
                n[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(n)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[p, e].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), lists], ["part", "entry", "n", "sums"])

    each = own.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums"))
    out = book.copy()
    for r in total.collect():  # parts * entries rows at most
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    return out


def vector_codes(vectors: DataFrame, how: Codebook = Codebook()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row whose vector takes part.

    Other rows (vector null, or with null or non-finite components) are left out. error: squared distance to the code's entries. label_error: errors
    summed over equal labels, nulls together (null if the sum needs more than 64 bits). Rows that repeat an id or a vector count each; a null id comes after all others
    where the least ids are taken, equal ids in the order of their vectors. With fewer vectors than entries the codebooks are that much shorter. Vectors
    whose length isn't a multiple of `parts`, or that are shorter than the longest, end in zeros. Components beyond 2^27 are held there. An empty table gives no rows;
    further columns are ignored, and a missing label counts as null.
    """
    spark = vectors.sparkSession
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    own = whole_vectors(vectors.select("vec_id", "embedding", label))
    dims = max(1, -(-dimensions(own) // how.parts)) * how.parts
    book = _first_entries(own, how, dims)
    kinds = {f.name: f for f in own.schema}
    schema = T.StructType([kinds["vec_id"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), kinds["label"]])
    if not book.shape[1]:
        return spark.createDataFrame([], T.StructType([kinds["vec_id"], *schema.fields[1:3], T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    for _ in range(how.rounds):
        book = _moved(own, book, how, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(book.shape[1])], dtype=object)
        for b in batches:
            x = integers(b.column("embedding"), how.scale, dims).reshape(b.num_rows, *book.shape[::2])
            code, error = np.full(b.num_rows, "", dtype=object), np.zeros(b.num_rows, np.int64)
            for p in range(how.parts):
                index, far = nearest(x[:, p], book[p])
                code, error = code + digits[index], error + far
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(code, pa.string()), pa.array(error), b.column("label")], ["vec_id", "code", "error", "label"])

    coded = Workspace(spark, "codes").save(own.select("vec_id", "embedding", "label").mapInArrow(run, schema), "coded")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(small(sums, how.broadcast_labels), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decoded(codes: list[str], book: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for."""
    at = np.array([[int(c[k : k + 2], 16) for k in range(0, len(c), 2)] for c in codes]).reshape(len(codes), len(book))
    return np.concatenate([book[p][at[:, p]] for p in range(len(book))], axis=1)
