"""Peaks of spectra: noise filters, summaries, annotation, scores and false-discovery rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions.tolerance import Tolerance
from massloom.operators.joins import bin_of, bins_near, nearest_join


def mz_window(rows: DataFrame, lo: float, hi: float, mz: str = "mz") -> DataFrame:
    return rows.where(F.col(mz).between(lo, hi))


def noise_filter(peaks: DataFrame, spectrum: str, intensity: str = "intensity", tic: float = 0.0, base: float = 0.0, absolute: float = 0.0) -> DataFrame:
    """Peaks above a share of the total ion current, then of the base peak of what is left, then above a fixed intensity."""
    own = Window.partitionBy(spectrum)
    for share, total in ((tic, F.sum(intensity)), (base, F.max(intensity))):
        if share:
            peaks = peaks.withColumn("limit_", total.over(own)).where(F.col(intensity) > F.col("limit_") * share).drop("limit_")
    return peaks.where(F.col(intensity) > absolute) if absolute else peaks


def spectrum_summary(peaks: DataFrame, spectrum: str, mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """spectrum, n_peaks, tic, base_intensity, base_mz (the smallest of equal ones), min_mz, max_mz."""
    base = F.max(F.struct(F.col(intensity).alias("i"), (-F.col(mz)).alias("m")))
    out = peaks.groupBy(spectrum).agg(F.count("*").alias("n_peaks"), F.sum(intensity).alias("tic"), base.alias("b_"), F.min(mz).alias("min_mz"), F.max(mz).alias("max_mz"))
    return out.select(spectrum, "n_peaks", "tic", F.col("b_.i").alias("base_intensity"), (-F.col("b_.m")).alias("base_mz"), "min_mz", "max_mz")


def annotate(fragments: DataFrame, peaks: DataFrame, tol: Tolerance, spectrum: str = "spectrum_id") -> DataFrame:
    """Each fragment (spectrum, fragment_id, mz, ...) with its nearest peak (peak_idx, peak_mz, intensity) within tolerance, if there is one."""
    own = peaks.select(F.col(spectrum).alias("peak_spectrum"), F.col("peak_idx"), F.col("mz").alias("peak_mz"), "intensity")
    return nearest_join(fragments, own, ("mz", "peak_mz"), tol, [spectrum, "fragment_id"], [F.col("peak_mz"), F.col("peak_idx")], ([spectrum], ["peak_spectrum"])).drop("peak_spectrum")


def fraction(found: Column, total: Column) -> Column:
    """found / total, NaN for 0 / 0."""
    return F.when(total == 0, F.when(found == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(found / F.nullif(total, F.lit(0)))


def scores(fragments: DataFrame, peaks: DataFrame, annotated: DataFrame, spectrum: str = "spectrum_id") -> DataFrame:
    """Per spectrum: found and total of fragments, peaks, intensity and positions."""
    a = fragments.groupBy(spectrum).agg(F.count("*").alias("n_fragments"), F.countDistinct("position").alias("n_positions"))
    b = peaks.groupBy(spectrum).agg(F.count("*").alias("n_peaks"), F.sum("intensity").alias("intensity"))
    c = annotated.groupBy(spectrum).agg(F.count("*").alias("fragments_found"), F.countDistinct("position").alias("positions_found"))
    hit = annotated.select(spectrum, "peak_idx", "intensity").distinct().groupBy(spectrum).agg(F.count("*").alias("peaks_found"), F.sum("intensity").alias("intensity_found"))
    out = b.join(a, spectrum, "left").join(c, spectrum, "left").join(hit, spectrum, "left")
    return out.fillna(0, [x for x in out.columns if x != spectrum])


def series_scores(fragments: DataFrame, annotated: DataFrame, spectrum: str = "spectrum_id", unique: str = "position") -> DataFrame:
    """spectrum, ion, found, total: distinct positions (or formulas) of each ion series that has any."""
    total = fragments.groupBy(spectrum, "ion").agg(F.countDistinct(unique).alias("total"))
    found = annotated.groupBy(spectrum, "ion").agg(F.countDistinct(unique).alias("found"))
    return total.join(found, [spectrum, "ion"], "left").fillna(0, ["found"]).select(spectrum, "ion", "found", "total")


def shift_fdr(fragments: DataFrame, peaks: DataFrame, tol: Tolerance, spectrum: str = "spectrum_id", shifts: range = range(-25, 26), shift: float = math.pi, intensity: str | None = None) -> DataFrame:
    """spectrum, actual (share of peaks with a fragment), average and deviation of that share over shifted peaks, fdr, sigma.

    Shifts are pi + k for whole k. A shifted peak is held against the fragments by its shifted place. score: log2 of sigma, null unless that is above 0. With the name of an intensity
    column there are also intensity_actual, _average, _deviation, _fdr, _sigma and _score, of the share of the spectrum's intensity.
    """
    value = F.col(intensity).cast("double") if intensity else F.lit(0.0)
    n = peaks.groupBy(spectrum).agg(F.count("*").alias("n_peaks"), F.sum(value).alias("total_"))
    # places are moved, not peaks: peaks of equal place are counted, and fragments of equal place are one target
    places = peaks.groupBy(spectrum, "mz").agg(F.count("*").alias("n_"), F.sum(value).alias("i_"))
    moved = places.select(spectrum, "mz", "n_", "i_", F.explode(F.array(F.lit(None).cast("int"), *(F.lit(k) for k in shifts))).alias("k"))
    moved = moved.select(F.col(spectrum), "k", "n_", "i_", F.coalesce(F.col("mz") + F.lit(shift) + F.col("k"), F.col("mz")).alias("shifted_mz"))
    # the bins are spread out on the fragments, of which there are fewer; a semi-join counts each moved place once
    moved = moved.withColumn("bin_", bin_of(F.col("shifted_mz"), tol))
    targets = fragments.select(F.col(spectrum).alias("fragment_spectrum"), F.col("mz").alias("fragment_mz")).distinct().withColumn("fragment_bin", F.explode(bins_near(F.col("fragment_mz"), tol)))
    on = [moved[spectrum] == targets["fragment_spectrum"], F.col("bin_") == F.col("fragment_bin"), tol.within(F.col("shifted_mz"), F.col("fragment_mz"))]
    # fragments are far more than their tables' bytes tell, so they are not broadcast
    each = moved.join(targets.hint("merge"), on, "left_semi").groupBy(spectrum, "k").agg(F.sum("n_").alias("hits"), F.sum("i_").alias("intensity"))
    m = len(shifts)
    own, false = F.col("k").isNull(), F.col("k").isNotNull()
    sums = {}
    for name, c in (("", F.col("hits")), ("intensity_", F.col("intensity"))):
        sums |= {f"{name}actual_sum": F.sum(F.when(own, c)), f"{name}false_sum": F.sum(F.when(false, c)), f"{name}square_sum": F.sum(F.when(false, c * c))}
    out = n.join(each.groupBy(spectrum).agg(*(c.alias(k) for k, c in sums.items())), spectrum, "left").fillna(0, list(sums))
    cols = [F.col(spectrum), F.col("n_peaks")]
    for name, total in (("", F.col("n_peaks")), ("intensity_", F.nullif(F.col("total_"), F.lit(0.0)))):
        spread = F.col(f"{name}square_sum") * m - F.col(f"{name}false_sum") * F.col(f"{name}false_sum")
        cols += [(F.col(f"{name}actual_sum") / total).alias(f"{name}actual"), (F.col(f"{name}false_sum") / (total * m)).alias(f"{name}average"), (F.sqrt(F.greatest(spread, F.lit(0).cast("double"))) / (total * m)).alias(f"{name}deviation")]
    out = out.select(*cols)
    for name in ("", "intensity_"):
        average, actual = F.col(f"{name}average"), F.col(f"{name}actual")
        out = out.withColumn(f"{name}fdr", average / F.nullif(actual, F.lit(0.0))).withColumn(f"{name}sigma", (actual - average) / F.nullif(F.col(f"{name}deviation"), F.lit(0.0)))
        out = out.withColumn(f"{name}score", F.when(F.col(f"{name}sigma") > 0, F.log2(f"{name}sigma")))
    own = ["actual", "average", "deviation", "fdr", "sigma", "score"]
    return out.select(spectrum, "n_peaks", *own, *(f"intensity_{c}" for c in own if intensity))


def weighted_cosine(a: Column, b: Column, mz_a: Column | None = None) -> Column:
    """Cosine similarity of two intensity arrays of equal places, weighted by place * sqrt(intensity); 0 if one is empty."""

    def weight(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(x)) if mz_a is None else mz_a
        return F.zip_with(x, places, lambda i, m: F.sqrt(F.greatest(i.cast("double"), F.lit(0.0))) * m)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    wa, wb = weight(a), weight(b)
    norm = F.sqrt(dot(wa, wa)) * F.sqrt(dot(wb, wb))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(wa, wb) / F.nullif(norm, F.lit(0.0)))
