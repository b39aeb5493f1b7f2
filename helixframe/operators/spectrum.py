"""Spectrum operators as DataFrame expressions over (count, distinct); the last bin is saturated.

The estimator itself works on the driver (`plans.spectrum`), as a spectrum has
at most 8000 rows; these are its building blocks for use in queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counting import BINS


def filled(spectrum: DataFrame, bins: int = BINS) -> DataFrame:
    """Every bin, the empty ones with 0."""
    every = spectrum.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("count"))
    return every.join(F.broadcast(spectrum), "count", "left").select("count", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def occurrence_median(spectrum: DataFrame) -> DataFrame:
    """The smallest count with which half of all occurrences are reached."""
    mass = (F.col("count") * F.col("distinct")).cast("long")
    running = spectrum.select("count", F.sum(mass).over(Window.orderBy("count")).alias("upto"), F.sum(mass).over(Window.partitionBy()).alias("whole"))
    return running.filter(F.col("upto") * 2 >= F.col("whole")).agg(F.min("count").alias("median"))


def tail_sums(spectrum: DataFrame, valley: int) -> DataFrame:
    """Distinct k-mers from the valley on, and their share of all occurrences."""
    mass = F.col("count") * F.col("distinct")
    above = F.col("count") >= valley
    return spectrum.agg(F.coalesce(F.sum(F.when(above, F.col("distinct"))), F.lit(0)).alias("distinct_above"), (F.coalesce(F.sum(F.when(above, mass)), F.lit(0)) / F.sum(mass)).alias("instance_share"))


def mirrored_area(spectrum: DataFrame, valley: int, peak: int, bins: int = BINS) -> DataFrame:
    """Share of the k-mers seen twice or more from the valley to its mirror image; null if that reaches the last bin."""
    mirror = 2 * peak - valley
    inside = F.sum(F.when(F.col("count").between(valley, mirror), F.col("distinct")))
    total = F.sum(F.when(F.col("count") >= 2, F.col("distinct")))
    share = F.coalesce(inside, F.lit(0)) / total if valley <= peak and mirror < bins else F.lit(None).cast("double")
    return spectrum.agg(share.alias("area"))


def loss_guard(spectrum: DataFrame, valley: int, peak: int, loss: float = 0.01, bins: int = BINS) -> DataFrame:
    """The largest cutoff up to the peak that loses at most ``loss`` of the k-mers from the valley on, 2 at least."""
    open_bins = filled(spectrum, bins).filter((F.col("count") >= valley) & (F.col("count") < bins))
    below = F.coalesce(F.sum("distinct").over(Window.orderBy("count").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lost = open_bins.select("count", below.alias("lost"), F.sum("distinct").over(Window.partitionBy()).alias("whole"))
    return lost.filter((F.col("count") <= peak) & (F.col("lost") <= F.col("whole") * loss)).agg(F.greatest(F.coalesce(F.max("count"), F.lit(2)), F.lit(2)).alias("guard"))


def dispersion(spectrum: DataFrame, valley: int, peak: int, bins: int = BINS) -> DataFrame:
    """Variance over mean of the counts from the valley to twice the peak."""
    lobe = spectrum.filter((F.col("count") >= valley) & (F.col("count") < min(2 * peak, bins - 1)))
    c, n = F.col("count").cast("double"), F.col("distinct")
    moments = lobe.agg(F.sum(n).alias("n"), F.sum(c * n).alias("s"), F.sum(c * c * n).alias("q"))
    mean = F.col("s") / F.col("n")
    return moments.select(((F.col("q") / F.col("n") - mean * mean) / mean).alias("dispersion"))


def smoothed(spectrum: DataFrame, bins: int = BINS) -> DataFrame:
    """Integer mean of five bins, fewer at the ends; the saturated bin is left out."""
    around = Window.orderBy("count").rowsBetween(-2, 2)
    open_bins = filled(spectrum, bins).filter(F.col("count") < bins)
    return open_bins.select("count", F.floor(F.sum("distinct").over(around) / F.count("*").over(around)).cast("long").alias("smooth"))


def highest_bin(spectrum: DataFrame, first: int, bins: int = BINS) -> DataFrame:
    """The bin of most k-mers from ``first`` on, the lowest of equal ones."""
    return spectrum.filter((F.col("count") >= first) & (F.col("count") < bins)).agg(F.max_by("count", F.struct("distinct", -F.col("count"))).alias("peak"))


def lowest_bin(spectrum: DataFrame, first: int, last: int, bins: int = BINS) -> DataFrame:
    """The bin of fewest k-mers, empty ones included, the lowest of equal ones."""
    return filled(spectrum, bins).filter(F.col("count").between(first, last)).agg(F.min_by("count", F.struct("distinct", "count")).alias("valley"))


def local_valleys(spectrum: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts from 2 on that are lower than both neighbours, below the last open bin."""
    w = Window.orderBy("count")
    sides = filled(spectrum, bins).select("count", "distinct", F.lag("distinct").over(w).alias("before"), F.lead("distinct").over(w).alias("after"))
    return sides.filter((F.col("count") >= 2) & (F.col("count") < bins - 1) & (F.col("distinct") < F.col("before")) & (F.col("distinct") < F.col("after"))).select("count", "distinct")


def pair_sums(spectrum: DataFrame, bins: int = BINS) -> DataFrame:
    """The sum of each bin and the next; a right flank falls if it falls strictly from the peak on."""
    w = Window.orderBy("count")
    return filled(spectrum, bins).select("count", (F.col("distinct") + F.lead("distinct").over(w)).alias("pair")).filter(F.col("pair") > 0)
