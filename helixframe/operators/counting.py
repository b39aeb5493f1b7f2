"""Counting k-mers: exact counts, counts by quality floor, histograms, samples, carried contigs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import PACKED_K, unpacked
from .kmers import Batch, _floors, _one_byte, check_k

#: Bins of a spectrum; the last one holds every higher count.
BINS = 8000
SAMPLE_KMERS = 500_000
LOWEST_THRESHOLD_BITS = 52


def count_kmers(reads: DataFrame, k: int, floors: list[int] | None = None, min_count: int = 1) -> DataFrame:
    """Canonical kmer, n, and n_f0 ... for each floor the windows that clear it; kmers below ``min_count`` drop out.

    A k-mer is a LONG for each 31 bases: each task packs its windows and sums
    them batch by batch, so what is shuffled are partial counts of short keys.
    """
    check_k(k)
    floors = _floors(floors)
    names = [f"n_f{i}" for i in range(len(floors))]
    sizes = chunk_sizes(k)
    words = [f"w{i}" for i in range(len(sizes))]
    partial = _one_byte(reads).mapInArrow(_packed_counts(k, floors), ", ".join(f"{n} long" for n in words + names))
    summed = partial.groupBy(*words).agg(*(F.sum(n).alias(n) for n in names))
    kmer = F.concat(*(unpacked(w, size, "ACGT") for w, size in zip(words, sizes)))
    counts = summed.select(kmer.alias("kmer"), F.col("n_f0").alias("n"), *names)
    return counts.filter(F.col("n") >= min_count) if min_count > 1 else counts


def chunk_sizes(k: int) -> list[int]:
    """The bases of each LONG of a packed k-mer."""
    return [min(PACKED_K, k - first) for first in range(0, k, PACKED_K)]


def _canonical_words(batch: Batch, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """The lesser of each window and its reverse complement, a word for each chunk; both strands are cut alike from their own beginning."""
    sizes = chunk_sizes(k)
    packed = {size: batch.packed(size) for size in set(sizes)}
    first = np.cumsum([0, *sizes])[:-1]
    forward = [packed[size][0][starts + at] for at, size in zip(first, sizes)]
    backward = [packed[size][1][starts + k - at - size] for at, size in zip(first, sizes)]
    turned, open_ = np.zeros(len(starts), bool), np.ones(len(starts), bool)
    for f, b in zip(forward, backward):
        turned |= open_ & (b < f)
        open_ &= b == f
    return [np.where(turned, b, f).astype(np.int64) for f, b in zip(forward, backward)]


def _packed_counts(k: int, floors: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                part = whole.slice(at, 5000)
                batch = Batch(part.column("seq"), part.column("qual"))
                starts = batch.starts(k, floors[0])
                if not len(starts):
                    continue
                words = _canonical_words(batch, starts, k)
                order = np.lexsort(words[::-1]) if len(words) > 1 else np.argsort(words[0])
                words, group = [w[order] for w in words], batch.groups(starts, k, floors)[order]
                new = np.zeros(len(order), bool)
                new[0] = True
                for w in words:
                    new[1:] |= w[1:] != w[:-1]
                first = np.flatnonzero(new)
                sums = [np.add.reduceat((group >= i).astype(np.int64), first) for i in range(len(floors))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(w[first] for w in words), *sums)], names=[*(f"w{i}" for i in range(len(words))), *(f"n_f{i}" for i in range(len(floors)))])

    return run


def gated_counts(counts: DataFrame) -> DataFrame:
    """What a counter behind a first-sighting filter keeps, without its false positives: counts of 2 and more."""
    return counts.filter(F.col("n") >= 2)


def at_least(counts: DataFrame, min_count: int) -> DataFrame:
    return counts.filter(F.col("n") >= min_count)


def histogram(counts: DataFrame, column: str = "n", bins: int = BINS) -> DataFrame:
    """count and the number of distinct k-mers with it; counts from ``bins`` on share the last bin, zero counts have none."""
    return counts.filter(F.col(column) > 0).groupBy(F.least(F.col(column), F.lit(bins)).cast("int").alias("count")).agg(F.count("*").alias("distinct"))


def dense(spectrum: DataFrame, bins: int = BINS) -> np.ndarray:
    """A spectrum as an array; element c-1 is the number of k-mers seen c times. At most ``bins`` rows are collected."""
    out = np.zeros(bins, np.int64)
    for row in spectrum.select("count", "distinct").collect():
        out[min(row[0], bins) - 1] += row[1]
    return out


def sample_threshold(distinct: int, most: int = SAMPLE_KMERS, lowest_bits: int = LOWEST_THRESHOLD_BITS) -> int:
    """Power of two below 2**64 under which about ``most`` of ``distinct`` uniform 64-bit hashes are expected."""
    bits = 64
    while distinct >> (64 - bits) > most and bits > lowest_bits:
        bits -= 1
    return 1 << bits


def sampled(counts: DataFrame, threshold: int) -> DataFrame:
    """k-mers whose hash lies under the threshold, with their exact counts: the same ones in whatever order data comes."""
    if threshold >= 1 << 64:
        return counts
    return counts.filter(F.xxhash64("kmer") < F.lit(threshold - (1 << 63)))


def sample_fraction(threshold: int) -> float:
    return threshold / 2.0**64


def rescaled(spectrum: DataFrame, fraction: float) -> DataFrame:
    """A sampled spectrum scaled up to all k-mers."""
    return spectrum.select("count", _scaled(fraction).alias("distinct"))


def _scaled(fraction: float):
    return F.least(F.floor(F.col("distinct") / F.lit(fraction)), F.lit(2**32 - 1)).cast("long")


def sample_check(counts: DataFrame, threshold: int) -> DataFrame:
    """One row comparing a hash sample with its table: distinct k-mers of both, the fraction, how many were to be expected, and
    whether the difference is within five standard deviations of a binomial draw."""
    fraction = sample_fraction(threshold)
    inside = F.lit(True) if threshold >= 1 << 64 else F.xxhash64("kmer") < F.lit(threshold - (1 << 63))
    sizes = counts.agg(F.count("*").alias("table"), F.count_if(inside).alias("sampled")).withColumn("fraction", F.lit(fraction))
    expected = F.col("table") * F.col("fraction")
    return sizes.withColumn("expected", expected).withColumn("unbiased", F.abs(F.col("sampled") - expected) <= 5 * F.sqrt(expected * (1 - F.col("fraction"))) + 1e-9)


def floor_histograms(counts: DataFrame, floors: list[int], bins: int = BINS) -> DataFrame:
    """floor, count and distinct: the histogram of every floor's counts (n_f0, n_f1, ... of ``floors``) in one pass."""
    rows = F.array(*(F.struct(F.lit(f).alias("floor"), F.col(f"n_f{i}").alias("n")) for i, f in enumerate(floors)))
    flat = counts.select(F.inline(rows)).filter("n > 0")
    return flat.groupBy("floor", F.least("n", F.lit(bins)).cast("int").alias("count")).agg(F.count("*").alias("distinct"))


def floor_totals(counts: DataFrame, floors: list[int]) -> DataFrame:
    """floor, distinct k-mers and windows that clear it, of every floor that any window clears."""
    totals = counts.agg(*(x for i in range(len(floors)) for x in (F.count_if(F.col(f"n_f{i}") > 0).alias(f"k{i}"), F.sum(f"n_f{i}").alias(f"w{i}"))))
    rows = F.array(*(F.struct(F.lit(f).alias("floor"), F.col(f"k{i}").alias("kmers"), F.col(f"w{i}").alias("windows")) for i, f in enumerate(floors)))
    return totals.select(F.inline(rows)).filter("kmers > 0")


def floor_spectra(counts: DataFrame, floors: list[int], used: list[int] | None = None, fraction: float = 1.0, bins: int = BINS) -> dict[int, np.ndarray]:
    """The histograms as arrays, those of a sample scaled up; at most ``bins`` rows a floor are collected."""
    h = floor_histograms(counts, floors, bins)
    h = h if fraction == 1.0 else h.select("floor", "count", _scaled(fraction).alias("distinct"))
    out = {f: np.zeros(bins, np.int64) for f in (used or floors)}
    for floor, count, distinct in h.filter(F.col("floor").isin(list(out))).collect():
        out[floor][count - 1] = distinct
    return out


def carry(counts: DataFrame, contigs: DataFrame, k: int, min_count: int) -> DataFrame:
    """Counts after the k-mers of previous contigs were raised to ``min_count``, or added with it."""
    carried = count_kmers(contigs.select(F.lit(0).alias("read_id"), "seq", F.lit(None).cast("string").alias("qual")), k)
    carried = carried.select("kmer", F.lit(min_count).cast("long").alias("carried"))
    joined = counts.select("kmer", "n").join(carried, "kmer", "full_outer")
    return joined.select("kmer", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("carried", F.lit(0))).alias("n"), F.col("n").isNull().alias("is_new"))


def partition_balance(df: DataFrame) -> DataFrame:
    """Rows of the busiest partition over the mean, and whether that is worth a warning."""
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") / F.avg("n")).alias("imbalance")).withColumn("warn", F.col("imbalance") > 1.5)


def occupancy(filters: DataFrame, buffer: str = "buffer") -> DataFrame:
    """Set bits, all bits and whether a saved filter is fuller than a quarter."""
    bits = F.aggregate(F.coalesce(buffer, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, w: a + F.bit_count(F.coalesce(w, F.lit(0))))
    out = filters.withColumn("set_bits", bits).withColumn("all_bits", F.coalesce(F.size(buffer), F.lit(0)).cast("long") * 64)
    return out.withColumn("warn", F.col("set_bits") * 4 > F.col("all_bits"))
