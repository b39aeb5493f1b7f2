"""The estimator over many saved spectra at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixture import Configuration, Parts, fit_of
from .spectrum import estimate, peak_source

ESTIMATES = "sample string, k int, valley int, peak int, peak_source string, resolved boolean, min_count int"


def latest_runs(preprocessed: DataFrame) -> DataFrame:
    """The latest run of each library."""
    row = F.max(F.struct("run_at", "k", "used_min_count", "genomic_peak", "peak_source", "histovec"))
    return preprocessed.groupBy("sample").agg(row.alias("r")).select("sample", "r.*")


def library_estimates(preprocessed: DataFrame, bins: int = 8000) -> DataFrame:
    """Valley, peak and cutoff of every library's current spectrum; null or shortened spectra count as empty beyond their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sample, k, histovec in zip(*(batch.column(c).to_pylist() for c in ("sample", "k", "histovec"))):
                h = np.zeros(bins, np.int64)
                values = [v or 0 for v in histovec or []][:bins]
                h[: len(values)] = values
                found = estimate(h)
                source, peak = peak_source(h, found)
                rows.append((sample, k, found.valley, peak, source, found.resolved, found.min_count))
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names=["sample", "k", "valley", "peak", "peak_source", "resolved", "min_count"])

    return latest_runs(preprocessed).select("sample", "k", "histovec").mapInArrow(run, ESTIMATES)


#: The model whose cutoffs `library_cutoffs` gives: weights of errors, single copies and repeats, share of singletons, exponent of the tail, dispersion, ratio of repeats.
CUTOFF_MODEL = ((0.8, 0.19, 0.01), 0.85, 2.0, 6.0, 1.9)


def library_cutoffs(preprocessed: DataFrame, bins: int = 8000) -> DataFrame:
    """Hole cutoff, error floor, crossover, and the guarded used_min_count of every library's current run, by a given model
    whose single-copy mode is the library's genomic_peak; libraries without a peak or k-mers have no row."""
    weights, singletons, rate, dispersion, ratio = CUTOFF_MODEL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sample, peak, given, histovec in zip(*(batch.column(c).to_pylist() for c in ("sample", "genomic_peak", "used_min_count", "histovec"))):
                seen = np.array([v or 0 for v in (histovec or [])[: min(6 * peak, bins - 1)]], float)
                if not seen.sum():
                    continue
                last = min(6 * peak, bins - 1)
                observed = np.zeros(last)
                observed[: len(seen)] = seen
                fit = fit_of(Configuration(False, False), Parts(np.log(np.array(weights)), singletons, rate, 0.0, float(peak), dispersion, ratio), last, observed, 0.0, 1.0, float(seen.sum()))
                rows.append((sample, fit.hole_cutoff(), fit.error_floor(), fit.crossover(), fit.guarded(2 if given is None else given)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), *[pa.int32()] * 4])] if rows else [pa.array([], t) for t in [pa.string(), *[pa.int32()] * 4]]
            yield pa.RecordBatch.from_arrays(columns, names=["sample", "hole_cutoff", "error_floor", "crossover", "guarded"])

    current = latest_runs(preprocessed).filter("genomic_peak >= 2").select("sample", "genomic_peak", "used_min_count", "histovec")
    return current.mapInArrow(run, "sample string, hole_cutoff int, error_floor int, crossover int, guarded int")
