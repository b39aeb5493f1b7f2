"""From reads to contigs: one k, or an ascending ladder of ks, each seeded with the contigs before it."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compact import collapse
from ..operators.correct import correct
from ..operators.counting import carry, count_kmers, dense, floor_spectra, gated_counts, histogram, sample_check, sample_fraction, sample_threshold, sampled
from ..operators.graph import nodes_of, overlap_edges
from ..session import cut_lineage
from ..sources.reads import ReadStore, quality_alphabet
from ..sources.sinks import write_fasta
from .mixture import fitter
from .options import AssemblyOptions, CorrectionOptions, GraphOutputError, InputError, InvalidOptions, PreprocessingError, settled_ladder
from .selection import Choice, choose, effective_floors, recounted
from .spectrum import estimate, peak_source

log = logging.getLogger("helixframe")

# Fixed value: below this single-copy peak a later k is not assembled any more.
LEAST_LADDER_PEAK = 4


@dataclass
class Preprocessed:
    """Filtered k-mers of one k, with the spectrum and what was read from it."""

    k: int
    kmers: DataFrame
    spectrum: np.ndarray
    min_count: int
    floor: int
    peak: int | None
    source: str
    unresolved: bool
    chosen_floor_resolved: bool = True
    spectra: dict[int, np.ndarray] = field(default_factory=dict)  # of every floor looked at
    scale: float = 1.0  # by which these were scaled up from a sample


@dataclass
class Step:
    k: int
    floor: int
    min_count: int
    peak: int | None
    source: str
    accepted: bool
    contigs: int = 0
    bases: int = 0
    reason: str | None = None


@dataclass
class Assembly:
    """The contigs of the last accepted k."""

    contigs: DataFrame
    min_contig_length: int
    steps: list[Step] = field(default_factory=list)
    stopped_at: tuple[int, str] | None = None

    @property
    def completed_ks(self) -> list[int]:
        return [s.k for s in self.steps if s.accepted]

    def long_contigs(self) -> DataFrame:
        return self.contigs.filter(F.col("len") >= self.min_contig_length)

    def __len__(self) -> int:
        return self.long_contigs().count()

    def is_empty(self) -> bool:
        return self.long_contigs().isEmpty()

    def write_fasta(self, path: str, gzip: bool = False) -> int:
        return write_fasta(self.contigs, self.min_contig_length, path, gzip)


def preprocess(reads: DataFrame, k: int, floors: list[int], options: AssemblyOptions = AssemblyOptions(), carried: DataFrame | None = None, ceiling: int | None = None) -> Preprocessed:
    """Count, choose floor and cutoff, carry previous contigs over, filter.

    All floors are counted in one pass, so a looser floor is another column
    and no second scan. With the first-sighting filter the choice rests on a
    hash sample of the k-mers, scaled up; if it falls on a looser floor, the
    spectrum of all its k-mers is fitted again. Carried k-mers never enter the
    spectrum. A fixed cutoff stays at the strictest floor.
    """
    counts = cut_lineage(count_kmers(reads, k, floors))
    used = [f for f in floors if ceiling is None or f <= ceiling] or floors[:1]
    size = counts.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"n_f{floors.index(f)}") > 0).alias(f"at_{f}") for f in used)).first()
    if not any(size[f"at_{f}"] for f in used):
        raise PreprocessingError(f"no read holds a usable window of {k} bases at a floor of {used}")
    if options.min_count is not None and not size[f"at_{used[-1]}"]:
        raise PreprocessingError(f"no read holds a usable window of {k} bases at the floor of {used[-1]}")
    fraction, looked_at = 1.0, counts
    if options.first_sighting_filter:
        threshold = sample_threshold(size.n)
        fraction, looked_at = sample_fraction(threshold), sampled(counts, threshold)
        log.info("k=%d: sample %s", k, sample_check(counts, threshold).first())
    spectra = floor_spectra(looked_at, floors, used, fraction)
    fit = fitter(reads.sparkSession)
    first = choice = choose(spectra, options.min_count, fit, 1 / fraction)
    column = f"n_f{floors.index(choice.floor)}"
    spectrum = spectra[choice.floor]
    if options.min_count is None and choice.floor < used[-1]:
        spectrum = dense(histogram(counts, column))
        choice = recounted(choice, spectrum, fit)
    log.info("k=%d: floor %d, cutoff %d, peak %s (%s)", k, choice.floor, choice.min_count, choice.peak, choice.source)
    table = counts.select("kmer", F.col(column).alias("n")).filter("n > 0")
    if options.first_sighting_filter:
        table = gated_counts(table)
    if carried is not None:
        table = carry(table, carried, k, choice.min_count).select("kmer", "n")
    kept = cut_lineage(table.filter(F.col("n") >= choice.min_count))
    if kept.isEmpty():
        raise PreprocessingError(f"no {k}-mer reaches a count of {choice.min_count}")
    return Preprocessed(k, kept, spectrum, choice.min_count, choice.floor, choice.peak, choice.source, _unresolved(choice, options), not _unresolved(first, options), spectra, 1 / fraction)


def _unresolved(choice: Choice, options: AssemblyOptions) -> bool:
    return options.min_count is None and choice.min_count == 2 and choice.source != "Fitted"


def assemble_graph(kmers: DataFrame, k: int, correction: CorrectionOptions, sink: Callable[[DataFrame, DataFrame], None] | None = None) -> DataFrame:
    """Contigs of filtered k-mers; ``sink`` receives nodes and edges of the corrected graph before it is collapsed."""
    nodes = nodes_of(kmers)
    nodes, edges, removed = correct(nodes, overlap_edges(nodes, k), k, correction)
    log.info("k=%d: removed %s", k, removed)
    if sink:
        sink(nodes, edges)
    return collapse(nodes, edges, k)


def aun(contigs: DataFrame, min_length: int) -> float:
    """Length-weighted mean length of the contigs of at least ``min_length``; 0 without any."""
    row = contigs.filter(F.col("len") >= min_length).agg(F.sum(F.col("len").cast("double") * F.col("len")).alias("a"), F.sum("len").alias("b")).first()
    return row.a / row.b if row.b else 0.0


class FloorMemory:
    """Lowers the floors of later ks only after two resolved ks in a row chose lower ones, to the higher of the two."""

    def __init__(self, top: int):
        self.ceiling, self.last = top, None

    def saw(self, floor: int, resolved: bool) -> None:
        if not resolved:
            return
        if self.last is not None:
            self.ceiling = min(self.ceiling, max(floor, self.last))
        self.last = floor


def assemble(reads: DataFrame, options: AssemblyOptions = AssemblyOptions(), sink: Callable[[DataFrame, DataFrame], None] | None = None, intermediate: Callable[[int, DataFrame], None] | None = None, counted: Callable[[Preprocessed], None] | None = None) -> Assembly:
    """Contigs of reads (read_id, seq, qual) by the given k or ladder of ks.

    A later k ends the ladder softly if nothing can be counted or its peak is
    low; an unresolved one is kept only if it raises the auN. ``sink`` gets
    the corrected graph of the last k, unless that is a later one that stopped the ladder or is unresolved, ``intermediate`` the contigs
    of each k before, ``counted`` what counting gave at each k.
    """
    options.validated()
    began = time.monotonic()
    floors = effective_floors([r[0] for r in quality_alphabet(reads).collect()], options.min_quality, options.two_bit)
    store = ReadStore(reads, floors, options.two_bit)
    try:
        facts = store.statistics().first()
        if not facts.reads:
            raise InputError("no reads")
        if options.k is not None:
            ks = [options.k]
        else:
            ks = settled_ladder(list(options.ks) if options.ks else None, facts.longest)
        memory = FloorMemory(floors[-1])
        result: Assembly | None = None
        steps: list[Step] = []
        graph: tuple[DataFrame, DataFrame] | None = None
        stopped: tuple[int, str] | None = None
        for number, k in enumerate(ks):
            kept: list[tuple[DataFrame, DataFrame]] = []
            try:
                found = preprocess(store.reads(), k, floors, options, result.contigs if result else None, memory.ceiling)
            except PreprocessingError as problem:
                if number == 0:
                    raise
                stopped = (k, str(problem))
                break
            if counted:
                counted(found)
            if options.min_count is None:
                memory.saw(found.floor, found.chosen_floor_resolved)
            step = Step(k, found.floor, found.min_count, found.peak, found.source, True)
            steps.append(step)
            if number and (found.peak or 0) < LEAST_LADDER_PEAK:
                step.accepted, step.reason = False, f"the peak at k={k} is {found.peak}"
                stopped = (k, step.reason)
                break
            contigs = assemble_graph(found.kmers, k, options.correction_for(found.source, found.peak, found.min_count), lambda n, e: kept.append((n, e)))
            sizes = contigs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("b")).first()
            step.contigs, step.bases = sizes.n, sizes.b
            if number and found.unresolved and aun(contigs, options.min_contig_length) <= aun(result.contigs, options.min_contig_length):
                step.accepted, step.reason = False, "an unresolved spectrum did not improve the contigs"
                stopped = (k, step.reason)
                break
            if result and intermediate:
                intermediate(steps[-2].k, result.contigs)
            result, graph = Assembly(contigs, options.min_contig_length), kept[0] if kept else None
            log.info("%.1f s: k=%d gave %d contigs of %d bases", time.monotonic() - began, k, step.contigs, step.bases)
        assert result is not None
        result.steps, result.stopped_at = steps, stopped
        if sink and graph and not stopped and not (found.unresolved and number):
            try:
                sink(*graph)
            except Exception as problem:
                raise GraphOutputError(f"the graph could not be written: {problem}") from problem
        return result
    finally:
        store.close()


def spectrum_summary(spectrum: np.ndarray, min_count: int) -> dict:
    """What the spectrum says, for reports."""
    found = estimate(spectrum)
    source, peak = peak_source(spectrum, found)
    return {"valley": found.valley, "peak": peak, "peak_source": source, "resolved": found.resolved, "used_min_count": min_count}


__all__ = ["Assembly", "InvalidOptions", "Preprocessed", "assemble", "assemble_graph", "aun", "preprocess"]
