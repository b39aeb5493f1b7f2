"""Command line: ``python -m helixframe reads.fastq.gz ... -o out/sample``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from .plans import mixture
from .plans import options as O
from .plans.assemble import assemble, spectrum_summary
from .plans.selection import floor_report
from .session import local_session
from .sources import fastx, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description="Assemble short reads.")
    d = O.AssemblyOptions()
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("reads", nargs="*", default=[], help="FASTA or FASTQ files, plain or compressed")
    source.add_argument("--sheet", help="sheet of lines 'sample file ...'; all samples are assembled together")
    p.add_argument("-o", "--output", required=True, help="prefix of all output files")
    p.add_argument("-k", type=int, help="one k; without it a ladder")
    p.add_argument("--ks", type=lambda s: tuple(int(x) for x in s.split(",")), help="ladder of ks, ascending")
    p.add_argument("--min-count", type=int, help="smallest count that is kept; fitted without it")
    p.add_argument("--min-quality", type=int, help="quality floor; chosen from the data without it")
    p.add_argument("--no-first-sighting-filter", action="store_true", help="look at singletons too")
    p.add_argument("--two-bit", action="store_true", help="store bases only")
    p.add_argument("--min-contig-length", type=int, default=d.min_contig_length)
    p.add_argument("--pop-ratio", type=float, default=d.pop_ratio)
    p.add_argument("--peak-ratio", type=float)
    p.add_argument("--dead-end-bases", type=int, default=d.dead_end_bases)
    p.add_argument("--dead-end-k-multiple", type=float, default=d.dead_end_k_multiple)
    p.add_argument("--dead-end-covered-k-multiple", type=float, default=d.dead_end_covered_k_multiple)
    p.add_argument("--dead-end-ratio", type=float, default=d.dead_end_ratio)
    p.add_argument("--connector-ratio", type=float, default=d.connector_ratio)
    p.add_argument("--connector-both", action="store_true")
    p.add_argument("--no-correction", action="store_true")
    p.add_argument("--graph", action="store_true", help="write the corrected graph as DOT and GFA")
    p.add_argument("--gzip", action="store_true")
    p.add_argument("--debug-floors", action="store_true", help="report and plot every quality floor; decides nothing")
    p.add_argument("--threads", type=threads, default="*", help="local cores, if no cluster session exists")
    return p


def threads(text: str) -> int | str:
    """A positive number of cores, or * for all there are."""
    if text == "*":
        return text
    if not text.isdigit() or not int(text):
        raise argparse.ArgumentTypeError("threads must be a positive number")
    return int(text)


def options_of(a: argparse.Namespace) -> O.AssemblyOptions:
    return O.AssemblyOptions(
        k=a.k, ks=a.ks, min_count=a.min_count, min_quality=a.min_quality, first_sighting_filter=not a.no_first_sighting_filter, two_bit=a.two_bit,
        min_contig_length=a.min_contig_length, pop_ratio=a.pop_ratio, peak_ratio=a.peak_ratio, dead_end_bases=a.dead_end_bases,
        dead_end_k_multiple=a.dead_end_k_multiple, dead_end_covered_k_multiple=a.dead_end_covered_k_multiple, dead_end_ratio=a.dead_end_ratio,
        connector_ratio=a.connector_ratio, connector_both=a.connector_both, correct=not a.no_correction,
    ).validated()


def main(argv: list[str] | None = None) -> int:
    """Exit status 0, 1 for a failed run, 2 for invalid options."""
    a = parser().parse_args(argv)
    try:
        options = options_of(a)
        if a.two_bit and a.debug_floors:
            raise O.InvalidOptions("two-bit storage has no qualities to report on")
    except O.InvalidOptions as problem:
        print(problem, file=sys.stderr)
        return 2
    Path(a.output).parent.mkdir(parents=True, exist_ok=True)
    log = sinks.run_log(f"{a.output}.log")
    if isinstance(a.threads, int) and a.threads > (os.cpu_count() or 1):
        log.warning("%d threads on %d cores", a.threads, os.cpu_count() or 1)
    spark = local_session(a.threads)
    try:
        paths = a.reads
        if a.sheet:
            rows = fastx.sample_sheet(spark, a.sheet).orderBy("sample", "pos").collect()
            if len({r.sample for r in rows}) > 1:
                log.warning("all samples of the sheet are assembled together")
            paths = [r.path for r in rows]
        reads = fastx.reads_of(fastx.read_fastx(spark, paths))
        prefix = a.output

        def graph(nodes, edges):
            sinks.write_graph(nodes, edges, result_k[-1], prefix)

        result_k: list[int] = []
        spectra = lambda found: _report(found, prefix, log, result_k, a.debug_floors)
        result = assemble(reads, options, graph if a.graph else None, lambda k, contigs: sinks.write_fasta(contigs, options.min_contig_length, sinks.step_name(prefix, k, False), a.gzip), spectra)
        n = result.write_fasta(sinks.step_name(prefix, result.completed_ks[-1], True), a.gzip)
        log.info("wrote %d contigs; ks %s, stopped at %s", n, result.completed_ks, result.stopped_at)
        return 0
    except Exception as problem:  # the log shall have what ended the run
        log.error("%s: %s", type(problem).__name__, str(problem).splitlines()[0] if str(problem) else "")
        return 1


def _report(found, prefix: str, log, ks: list[int], all_floors: bool = False) -> None:
    """Table and plots of one k's spectrum, and of every floor's."""
    ks.append(found.k)
    name = sinks.spectrum_name(prefix, found.k)
    sinks.write_spectrum_tsv(found.spectrum, f"{name}.spectrum.tsv")
    sinks.write_spectrum_plots(found.spectrum, {"peak": found.peak, "cutoff": found.min_count}, name)
    log.info("k=%d: %s", found.k, spectrum_summary(found.spectrum, found.min_count))
    for v in floor_report(found.spectra, mixture.fitter(found.kmers.sparkSession), found.scale) if all_floors else ():
        name = sinks.spectrum_name(prefix, found.k, v.floor)
        sinks.write_spectrum_tsv(found.spectra[v.floor], f"{name}.spectrum.tsv")
        sinks.write_spectrum_plots(found.spectra[v.floor], {"peak": v.estimate.peak, "cutoff": v.min_count}, name, v.fit.heights.sum(axis=0) if v.fit else None)
        log.info("k=%d, floor %d: peak %s, fitted mode %s, cutoff %d, error tail %s", found.k, v.floor, v.estimate.peak, v.fit.mode if v.fit else None, v.min_count, v.error_tail)


if __name__ == "__main__":
    sys.exit(main())
