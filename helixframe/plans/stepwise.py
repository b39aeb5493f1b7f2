"""An assembly in two steps for interactive callers: settings that never raise, then counting, then contigs."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame

from ..operators.counting import BINS
from ..sources.reads import quality_alphabet, statistics
from ..sources.sinks import REPORTED_BINS, gfa_lines
from .assemble import Assembly, Preprocessed, assemble, preprocess
from .options import AssemblyOptions, InvalidOptions, settled_ladder
from .selection import effective_floors

log = logging.getLogger("helixframe")


class Stepwise:
    """Holds reads and options between calls; a setting that is not valid is ignored with a warning."""

    def __init__(self, reads: DataFrame, options: AssemblyOptions = AssemblyOptions()):
        self.reads, self.options = reads, options.validated()
        self.first: Preprocessed | None = None
        self.result: Assembly | None = None
        self._graph: tuple[DataFrame, DataFrame] | None = None

    def _set(self, **changes) -> bool:
        try:
            self.options = self.options.with_(**changes).validated()
            return True
        except (InvalidOptions, TypeError) as problem:
            log.warning("ignored %s: %s", changes, problem)
            return False

    def set_many_ks(self, ks: list[int] | None) -> bool:
        """A ladder of these ks, or the default one."""
        return self._set(k=None, ks=tuple(ks) if ks is not None else None)

    def set_k(self, k: int) -> bool:
        return self._set(k=k, ks=None)

    def set_pop_ratio(self, ratio: float) -> bool:
        return self._set(pop_ratio=ratio)

    def set_dead_end_k_multiple(self, multiple: float) -> bool:
        return self._set(dead_end_k_multiple=multiple)

    def _ks(self) -> list[int]:
        if self.options.k is not None:
            return [self.options.k]
        return settled_ladder(list(self.options.ks) if self.options.ks else None, statistics(self.reads).first().longest)

    def preprocess(self) -> str:
        """Count the first k; JSON with the number of kept k-mers, the first bins of the spectrum, the cutoff, k and whether more follow."""
        ks = self._ks()
        floors = effective_floors([r[0] for r in quality_alphabet(self.reads).collect()], self.options.min_quality, self.options.two_bit)
        self.first = preprocess(self.reads, ks[0], floors, self.options)
        h = self.first.spectrum[: min(REPORTED_BINS, BINS)].tolist()
        return json.dumps({"nkmers": self.first.kmers.count(), "histo": h, "used_min_count": self.first.min_count, "k": ks[0], "multik": len(ks) > 1})

    def assemble(self) -> str:
        """All ks; JSON with the number of contigs that are long enough."""
        self.result = assemble(self.reads, self.options, self._keep)
        return json.dumps({"ncontigs": len(self.result)})

    def _keep(self, nodes: DataFrame, edges: DataFrame) -> None:
        self._graph = nodes, edges

    def take_contigs(self) -> DataFrame | None:
        """The contigs, once; None before `assemble` and after they were taken."""
        taken, self.result = self.result, None
        return taken.long_contigs() if taken else None

    def take_graph(self) -> DataFrame | None:
        """The corrected graph's GFA lines, once; None if the run gave no graph."""
        taken, self._graph = self._graph, None
        return gfa_lines(*taken, self._ks()[-1]) if taken else None
