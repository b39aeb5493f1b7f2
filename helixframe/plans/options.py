"""Options of a run and their validation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

# Anchors and steps of the default ladder, and the defaults of the options below.
ANCHORS, STEP, LEAST_LAST_GAIN, MOST_K, LONGEST_SLACK = (21, 31, 41, 55, 71), 20, 8, 255, 10


class AssemblyError(Exception):
    """Anything that ends a run."""


class InvalidOptions(AssemblyError, ValueError):
    pass


class InputError(AssemblyError):
    pass


class PreprocessingError(AssemblyError):
    pass


class SpellingError(AssemblyError):
    pass


class GraphOutputError(AssemblyError):
    pass


def check_ladder(ks: list[int]) -> None:
    """Every k odd and from 3 to 255, all strictly ascending."""
    if not ks:
        raise InvalidOptions("no k")
    for k in ks:
        if k % 2 == 0 or not 3 <= k <= MOST_K:
            raise InvalidOptions(f"k must be odd and between 3 and {MOST_K}, not {k}")
    if any(b <= a for a, b in zip(ks, ks[1:])):
        raise InvalidOptions("the ks must ascend strictly")


def default_ladder(longest_read: int) -> list[int]:
    """21 and further steps up to ten bases below the longest read.

    Where the next step would pass that, the largest odd k below it is the
    last one if it gains enough, or is the largest k there is.
    """
    ceiling = min(longest_read - LONGEST_SLACK, MOST_K)
    steps = [*ANCHORS, *range(ANCHORS[-1] + STEP, MOST_K + 1, STEP)]
    ks = [k for k in steps if k <= ceiling] or [ANCHORS[0]]
    last = ceiling - 1 + ceiling % 2
    if last > ks[-1] and (last - ks[-1] >= LEAST_LAST_GAIN or last == MOST_K):
        ks.append(last)
    return ks


def settled_ladder(explicit: list[int] | None, longest_read: int) -> list[int]:
    """The default for this read length, or the given ks without those that no read can hold; the first always stays."""
    if explicit is None:
        return default_ladder(longest_read)
    return [explicit[0]] + [k for k in explicit[1:] if k < longest_read]


def short_path_limit(bases: int, k: int) -> int:
    """k-mers of a path of so many bases."""
    return max(bases + 1 - k, 0)


def dead_end_bases(flat: int, k_multiple: float, k: int) -> int:
    return flat if k_multiple <= 0 else max(flat, math.floor(k_multiple * k + 0.5))


def bulge_kmers(k: int) -> int:
    return max(3 * k, k + 100) - (k - 1)


def connector_kmers(k: int) -> int:
    return 9 * k


@dataclass(frozen=True)
class CoverageReference:
    """What counts as an error, relative to the single-copy peak."""

    peak: int | None
    min_count: int
    fraction: float

    @property
    def ceiling(self) -> int | None:
        return None if self.peak is None else max(int(self.fraction * self.peak), self.min_count + 1)

    def error_like(self, count: float) -> bool:
        return self.ceiling is not None and count < self.ceiling

    def genomic(self, count: float) -> bool:
        return not self.error_like(count)


@dataclass(frozen=True)
class CorrectionOptions:
    dead_end_bases: int = 100
    dead_end_k_multiple: float = 2.5
    dead_end_covered_k_multiple: float = 10.0
    dead_end_ratio: float = 2.0
    pop_ratio: float = 0.1
    connector_ratio: float = 4.0
    connector_both: bool = False
    alternatives_tried: int | None = 131  # partial paths a search for alternatives goes on from, shortest first; None: all
    remove_dead_ends: bool = True
    remove_bulges: bool = True
    remove_connectors: bool = True
    coverage: CoverageReference = field(default_factory=lambda: CoverageReference(None, 2, 0.25))


@dataclass(frozen=True)
class AssemblyOptions:
    """Options of `helixframe.plans.assemble.assemble`; None leaves a choice to the data."""

    k: int | None = None
    ks: tuple[int, ...] | None = None
    min_count: int | None = None
    min_quality: int | None = None
    first_sighting_filter: bool = True
    two_bit: bool = False
    min_contig_length: int = 500
    pop_ratio: float = 0.1
    peak_ratio: float | None = None
    dead_end_bases: int = 100
    dead_end_k_multiple: float = 2.5
    dead_end_covered_k_multiple: float = 10.0
    dead_end_ratio: float = 2.0
    connector_ratio: float = 4.0
    connector_both: bool = False
    correct: bool = True

    def validated(self) -> "AssemblyOptions":
        if self.k is not None and self.ks is not None:
            raise InvalidOptions("give k or ks, not both")
        if self.k is not None or self.ks is not None:
            check_ladder([self.k] if self.k is not None else list(self.ks))
        if self.min_count in (0, 1) and self.first_sighting_filter:
            raise InvalidOptions("the first-sighting filter drops singletons, so min_count must be 2 or more with it")
        for name in ("pop_ratio", "peak_ratio"):
            value = getattr(self, name)
            if value is not None and not 0 < value < 1:
                raise InvalidOptions(f"{name} must lie between 0 and 1")
        for name in ("dead_end_k_multiple", "dead_end_covered_k_multiple"):
            value = getattr(self, name)
            if not 0 <= value < float("inf"):
                raise InvalidOptions(f"{name} must be finite and not negative")
        if not self.dead_end_ratio > 0:
            raise InvalidOptions("dead_end_ratio must be positive")
        if not self.connector_ratio > 1:
            raise InvalidOptions("connector_ratio must exceed 1")
        if self.two_bit and (self.k is not None or self.min_quality != 0):
            raise InvalidOptions("two-bit storage needs a ladder of ks and min_quality 0")
        return self

    def correction_for(self, source: str, peak: int | None, min_count: int) -> CorrectionOptions:
        """The correction at one k; what is error-like depends on where the peak comes from."""
        fraction = self.peak_ratio if self.peak_ratio is not None else (0.25 if source == "Fitted" else 0.15)
        return CorrectionOptions(self.dead_end_bases, self.dead_end_k_multiple, self.dead_end_covered_k_multiple, self.dead_end_ratio, self.pop_ratio, self.connector_ratio, self.connector_both, remove_dead_ends=self.correct, remove_bulges=self.correct, remove_connectors=self.correct, coverage=CoverageReference(peak, min_count, fraction))

    def with_(self, **changes) -> "AssemblyOptions":
        return replace(self, **changes)


@dataclass(frozen=True)
class QualityChoice:
    min_count: int
    min_quality: int

    def __str__(self) -> str:
        return f"min count {self.min_count}, minimum quality {self.min_quality} ({chr(self.min_quality + 33)})"
