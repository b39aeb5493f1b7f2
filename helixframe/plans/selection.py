"""Choosing the quality floor and the smallest kept count from one spectrum per floor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .mixture import Fit, fit_spectrum
from .spectrum import UNRESOLVED_MIN_COUNT, Estimate, estimate, last_open, occurrence_median, peak_source

# Fixed values of the selection.
DEFAULT_FLOOR, LOOSE_GAP, LOOSE_LEAST = 20, 5, 10
MOST_ERROR_TAIL = 0.05
LOW_PEAK = 10
STEP_GAIN = 1.10


def floor_ladder(alphabet: list[int], default: int = DEFAULT_FLOOR) -> list[int]:
    """At most three ascending floors that suit the qualities that occur; [0] if they tell nothing."""
    bins = sorted(set(alphabet))
    strict = next((q for q in bins if q >= default), default)
    if len(bins) <= 1 or bins[0] >= strict:
        return [0]
    loose = [q for q in bins if LOOSE_LEAST < q <= strict - LOOSE_GAP]
    if loose and bins[0] < loose[-1]:
        return [0, loose[-1], strict]
    return [0, strict]


def effective_floors(alphabet: list[int], fixed: int | None = None, two_bit: bool = False) -> list[int]:
    if two_bit:
        return [0]
    return [fixed] if fixed is not None else floor_ladder(alphabet)


@dataclass(frozen=True)
class FloorVerdict:
    """What the spectrum of one floor says; ``error_tail`` is None where no fit or no count above the cutoff tells it."""

    floor: int
    estimate: Estimate
    fit: Fit | None
    min_count: int
    error_tail: float | None = None
    empty: bool = False

    @property
    def peak(self) -> int:
        """The peak seen in the spectrum, 0 without one."""
        return self.estimate.peak or 0

    @property
    def clean(self) -> bool:
        return self.error_tail is not None and self.error_tail <= MOST_ERROR_TAIL


def error_tail(h: np.ndarray, fit: Fit, cutoff: int) -> float | None:
    """Share of fitted errors in what is observed from the cutoff to six times the mode."""
    last = min(6 * fit.mode, fit.window, last_open(h))
    observed = h[cutoff - 1 : last].sum()
    return float(fit.errors[cutoff - 1 : last].sum() / observed) if observed else None


def evaluate(h: np.ndarray, floor: int, fitter: Callable = fit_spectrum, scale: float = 1.0) -> FloorVerdict:
    """Estimate, fit and cutoff of one floor.

    The fit guards the cutoff: it is lowered to what loses at most one
    single-copy k-mer, and never lies below the error floor.
    """
    found = estimate(h)
    if not h.sum():
        return FloorVerdict(floor, found, None, found.min_count, empty=True)
    fit = fitter(h, found.valley, found.peak, found.dispersion, **({} if scale == 1.0 else {"scale": scale}))[0] if found.resolved else None
    if fit is None:
        return FloorVerdict(floor, found, None, found.min_count)
    cutoff = fit.guarded(found.min_count)
    return FloorVerdict(floor, found, fit, cutoff, error_tail(h, fit, cutoff))


def needs_review(strict: FloorVerdict) -> bool:
    """Whether looser floors must be looked at: no windows, no fit, a long error tail or a low peak."""
    return strict.empty or strict.fit is None or not strict.clean or strict.peak < LOW_PEAK


@dataclass(frozen=True)
class Choice:
    """``verdicts`` are those of the floors that had a say; `floor_report` gives all."""

    floor: int
    min_count: int
    peak: int | None
    source: str
    unresolved: bool
    verdicts: tuple[FloorVerdict, ...] = ()


def _preferred(verdicts: list[FloorVerdict]) -> FloorVerdict | None:
    """Of the floors with a fit the strictest with a short error tail, else that of the largest fitted mode; without a fit
    that of the largest peak, found by the primary pair if any is."""
    fitted = [v for v in verdicts if v.fit]
    if len(fitted) > 1:
        clean = [v for v in fitted if v.clean]
        return max(clean, key=lambda v: v.floor) if clean else max(fitted, key=lambda v: (v.fit.mode, v.floor))
    if fitted:
        return fitted[0]
    resolved = [v for v in verdicts if v.estimate.resolved]
    return max(resolved, key=lambda v: (v.estimate.primary, v.peak, v.floor), default=None)


def floor_rows(spark: SparkSession, verdicts: list[FloorVerdict]) -> DataFrame:
    """Verdicts as a table, one row a floor."""
    rows = [(v.floor, v.estimate.valley, v.estimate.peak, v.fit.mode if v.fit else None, v.min_count, v.error_tail, v.estimate.resolved) for v in verdicts]
    return spark.createDataFrame(rows, "floor int, valley int, peak int, fitted_mode int, min_count int, error_tail double, resolved boolean")


def choose(spectra: dict[int, np.ndarray], fixed_min_count: int | None = None, fitter: Callable = fit_spectrum, scale: float = 1.0) -> Choice:
    """Floor and cutoff from the spectrum of each floor.

    The strictest floor decides unless it needs review; then all of them do.
    While the peak seen is low, the next looser floor is taken if its peak is
    a tenth higher and no fit is lost by it. If nothing resolves, the loosest
    floor with k-mers is kept with a cutoff of 2. The peak reported is the
    fitted mode, without a fit what the strictest spectrum tells.

    A fixed cutoff, 0 included, keeps the strictest floor and only takes the
    peak from its spectrum. ``scale`` is by how much spectra of a sample were
    scaled up.
    """
    floors = sorted(spectra)
    top = floors[-1]
    if fixed_min_count is not None:
        source, peak = peak_source(spectra[top], estimate(spectra[top]))
        return Choice(top, fixed_min_count, peak, source, False)
    judged = {top: evaluate(spectra[top], top, fitter, scale)}
    if needs_review(judged[top]):
        judged |= {f: evaluate(spectra[f], f, fitter, scale) for f in floors[:-1] if spectra[f].sum()}
    chosen = _preferred(list(judged.values()))
    if chosen is None:
        loosest = next((f for f in floors if spectra[f].sum()), floors[0])
        median = occurrence_median(spectra[top]) or occurrence_median(spectra[loosest])
        return Choice(loosest, UNRESOLVED_MIN_COUNT, median, "Fallback" if median else "Unknown", True, tuple(judged.values()))
    for looser in reversed(floors[: floors.index(chosen.floor)]):
        if chosen.peak >= LOW_PEAK or not spectra[looser].sum():
            break
        if looser not in judged:
            judged[looser] = evaluate(spectra[looser], looser, fitter, scale)
        lower = judged[looser]
        if not lower.estimate.resolved or lower.peak < STEP_GAIN * chosen.peak or (chosen.fit and not lower.fit):
            break
        chosen = lower
    source, peak = ("Fitted", chosen.fit.mode) if chosen.fit else peak_source(spectra[top], chosen.estimate)
    return Choice(chosen.floor, chosen.min_count, peak, source, False, tuple(judged.values()))


def recounted(choice: Choice, h: np.ndarray, fitter: Callable = fit_spectrum) -> Choice:
    """The choice after all k-mers of its floor were counted, not only a sample: that of their spectrum ``h``, with the peak
    seen in it, unless only the sample separated signal from errors."""
    again = evaluate(h, choice.floor, fitter)
    source, peak = peak_source(h, again.estimate)
    if choice.source == "Fitted" and source != "Fitted":
        return choice
    return Choice(choice.floor, again.min_count, peak, source, choice.unresolved and source != "Fitted", choice.verdicts)


def floor_report(spectra: dict[int, np.ndarray], fitter: Callable = fit_spectrum, scale: float = 1.0) -> list[FloorVerdict]:
    """The verdict on every floor with k-mers, strictest first, whichever of them decides."""
    return [evaluate(spectra[f], f, fitter, scale) for f in sorted(spectra, reverse=True) if spectra[f].sum()]
