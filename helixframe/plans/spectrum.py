"""Reading a count spectrum: valley, peak, guards and the smallest count that is kept.

Everything works on a dense array of at most 8000 bins, element c-1 holding
the number of distinct k-mers seen c times; the last bin holds all higher
counts and takes no part in searches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.numbers import poisson_cdf_below

# Fixed values of the estimator.
SMOOTH_REACH = 2
CONFIRMING_BINS = 3
RAW_PAIR_LIMIT, RAW_PAIR_GAP = 15, 10
PEAK_REACH = (13, 10)
LEAST_AREA = 0.05
LEAST_INSTANCES, LEAST_HEIGHT = 0.20, 1.75
LOSS = 0.01
UNRESOLVED_MIN_COUNT = 2


def at(h: np.ndarray, count: int) -> int:
    return int(h[count - 1])


def last_open(h: np.ndarray) -> int:
    """The highest count that is not saturated."""
    return len(h) - 1


def smoothed(h: np.ndarray) -> np.ndarray:
    """Integer mean of five bins, fewer at the ends of the unsaturated bins; the saturated bin stays as it is."""
    n = last_open(h)
    run = np.concatenate(([0], np.cumsum(h[:n].astype(np.int64))))
    c = np.arange(n)
    low, high = np.maximum(c - SMOOTH_REACH, 0), np.minimum(c + SMOOTH_REACH + 1, n)
    out = h.astype(np.int64).copy()
    out[:n] = (run[high] - run[low]) // (high - low)
    return out


def occurrence_median(h: np.ndarray) -> int | None:
    """The smallest count with which, weighted by count, half of all occurrences are reached."""
    weight = np.arange(1, len(h) + 1) * h.astype(np.int64)
    total = int(weight.sum())
    return int(np.argmax(2 * np.cumsum(weight) >= total)) + 1 if total else None


def valley_seed(h: np.ndarray) -> int | None:
    """From count 2 on, the lowest occupied bin that three later occupied bins do not go below."""
    lowest, confirmed = None, 0
    for c in range(2, last_open(h) + 1):
        v = at(h, c)
        if not v:
            continue
        if lowest is None or v < at(h, lowest):
            lowest, confirmed = c, 0
        else:
            confirmed += 1
            if confirmed == CONFIRMING_BINS:
                return lowest
    return None


def highest(h: np.ndarray, first: int, last: int | None = None) -> int | None:
    """The bin of most k-mers from ``first`` on, the lowest of equal ones; none if all are empty."""
    last = last_open(h) if last is None else min(last, last_open(h))
    if last < first:
        return None
    c = first + int(np.argmax(h[first - 1 : last]))
    return c if at(h, c) else None


def lowest(h: np.ndarray, first: int, last: int) -> int:
    return first + int(np.argmin(h[first - 1 : last]))


def _nearest(counts: np.ndarray, to: int) -> int:
    return int(min(counts.tolist(), key=lambda c: (abs(c - to), c)))


def refined_valley(h: np.ndarray, raw_valley: int, raw_peak: int) -> int:
    s = smoothed(h)[1:raw_peak]
    return _nearest(np.flatnonzero(s == s.min()) + 2, raw_valley)


def refined_peak(h: np.ndarray, raw_valley: int, valley: int, raw_peak: int) -> int | None:
    first, last = max(raw_valley, valley + 1), min(PEAK_REACH[0] * raw_peak // PEAK_REACH[1], last_open(h))
    c = np.arange(first, last + 1)
    c = c[h[c - 1] > 0]
    if not len(c):
        return None
    s = smoothed(h)[c - 1]
    return _nearest(c[s == s.max()], raw_peak)


def first_local_valley(h: np.ndarray) -> int | None:
    for c in range(2, last_open(h)):
        if at(h, c) < at(h, c - 1) and at(h, c) < at(h, c + 1):
            return c
    return None


def declines(h: np.ndarray, peak: int) -> bool:
    """Whether sums of neighbouring bins fall strictly from the peak on."""
    pairs = [at(h, c) + at(h, c + 1) for c in range(peak, peak + 3)] if peak + 3 <= last_open(h) else []
    return len(pairs) == 3 and pairs[0] > pairs[1] > pairs[2]


def distinct_from(h: np.ndarray, valley: int) -> int:
    return int(h[valley - 1 :].sum())


def mirrored_area(h: np.ndarray, valley: int, peak: int) -> float | None:
    """Share of the k-mers seen twice or more that lie between the valley and its mirror image behind the peak."""
    mirror = 2 * peak - valley
    total = int(h[1:].sum())
    if valley < 2 or peak <= valley or mirror > last_open(h) or not total:
        return None
    return float(h[valley - 1 : mirror].sum() / total)


def instances_from(h: np.ndarray, valley: int) -> float:
    weight = np.arange(1, len(h) + 1) * h.astype(np.int64)
    return float(weight[valley - 1 :].sum() / weight.sum()) if weight.sum() else 0.0


def measured_guard(h: np.ndarray, valley: int, peak: int) -> int:
    """The largest cutoff up to the peak that loses at most 1 % of the k-mers from the valley on; 2 at least."""
    n = last_open(h)
    total = int(h[valley - 1 : n].sum())
    best = 2
    for m in range(valley, min(peak, n) + 1):
        if int(h[valley - 1 : m - 1].sum()) <= LOSS * total:
            best = max(best, m)
    return best


def poisson_guard(peak: int) -> int:
    best = 2
    for m in range(2, peak + 1):
        if poisson_cdf_below(m, peak) <= LOSS:
            best = m
    return best


def lobe_dispersion(h: np.ndarray, valley: int, peak: int) -> float:
    """Variance over mean of the counts from the valley to twice the peak."""
    c = np.arange(valley, min(2 * peak, last_open(h)))
    w = h[c - 1].astype(float) if len(c) else np.zeros(0)
    if not w.sum():
        return float("nan")
    mean = (c * w).sum() / w.sum()
    return float((w * (c - mean) ** 2).sum() / w.sum() / mean)


def shelf_share(h: np.ndarray, valley: int, peak: int) -> float:
    """First guess of the share of k-mers on a shelf below the peak."""
    lobe = h[valley - 1 : 2 * peak].sum()
    return float(np.clip(2 * h[valley - 1 : max(peak // 2, valley - 1)].sum() / lobe, 0.01, 0.4)) if lobe else 0.05


@dataclass(frozen=True)
class Estimate:
    """``valley`` and ``peak`` are None where the spectrum shows none; ``resolved`` tells whether they separate signal from errors."""

    valley: int | None
    peak: int | None
    min_count: int
    resolved: bool
    primary: bool = False
    dispersion: float = float("nan")
    reason: str = ""


def primary_pair(h: np.ndarray) -> tuple[int, int] | None:
    seed = valley_seed(h)
    peak = highest(h, seed) if seed else None
    if peak is None or peak < 2:
        return None
    valley = lowest(h, 2, peak)
    if valley >= peak:
        return None
    if peak < RAW_PAIR_LIMIT and valley < RAW_PAIR_LIMIT and peak - valley < RAW_PAIR_GAP:
        return valley, peak
    smooth_valley = refined_valley(h, valley, peak)
    smooth_peak = refined_peak(h, valley, smooth_valley, peak)
    return (smooth_valley, smooth_peak) if smooth_peak else (valley, peak)


def fallback_pair(h: np.ndarray) -> tuple[int, int] | None:
    valley = first_local_valley(h)
    peak = highest(h, valley + 1) if valley else None
    return (valley, peak) if peak and declines(h, peak) else None


def _verdict(h: np.ndarray, valley: int, peak: int) -> str:
    """Empty if valley and peak separate, else what speaks against it."""
    if instances_from(h, valley) < LEAST_INSTANCES:
        return "too few occurrences lie above the valley"
    if at(h, peak) < LEAST_HEIGHT * max(at(h, valley), 1):
        return "the peak hardly rises above the valley"
    return ""


def estimate(h: np.ndarray) -> Estimate:
    """Valley, peak and smallest kept count: the primary pair, else the first local valley, else unresolved with 2."""
    reason = "no valley and peak"
    for pair, primary in ((primary_pair(h), True), (fallback_pair(h), False)):
        if pair is None:
            continue
        valley, peak = pair
        area = mirrored_area(h, valley, peak)
        if area is None or area < LEAST_AREA:
            reason = "the peak holds too few k-mers"
            continue
        reason = _verdict(h, valley, peak)
        if reason and primary:
            continue
        if not reason:
            guard = min(measured_guard(h, valley, peak), poisson_guard(peak))
            return Estimate(valley, peak, int(np.clip(valley, 2, max(guard, 2))), True, primary, lobe_dispersion(h, valley, peak))
    return Estimate(None, None, UNRESOLVED_MIN_COUNT, False, reason=reason)


def peak_source(h: np.ndarray, found: Estimate) -> tuple[str, int | None]:
    """Where the single-copy peak comes from: ``Fitted``, the ``Fallback`` median, or ``Unknown``."""
    if found.resolved:
        return "Fitted", found.peak
    median = occurrence_median(h)
    return ("Fallback", median) if median else ("Unknown", None)
