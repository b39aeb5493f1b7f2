"""Mixture fit of a spectrum: errors, single-copy k-mers with a shelf of lost coverage, and repeats.

Errors are a free share of singletons and a tail with survival
exp(-rate ((x-1)^shape - 1) / shape) from 2 on, or its limit for shape 0, a
power law. Single-copy and repeated k-mers are negative binomials of one
dispersion; a beta-binomial shelf may hold a part of the single-copy ones.
Every component is a distribution over the fitted counts, so its weight is its
share of the k-mers seen there. Several starts of every configuration are
refined with the Nelder-Mead simplex, and the valid fit of lowest BIC is taken.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..functions.numbers import ln_beta_binomials, ln_negative_binomial, ln_softmax, ln_sub_exp, ln_sum, lse, negative_binomial_mode, sigmoid
from .spectrum import last_open, shelf_share

# Fixed values of the fit.
WINDOW = 6
MODE_LEAST, MODE_SPAN = 0.75, 0.58
REPEAT_RANGE = (1.5, 2.0)
DISPERSIONS, NO_HINT = (2.0, 8.0, 15.0), 2.0
ERROR_STARTS = {False: ((1.5, 0.8, 0.0), (2.5, 0.95, 0.0)), True: ((1.5, 0.8, 0.05), (2.5, 0.9, 0.5), (2.0, 0.95, 1.0))}  # rate, singletons, shape
SHELF_STARTS = ((0.5, 3.0), (0.75, 4.0))  # kept coverage, concentration
LN_REPEAT_START, REPEAT_START = -3.0, 1.9
SIMPLEX_STEP, SIMPLEX_TOLERANCE = 0.5, 1e-4
ITERATIONS = {False: 1000, True: 2000}
SHELF_MOST_SHARE, SHELF_LEAST_KEPT, SHELF_MOST_CONCENTRATION = 0.5, 0.3, 20.0
MOST_MASS = 1.10
MODE_SLACK = 0.5
MODE_RATIOS, MODE_RATIO_PEAKS = (1.25, 1.40), (100, 200)
LEAST_REPEAT_RATIO = 1.4
HOLES = 1.0


def nelder_mead(cost: Callable[[np.ndarray], float], start: np.ndarray, iterations: int) -> tuple[np.ndarray, float, bool]:
    """The best point, its cost, and whether the spread of costs over the simplex fell below the tolerance."""
    n = len(start)
    simplex = np.vstack([start, start + SIMPLEX_STEP * np.eye(n)])
    costs = np.array([cost(p) for p in simplex])
    for _ in range(iterations):
        order = np.argsort(costs, kind="stable")
        simplex, costs = simplex[order], costs[order]
        if np.isfinite(costs).all() and costs.std() < SIMPLEX_TOLERANCE:
            return simplex[0], float(costs[0]), True
        center = simplex[:-1].mean(axis=0)
        reach = lambda t: (p := center + t * (simplex[-1] - center), cost(p))
        point, value = reach(-1.0)
        if value < costs[0]:
            further, better = reach(-2.0)
            point, value = (further, better) if better < value else (point, value)
        elif value >= costs[-2]:
            inner, nearer = reach(-0.5 if value < costs[-1] else 0.5)
            if nearer >= min(value, costs[-1]):
                simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
                costs[1:] = [cost(p) for p in simplex[1:]]
                continue
            point, value = inner, nearer
        simplex[-1], costs[-1] = point, value
    return simplex[0], float(costs[0]), False


@dataclass(frozen=True)
class Configuration:
    weibull: bool
    shelf: bool

    @property
    def name(self) -> tuple[str, str]:
        return "Weibull" if self.weibull else "Pareto", "shelf" if self.shelf else "plain"

    @property
    def parameters(self) -> int:
        return 7 + self.weibull + 3 * self.shelf


@dataclass(frozen=True)
class Shelf:
    """A beta-binomial part of the single-copy k-mers, which kept only a part of the coverage."""

    share: float
    alpha: float
    beta: float

    @property
    def valid(self) -> bool:
        most, eps = self.alpha + self.beta, 1e-9
        if not (math.isfinite(most) and self.beta > 0 and 0 < self.share < SHELF_MOST_SHARE):
            return False
        return self.alpha >= 1 - eps and self.alpha / most >= SHELF_LEAST_KEPT - eps and most <= SHELF_MOST_CONCENTRATION + eps


@dataclass(frozen=True)
class Parts:
    """Decoded parameters."""

    ln_weights: np.ndarray
    singletons: float
    rate: float
    shape: float
    target: float
    dispersion: float
    ratio: float
    shelf: Shelf | None = None

    @property
    def mean(self) -> float:
        return self.target + self.dispersion - 1


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _exp(x: float) -> float:
    return math.exp(min(x, 700.0))


def decode(theta: np.ndarray, configuration: Configuration, peak: float) -> Parts:
    """Weights by softmax with the errors' logit 0; the mode stays near the peak seen."""
    single, repeat, mode, spread, rate, singletons, *rest = (float(t) for t in theta)
    shape = _exp(rest.pop(0)) if configuration.weibull else 0.0
    low, high = REPEAT_RANGE
    ratio = low + (high - low) * sigmoid(rest.pop(0))
    shelf = None
    if configuration.shelf:
        share, kept, tight = (sigmoid(t) for t in rest)
        kept = SHELF_LEAST_KEPT + (1 - SHELF_LEAST_KEPT) * kept
        total = 1 / kept + (SHELF_MOST_CONCENTRATION - 1 / kept) * tight
        shelf = Shelf(SHELF_MOST_SHARE * share, kept * total, (1 - kept) * total)
    return Parts(ln_softmax(np.array([0.0, single, repeat])), sigmoid(singletons), _exp(rate), shape, peak * (MODE_LEAST + MODE_SPAN * sigmoid(mode)), 1 + _exp(spread), ratio, shelf)


def ln_errors(x: np.ndarray, p: Parts) -> np.ndarray:
    def survival(v: np.ndarray) -> np.ndarray:
        y = np.log(np.maximum(v - 1.0, 1.0))
        return -p.rate * (y if p.shape == 0 else np.expm1(np.minimum(p.shape * y, 700)) / p.shape)

    tail = ln_sub_exp(survival(x), survival(x + 1)) + math.log1p(-p.singletons) if p.singletons < 1 else np.full(len(x), -np.inf)
    return np.where(x == 1, math.log(max(p.singletons, 1e-300)), tail)


def trials(mean: float) -> int:
    return max(1, math.floor(mean + 0.5))


def ln_single_copy(last: int, p: Parts) -> np.ndarray:
    """Log density of the single-copy k-mers at the counts 0 to ``last``."""
    lobe = ln_negative_binomial(np.arange(last + 1), p.mean, p.dispersion)
    if p.shelf is None:
        return lobe
    shelf = ln_beta_binomials(last, trials(p.mean), p.shelf.alpha, p.shelf.beta)
    return lse(math.log1p(-p.shelf.share) + lobe, math.log(p.shelf.share) + shelf)


def ln_components(x: np.ndarray, p: Parts) -> tuple[np.ndarray, np.ndarray]:
    """Log densities of errors, single copy and repeats at the counts 1 to the last of ``x``, each over its mass there; and these masses."""
    rows = np.stack([ln_errors(x, p), ln_single_copy(int(x[-1]), p)[1:], ln_negative_binomial(x, p.mean * p.ratio, p.dispersion)])
    masses = ln_sum(rows)
    return rows - masses[:, None], masses


def cost_of(theta: np.ndarray, configuration: Configuration, peak: float, x: np.ndarray, observed: np.ndarray) -> float:
    """Negative log-likelihood of the spectrum given that counts fall into the window."""
    if not np.isfinite(theta).all():
        return math.inf
    with np.errstate(all="ignore"):
        p = decode(theta, configuration, peak)
        if not (p.rate > 0 and p.singletons < 1 and math.isfinite(p.mean) and abs(p.mean - (p.dispersion - 1) - p.target) <= MODE_SLACK) or (p.shelf and not p.shelf.valid):
            return math.inf
        rows, masses = ln_components(x, p)
        if not np.isfinite(masses).all():
            return math.inf
        value = -float((observed * ln_sum((rows + p.ln_weights[:, None]).T))[observed > 0].sum())
    return value if math.isfinite(value) and value >= 0 else math.inf


@dataclass(frozen=True)
class Fit:
    """A refined start; ``heights`` are the k-mers of errors, single copy and repeats expected at the counts 1, 2, ...
    of the window, ``totals`` those over all counts, both of the whole library."""

    configuration: Configuration
    parts: Parts
    heights: np.ndarray
    totals: np.ndarray
    cost: float
    bic: float
    deviance: float
    distinct: float
    window: int

    @property
    def errors(self) -> np.ndarray:
        return self.heights[0]

    @property
    def single(self) -> np.ndarray:
        return self.heights[1]

    @property
    def genome(self) -> np.ndarray:
        return self.heights[1] + self.heights[2]

    @property
    def weights(self) -> np.ndarray:
        return np.exp(self.parts.ln_weights)

    @property
    def mean(self) -> float:
        return self.parts.mean

    @property
    def dispersion(self) -> float:
        return self.parts.dispersion

    @property
    def mode(self) -> int:
        return negative_binomial_mode(self.mean, self.dispersion)

    @property
    def repeat_mode(self) -> int:
        return negative_binomial_mode(self.mean * self.parts.ratio, self.dispersion)

    def crossover(self) -> int | None:
        """The first count below the mean at which single-copy k-mers outnumber errors, 2 at least; none if they never do."""
        over = np.flatnonzero((self.single > self.errors)[: max(0, min(max(trials(self.mean), 2), self.window) - 1)])
        return max(int(over[0]) + 1, 2) if len(over) and self.mean >= 2 else None

    def hole_cutoff(self, budget: float = HOLES) -> int | None:
        """The largest cutoff below which at most ``budget`` single-copy k-mers are lost, those never seen included, 2 at
        least; none if every cutoff up to the mean stays within it."""
        last = min(trials(self.mean), self.window)
        if self.totals[1] <= 0 or self.mean < 2 or last < 2:
            return None
        lost = self.totals[1] * np.cumsum(np.exp(ln_single_copy(last - 1, self.parts)))
        beyond = np.flatnonzero(lost[1:] > budget)
        return max(int(beyond[0]) + 1, 2) if len(beyond) else None

    def error_floor(self) -> int:
        """One past the last count at which errors alone reach the height of the single-copy mode; 2 at least."""
        reached = np.flatnonzero(self.errors >= self.single[min(max(self.mode, 1), self.window) - 1])
        return max(int(reached[-1]) + 2, 2) if len(reached) else 2

    def guarded(self, cutoff: int) -> int:
        """A cutoff lowered to what loses at most one single-copy k-mer, but never below the error floor."""
        hole = self.hole_cutoff()
        return max(min(cutoff, hole) if hole is not None else cutoff, self.error_floor())


def fit_of(configuration: Configuration, p: Parts, last: int, observed: np.ndarray, cost: float, scale: float, distinct: float) -> Fit:
    """What the parameters say about a library of which ``observed`` (at the counts 1 to ``last``) is one part in ``scale``."""
    with np.errstate(all="ignore"):
        rows, masses = ln_components(np.arange(1, last + 1), p)
        seen = float(observed.sum())
        heights = np.exp(rows + p.ln_weights[:, None]) * seen * scale
        expected = heights.sum(axis=0) / scale
        some = observed > 0
        deviance = 2 * float((observed[some] * np.log(observed[some] / expected[some])).sum())
        return Fit(configuration, p, heights, np.exp(p.ln_weights + math.log(seen * scale) - masses), cost, 2 * cost + configuration.parameters * math.log(seen), deviance, distinct, last)


def starts_of(configuration: Configuration, h: np.ndarray, valley: int, peak: int, dispersion: float) -> list[np.ndarray]:
    """Every dispersion with every error start, and with every form of the shelf."""
    hint = dispersion if math.isfinite(dispersion) and dispersion > 1 else NO_HINT
    low, high = REPEAT_RANGE
    ratio = _logit((REPEAT_START - low) / (high - low))
    share = _logit(shelf_share(h, valley, peak) / SHELF_MOST_SHARE)
    shelves = [(share, _logit((kept - SHELF_LEAST_KEPT) / (1 - SHELF_LEAST_KEPT)), _logit((tight - 1 / kept) / (SHELF_MOST_CONCENTRATION - 1 / kept))) for kept, tight in SHELF_STARTS] if configuration.shelf else [()]
    errors = [(math.log(rate), _logit(singletons), *([math.log(shape)] if configuration.weibull else [])) for rate, singletons, shape in ERROR_STARTS[configuration.weibull]]
    return [
        np.array([0.0, LN_REPEAT_START, 0.0, math.log(max(d - 1, 1e-3)), *error, ratio, *shelf])
        for d in (*DISPERSIONS, hint) for error in errors for shelf in shelves
    ]


def rejection(fit: Fit, valley: int, peak: int) -> str:
    """Empty, or the first reason not to trust a fit."""
    p = fit.parts
    if not (math.isfinite(fit.cost) and math.isfinite(fit.deviance) and math.isfinite(fit.bic)):
        return "not finite"
    if fit.cost < 0:
        return "a likelihood above one"
    if abs(fit.weights.sum() - 1) > 1e-8 or not np.isfinite(fit.totals).all() or not (math.isfinite(p.mean) and p.mean > 0 and p.dispersion > 1) or (p.shelf and not p.shelf.valid):
        return "invalid components"
    if fit.totals.sum() > MOST_MASS * fit.distinct:
        return "the components hold more than there is"
    if abs(p.mean - (p.dispersion - 1) - p.target) > MODE_SLACK:
        return "mode and mean disagree"
    if fit.mode > fit.window or fit.repeat_mode > fit.window:
        return "a lobe lies outside the window"
    if len(fit.errors) - int(np.argmax(fit.errors[::-1])) >= valley:
        return "errors peak above the valley"
    limit = float(np.interp(peak, MODE_RATIO_PEAKS, MODE_RATIOS))
    if fit.mode <= 0 or peak <= 0 or max(fit.mode / peak, peak / fit.mode) > limit:
        return "the mode is far from the peak"
    if fit.repeat_mode < LEAST_REPEAT_RATIO * fit.mode:
        return "repeats are not apart from single copies"
    return ""


def _refined(h: np.ndarray, peak: int, last: int, jobs: list[tuple[Configuration, np.ndarray]]) -> list[tuple[np.ndarray, float, bool]]:
    x, observed = np.arange(1, last + 1), h[:last].astype(float)
    return [nelder_mead(lambda theta, c=c: cost_of(theta, c, peak, x, observed), start, ITERATIONS[c.shelf]) for c, start in jobs]


def _refined_by(spark: SparkSession, h: np.ndarray, peak: int, last: int, jobs: list[tuple[Configuration, np.ndarray]]) -> list[tuple[np.ndarray, float, bool]]:
    """Every start as a task of its own; a few dozen rows come back."""

    def run(frames):
        for frame in frames:
            for number in frame["number"]:
                theta, cost, converged = _refined(h, peak, last, [jobs[number]])[0]
                yield pd.DataFrame({"number": [number], "theta": [theta], "cost": [cost], "converged": [converged]})

    numbers = spark.range(0, len(jobs), 1, len(jobs)).withColumnRenamed("id", "number")
    rows = numbers.mapInPandas(run, "number long, theta array<double>, cost double, converged boolean").collect()
    return [(np.array(r.theta), r.cost, r.converged) for r in sorted(rows, key=lambda r: r.number)]


def fitter(spark: SparkSession):
    """`fit_spectrum` with its starts spread over the cluster."""
    return functools.partial(fit_spectrum, spark=spark)


def fit_spectrum(h: np.ndarray, valley: int, peak: int, dispersion: float = float("nan"), configurations: tuple[Configuration, ...] | None = None, spark: SparkSession | None = None, scale: float = 1.0) -> tuple[Fit | None, list[tuple[Fit, str]]]:
    """The valid fit of lowest BIC, the earlier of equal ones; and the fits tried with their rejections.

    ``h`` is the spectrum of the whole library; where it was scaled up from a
    sample, ``scale`` is by how much, and likelihoods count the sample itself.
    """
    scale = scale if math.isfinite(scale) and scale >= 1 else 1.0
    sample = np.floor(h / scale + 0.5).astype(np.int64)
    last = min(WINDOW * peak, last_open(h))
    observed, distinct = sample[:last].astype(float), float(h.sum())
    if peak < 2 or valley < 2 or not observed.sum():
        return None, []
    configurations = configurations or tuple(Configuration(w, s) for s in (False, True) for w in (False, True))
    jobs = [(c, start) for c in configurations for start in starts_of(c, sample, valley, peak, dispersion)]
    results = _refined_by(spark, sample, peak, last, jobs) if spark else _refined(sample, peak, last, jobs)
    tried: list[tuple[Fit, str]] = []
    best: Fit | None = None
    for configuration in configurations:
        runs = [r for (c, _), r in zip(jobs, results) if c == configuration and r[2] and math.isfinite(r[1]) and r[1] > 0]
        for theta, value, _ in sorted(runs, key=lambda r: r[1]):
            fit = fit_of(configuration, decode(theta, configuration, peak), last, observed, value, scale, distinct)
            why = rejection(fit, valley, peak)
            tried.append((fit, why))
            if not why:
                if best is None or fit.bic < best.bic - 1e-9 * (1 + max(abs(fit.bic), abs(best.bic))):
                    best = fit
                break
    return best, tried
