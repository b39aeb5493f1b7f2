"""Logarithmic mathematics and densities for the spectrum models, over numpy arrays."""

from __future__ import annotations

import functools
import math
from functools import lru_cache

import numpy as np


def lse(*terms: np.ndarray) -> np.ndarray:
    """log(sum(exp(terms))), elementwise; all -inf gives -inf."""
    return functools.reduce(np.logaddexp, terms)


def ln_sum(terms: np.ndarray) -> np.ndarray:
    """log(sum(exp)) over the last axis; all -inf gives -inf."""
    return np.logaddexp.reduce(terms, axis=-1)


def ln_softmax(logits: np.ndarray) -> np.ndarray:
    return logits - ln_sum(logits)


def ln_sub_exp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) - exp(b)); -inf where b is not less than a."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b < a, a + np.log1p(-np.exp(np.minimum(b - a, 0))), -np.inf)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


@lru_cache(maxsize=64)
def _ln_factorials(n: int) -> np.ndarray:
    out = np.zeros(n + 1)
    np.cumsum(np.log(np.arange(1, n + 1)), out=out[1:])
    return out


def ln_factorial(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64)
    return _ln_factorials(1 << int(max(x.max(initial=1), 1)).bit_length())[x]


def ln_rising(a: float, x: np.ndarray) -> np.ndarray:
    """log of a (a+1) ... (a+x-1), the ratio of two gamma functions, for whole numbers x."""
    x = np.asarray(x, np.int64)
    run = np.concatenate(([0.0], np.cumsum(np.log(a + np.arange(int(x.max(initial=0)))))))
    return run[x]


def ln_poisson(x: np.ndarray, mean: float) -> np.ndarray:
    return np.asarray(x) * math.log(mean) - mean - ln_factorial(x)


def ln_negative_binomial(x: np.ndarray, mean: float, dispersion: float) -> np.ndarray:
    """By mean and dispersion (variance over mean); dispersion 1 is the Poisson distribution."""
    if dispersion <= 1 + 1e-9:
        return ln_poisson(x, mean)
    size = mean / (dispersion - 1)
    return ln_rising(size, x) - ln_factorial(x) - size * math.log(dispersion) + np.asarray(x) * math.log((dispersion - 1) / dispersion)


def ln_beta_binomial(x: np.ndarray, trials: int, alpha: float, beta: float) -> np.ndarray:
    x = np.asarray(x, np.int64)
    inside = (x >= 0) & (x <= trials)
    y = np.where(inside, x, 0)
    ln_choose = ln_factorial(np.array([trials])) - ln_factorial(y) - ln_factorial(trials - y)
    out = ln_choose + ln_rising(alpha, y) + ln_rising(beta, trials - y) - ln_rising(alpha + beta, np.array([trials]))
    return np.where(inside, out, -np.inf)


def ln_beta_binomials(last: int, trials: int, alpha: float, beta: float) -> np.ndarray:
    """`ln_beta_binomial` at the counts 0 to ``last``, from the ratios of neighbouring ones; however many trials, only these are computed."""
    lg = math.lgamma
    x = np.arange(min(last, trials), dtype=float)
    first = lg(trials + beta) + lg(alpha + beta) - lg(trials + alpha + beta) - lg(beta)
    steps = np.log(trials - x) + np.log(x + alpha) - np.log(x + 1) - np.log(trials - x - 1 + beta)
    out = np.full(last + 1, -np.inf)
    out[: len(x) + 1] = first + np.concatenate(([0.0], np.cumsum(steps)))
    return out


def negative_binomial_mode(mean: float, dispersion: float) -> int:
    """The count of highest mass: the density of a negative binomial peaks dispersion - 1 below its mean."""
    return max(0, math.floor(mean - (dispersion - 1)))


def poisson_cdf_below(limit: int, mean: float) -> float:
    """P(X < limit)."""
    return float(np.exp(ln_poisson(np.arange(limit), mean)).sum()) if limit > 0 else 0.0
