import math

import numpy as np
import pytest

from helixframe.functions import numbers as N
from helixframe.plans import mixture as M
from helixframe.plans import options as O
from helixframe.plans import selection as G
from helixframe.plans import spectrum as S


def spectrum(depth: float, genome: int = 200_000, errors: int = 400_000, noise: float = 0.05) -> np.ndarray:
    """A Poisson lobe of single-copy k-mers and a falling error lobe."""
    c = np.arange(1, 8001)
    h = genome * np.exp(N.ln_poisson(c, depth)) + errors * np.exp(N.ln_poisson(c, noise)) / (1 - math.exp(-noise))
    return np.round(h).astype(np.int64)


@pytest.mark.parametrize("depth", [20, 30, 60, 150])
def test_estimate_finds_the_peak(depth):
    found = S.estimate(spectrum(depth))
    assert found.resolved and abs(found.peak - depth) <= max(2, 0.05 * depth)
    assert 2 <= found.min_count <= found.valley < found.peak


def test_unresolved():
    for h in (np.zeros(8000, np.int64), np.round(1e6 / np.arange(1, 8001) ** 2).astype(np.int64)):
        found = S.estimate(h)
        assert not found.resolved and found.min_count == 2
    assert S.peak_source(np.zeros(8000, np.int64), S.estimate(np.zeros(8000, np.int64))) == ("Unknown", None)


def test_building_blocks():
    h = np.zeros(8000, np.int64)
    h[:8] = [100, 50, 10, 20, 60, 80, 40, 5]
    assert S.smoothed(h)[0] == (100 + 50 + 10) // 3 and S.smoothed(h)[3] == (50 + 10 + 20 + 60 + 80) // 5
    assert S.valley_seed(h) == 3 and S.highest(h, 3) == 6 and S.lowest(h, 2, 6) == 3
    assert S.first_local_valley(h) == 3 and S.declines(h, 6)
    weight = h * np.arange(1, 8001)
    assert S.occurrence_median(h) == next(c for c in range(1, 9) if 2 * weight[:c].sum() >= weight.sum())
    assert S.mirrored_area(h, 3, 6) == h[2:9].sum() / h[1:].sum() and S.mirrored_area(h, 3, 5000) is None
    assert S.measured_guard(h, 3, 6) == 3 and S.poisson_guard(20) == max(m for m in range(2, 21) if N.poisson_cdf_below(m, 20) <= 0.01)
    assert S.lobe_dispersion(h, 3, 6) > 0 and math.isnan(S.lobe_dispersion(np.zeros(8000, np.int64), 3, 6))


def test_densities_sum_to_one():
    x = np.arange(0, 3000)
    for ln in (N.ln_poisson(x, 30.0), N.ln_negative_binomial(x, 30.0, 3.0), N.ln_negative_binomial(x, 30.0, 1.0)):
        assert abs(np.exp(ln).sum() - 1) < 1e-9
    b = np.exp(N.ln_beta_binomial(np.arange(0, 41), 40, 2.0, 5.0))
    assert abs(b.sum() - 1) < 1e-9 and np.exp(N.ln_beta_binomial(np.array([41]), 40, 2.0, 5.0))[0] == 0
    assert abs(N.lse(np.log(2.0), np.log(3.0)) - np.log(5.0)) < 1e-12 and N.ln_sub_exp(np.array(1.0), np.array(1.0)) == -np.inf
    assert abs(N.sigmoid(0) - 0.5) < 1e-12 and N.sigmoid(-800) == 0


def test_simplex():
    point, value, converged = M.nelder_mead(lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2, np.zeros(2), 1000)
    assert converged and abs(point[0] - 1) < 0.05 and abs(point[1] + 2) < 0.05 and value < 1e-3


def test_fit_and_choice():
    h = spectrum(30)
    found = S.estimate(h)
    plain = (M.Configuration(False, False),)
    fit, tried = M.fit_spectrum(h, found.valley, found.peak, found.dispersion, plain)
    assert fit and abs(fit.mode - 30) <= 3 and fit.errors[0] > fit.genome[0]
    assert 1 < fit.crossover() <= fit.mode and fit.hole_cutoff() >= 2
    quick = lambda *a: M.fit_spectrum(*a, plain)
    choice = G.choose({0: h, 20: h}, fitter=quick)
    assert choice.floor == 20 and choice.source == "Fitted" and not choice.unresolved
    nothing = np.zeros(8000, np.int64)
    nothing[0] = 5
    loose = G.choose({0: nothing, 20: np.zeros(8000, np.int64)}, fitter=quick)
    assert (loose.floor, loose.min_count, loose.source, loose.peak) == (0, 2, "Fallback", 1)
    assert G.choose({0: h}, fixed_min_count=7, fitter=quick).min_count == 7


@pytest.mark.parametrize("alphabet,want", [([], [0]), ([37], [0]), ([25, 37], [0]), ([2, 37], [0, 37]), ([2, 11, 25, 37], [0, 11, 25]), ([2, 8, 20, 30], [0, 20]), ([11, 25], [0, 25])])
def test_floor_ladder(alphabet, want):
    assert G.floor_ladder(alphabet) == want


@pytest.mark.parametrize("longest,want", [(20, [21]), (50, [21, 31, 39]), (100, [21, 31, 41, 55, 71, 89]), (150, [21, 31, 41, 55, 71, 91, 111, 131, 139]), (90, [21, 31, 41, 55, 71, 79])])
def test_default_ladder(longest, want):
    assert O.default_ladder(longest) == want


def ladder_by_rule(ceiling: int) -> list[int]:
    """Step by step: 21, 31, 41, 55, 71, then every 20; a step past the ceiling becomes the largest odd k below it."""
    ceiling = min(ceiling, 255)
    ks, steps = [21], [31, 41, 55, 71] + [71 + 20 * i for i in range(1, 11)]
    for step in steps:
        if step > ceiling:
            top = max(k for k in range(1, ceiling + 1) if k % 2)
            if top - ks[-1] >= 8 or (top == 255 and ks[-1] < 255):
                ks.append(top)
            break
        ks.append(step)
    return ks


@pytest.mark.parametrize("ceiling", [20, 60, 65, 78, 90, 135, 138, 141, 225, 240, 254, 270, 1000])
def test_default_ladder_by_rule(ceiling):
    assert O.default_ladder(ceiling + 10) == ladder_by_rule(ceiling)


def test_ladder_limits():
    assert O.default_ladder(1000)[-1] == 255
    assert O.settled_ladder([101, 121], 100) == [101] and O.settled_ladder([21, 99, 101], 100) == [21, 99]
    for bad in ([], [20], [21, 21], [31, 21], [1], [257]):
        with pytest.raises(O.InvalidOptions):
            O.check_ladder(bad)


@pytest.mark.parametrize("change", [{"k": 20}, {"ks": (31, 21)}, {"k": 21, "ks": (21,)}, {"min_count": 1}, {"pop_ratio": 0}, {"pop_ratio": 1}, {"peak_ratio": 1.5}, {"dead_end_k_multiple": -1}, {"dead_end_k_multiple": float("inf")}, {"dead_end_ratio": 0}, {"connector_ratio": 1}, {"two_bit": True}])
def test_bad_options(change):
    with pytest.raises(O.InvalidOptions):
        O.AssemblyOptions(**change).validated()


def test_option_arithmetic():
    O.AssemblyOptions(min_count=1, first_sighting_filter=False).validated()
    assert O.short_path_limit(100, 21) == 80 and O.short_path_limit(10, 21) == 0
    assert O.dead_end_bases(100, 0, 21) == 100 and O.dead_end_bases(100, 10, 21) == 210
    assert O.dead_end_bases(100, 2.5, 81) == 203 and O.dead_end_bases(100, 2.5, 31) == 100
    assert O.bulge_kmers(21) == 121 - 20 and O.bulge_kmers(99) == 297 - 98 and O.connector_kmers(21) == 189
    c = O.AssemblyOptions().correction_for("Fitted", 40, 3).coverage
    assert c.ceiling == 10 and c.error_like(9) and c.genomic(10)
    assert O.AssemblyOptions().correction_for("Fallback", 40, 9).coverage.ceiling == 10
    none = O.CoverageReference(None, 2, 0.25)
    assert not none.error_like(0) and none.genomic(0)
    assert str(O.QualityChoice(3, 20)) == "min count 3, minimum quality 20 (5)"


def fit_with(mode: float, weights, observed: float = 1e7, singletons: float = 0.85, rate: float = 2.0, dispersion: float = 6.0, shape: float = 0.0, last: int | None = None) -> M.Fit:
    parts = M.Parts(np.log(np.array(weights)), singletons, rate, shape, mode, dispersion, 1.9)
    last = last or int(6 * mode)
    spread = np.zeros(last)
    spread[0] = observed
    return M.fit_of(M.Configuration(shape > 0, False), parts, last, spread, 1.0, 1.0, observed)


def brute_cutoffs(fit: M.Fit) -> tuple[int | None, int]:
    """Hole cutoff and error floor count by count."""
    p, ln = fit.parts, lambda c, mean: float(np.exp(N.ln_negative_binomial(np.array([c]), mean, fit.dispersion)[0]))
    hole, lost = None, ln(0, p.mean)
    for c in range(1, min(round(p.mean), fit.window)):
        lost += ln(c, p.mean)
        if lost * fit.totals[1] > 1:
            hole = max(c, 2)
            break
    reached = [c for c in range(1, fit.window + 1) if fit.errors[c - 1] >= fit.single[fit.mode - 1]]
    return hole, max([c + 1 for c in reached] + [2])


@pytest.mark.parametrize("mode,weights,shape", [(50, (0.99, 0.0099, 0.0001), 0.0), (100, (0.8, 0.19, 0.01), 0.0), (100, (0.8, 0.19, 0.01), 0.5), (40, (0.001, 0.989, 0.01), 0.0), (30, (0.4, 0.55, 0.05), 0.0)])
def test_cutoffs_of_a_fit(mode, weights, shape):
    fit = fit_with(mode, weights, shape=shape)
    hole, floor = brute_cutoffs(fit)
    assert (fit.hole_cutoff(), fit.error_floor()) == (hole, floor)
    # the hole guard only lowers, and the error floor is a hard minimum
    for cutoff in (2, hole - 1, hole, hole + 4, 50):
        assert fit.guarded(cutoff) == max(min(cutoff, hole), floor)
    cross = fit.crossover()
    assert cross is None or (fit.single[cross - 1] > fit.errors[cross - 1] and (cross == 2 or fit.single[cross - 2] <= fit.errors[cross - 2]))


def test_error_floor_beats_the_hole_guard():
    fit = fit_with(50, (0.99, 0.0099, 0.0001))
    assert 2 < fit.hole_cutoff() < fit.error_floor() == fit.guarded(20)
    shallow = fit_with(3, (0.001, 0.989, 0.01), dispersion=1.5, last=60)
    assert shallow.hole_cutoff() == 2 and shallow.error_floor() == 2 and shallow.guarded(9) == 2


def verdict(floor, peak, fitted=None, tail=0.0, primary=True):
    class Mode:
        mode = fitted

    found = S.Estimate(2, peak, 2, peak is not None, primary) if peak else S.Estimate(None, None, 2, False)
    return G.FloorVerdict(floor, found, Mode() if fitted else None, 3, tail if fitted else None)


def chosen(monkeypatch, **verdicts):
    table = {int(f[1:]): v for f, v in verdicts.items()}
    monkeypatch.setattr(G, "evaluate", lambda h, floor, *a: table[floor])
    h = np.zeros(8000, np.int64)
    h[4] = 9
    return G.choose({f: h for f in table})


def test_selection_rules(monkeypatch):
    pick = lambda **v: chosen(monkeypatch, **{f: verdict(int(f[1:]), *x) if isinstance(x, tuple) else verdict(int(f[1:]), x) for f, x in v.items()}).floor
    assert pick(f0=(40, 40), f20=(30, 30)) == 20
    assert pick(f0=(40, 40, 0.01), f11=(35, 35, 0.01), f20=(30, 30, 0.2)) == 11
    assert pick(f0=(40, 40, 0.2), f20=(30, 30, 0.3)) == 0
    assert pick(f0=(40, 40), f20=30) == 0
    assert pick(f0=25, f11=(None, None), f20=20) == 0
    # step down by the peaks seen, not the fitted modes, and never losing a fit
    assert pick(f0=(9, 20), f20=(9, 8)) == 20 and pick(f0=(10, 8), f20=(9, 12)) == 0 and pick(f0=30, f20=(9, 8)) == 20
    last = chosen(monkeypatch, f0=verdict(0, None), f20=verdict(20, None))
    assert (last.floor, last.min_count, last.peak, last.source) == (0, 2, 5, "Fallback")


def test_fixed_and_recounted():
    h = spectrum(30)
    quick = lambda *a, **o: M.fit_spectrum(*a, (M.Configuration(False, False),), **o)
    assert G.choose({0: h, 20: h}, fixed_min_count=0, fitter=quick).min_count == 0
    prior = G.Choice(11, 4, 28, "Fitted", False)
    assert G.recounted(prior, np.zeros(8000, np.int64), quick) == prior
    again = G.recounted(G.Choice(11, 4, 28, "Fallback", True), h, quick)
    assert again.source == "Fitted" and again.peak == 30 and not again.unresolved
    assert [v.floor for v in G.floor_report({0: h, 20: np.zeros(8000, np.int64), 30: h}, quick)] == [30, 0]


def test_a_sample_is_fitted_at_its_own_size():
    h = spectrum(30)
    plain = (M.Configuration(False, False),)
    whole, _ = M.fit_spectrum(h, 6, 30, 1.0, plain)
    part, _ = M.fit_spectrum((h // 16) * 16, 6, 30, 1.0, plain, scale=16.0)
    assert abs(part.mode - whole.mode) <= 1 and abs(part.totals[1] / whole.totals[1] - 1) < 0.02 and part.bic < whole.bic / 10
