"""Spread and order across temperatures, signed-rank tests and the fits' standard errors, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest

from polyvox.operators import curves, fits, stats, temperatures
from polyvox.plans import scorers


def _ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_signed_rank_test_by_all_signs(spark):
    diffs = {1: [0.5, -1.0, 2.0, 3.5, 4.0, -0.25, 7.0], 2: [1.0, 1.0, -1.0, 2.0], 3: [0.0, 2.0, -1.0, 5.0], 4: [0.0], 5: [3.0]}
    rows = [(g, d) for g, ds in diffs.items() for d in ds] + [(1, None), (1, float("nan"))]
    got = {r.g: r for r in stats.signed_rank_test(spark.createDataFrame(rows, "g long, d double"), ["g"], "d").collect()}
    assert sorted(got) == [1, 2, 3, 5]
    ranks = _ranks([abs(d) for d in diffs[1]])
    w = sum(r for r, d in zip(ranks, diffs[1], strict=True) if d > 0)
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
    assert got[1].w_plus == w and got[1].p_greater == pytest.approx(np.mean([s >= w for s in sums])) and got[1].p_less == pytest.approx(np.mean([s <= w for s in sums]))
    assert got[1].p == pytest.approx(2 * min(got[1].p_greater, got[1].p_less))
    assert got[5].p_greater == 0.5 and got[5].p == 1.0
    for g in (2, 3):  # ties, or a zero: normal
        assert got[g].p_greater == pytest.approx(stats.normal_sf(got[g].z)) and got[g].p_greater + got[g].p_less == pytest.approx(1)


def test_signed_rank_test_of_many_is_normal(spark):
    rng = random.Random(5)
    rows = [(None, rng.gauss(0.3, 1)) for _ in range(200)]
    r = stats.signed_rank_test(spark.createDataFrame(rows, "g long, d double"), ["g"], "d").first()
    assert r.g is None and r.n == 200 and r.p_greater == pytest.approx(stats.normal_sf(r.z)) and r.p == pytest.approx(2 * r.p_greater)


def _spread_rows(rng, units=12):
    rows = []
    for u in range(units):
        for t, width in ((0.5, 1.5), (1.0, 1.0), (3.0, 0.2)):
            if (u, t) != (3, 3.0):
                rows += [(u if u else None, t, p, rng.gauss(5, width)) for p in range(4)]
    return rows


def test_spread_reduction(spark):
    rows = _spread_rows(random.Random(2))
    spread = temperatures.spreads(spark.createDataFrame(rows, "u long, temperature double, perm long, d double"), ["u"])
    plain = {}
    for u, t, _, d in rows:
        plain.setdefault((u, t), []).append(d)
    got = {(r.u, r.temperature): r for r in spread.collect()}
    assert got.keys() == plain.keys()
    assert all(got[k].sd == pytest.approx(np.std(v)) and got[k].mean == pytest.approx(np.mean(v)) and got[k].perms == 4 for k, v in plain.items())
    found = {r.temperature: r for r in temperatures.spread_reduction(spread, ["u"]).collect()}
    assert sorted(found) == [0.5, 3.0] and (found[0.5].units, found[3.0].units) == (12, 11)
    for t, r in found.items():
        pairs = [(np.std(plain[u, 1.0]), np.std(v)) for (u, x), v in plain.items() if x == t]
        diffs = [a - b for a, b in pairs]
        ranks = _ranks([abs(d) for d in diffs])
        w = sum(k for k, d in zip(ranks, diffs, strict=True) if d > 0)
        sums = [sum(itertools.compress(ranks, signs)) for signs in itertools.product((0, 1), repeat=len(ranks))]
        assert r.n == len(diffs) and r.w_plus == w and r.p == pytest.approx(np.mean([s >= w for s in sums]))
        assert r.reject == (r.p < 0.05) and r.mean_sd == pytest.approx(np.mean([b for _, b in pairs])) and r.ref_mean_sd == pytest.approx(np.mean([a for a, _ in pairs]))
    assert found[3.0].reject and not found[0.5].reject


def test_spread_reduction_without_differences(spark):
    rows = [(u, t, p, 1.0) for u in range(3) for t in (1.0, 2.0) for p in range(2)]
    spread = temperatures.spreads(spark.createDataFrame(rows, "u long, temperature double, perm long, d double"), ["u"])
    r = temperatures.spread_reduction(spread, ["u"]).first()
    assert (r.units, r.n, r.w_plus, r.z, r.p, r.reject) == (3, 0, 0.0, None, 1.0, False)
    assert temperatures.spread_reduction(spread.where("temperature = 1"), ["u"]).count() == 0
    assert temperatures.spread_reduction(spread.limit(0), ["u"]).count() == 0


def test_order_preservation(spark):
    values = {0.5: [3.0, 1.0, 2.0, 5.0, 4.0], 1.0: [1.0, 2.0, 3.0, 4.0, 6.0], 2.0: [10.0, 20.0, 30.0, None, 60.0]}
    rows = [(t, m, v) for t, vs in values.items() for m, v in enumerate(vs) if v is not None] + [(2.0, 99, 5.0), (1.0, 7, float("nan"))]
    found = {r.temperature: r for r in temperatures.order_preservation(spark.createDataFrame(rows, "temperature double, m long, d_fit double"), "m").collect()}
    for t, vs in values.items():
        rho = np.corrcoef(_ranks(values[1.0]), _ranks([v or 0.0 for v in vs]))[0, 1]
        assert found[t].n == 5 and found[t].rho == pytest.approx(rho)
        p = 2 * stats.t_sf(abs(rho) * math.sqrt(3 / (1 - rho * rho)), 3) if abs(rho) < 1 - 1e-9 else 0.0
        assert found[t].p == pytest.approx(p, abs=1e-6) and found[t].preserved == (found[t].p < 0.05)


def test_fitted_diversity(spark):
    k = np.arange(1, 9)
    rng = np.random.default_rng(3)
    sets = [(m, t, s, 5 + 30 * m / t * np.exp(-0.4 * (k - 1)) + rng.normal(0, 0.1, len(k))) for m in (1, 2) for t in (1.0, 2.0) for s in range(3)]
    rows = [(m, t, int(a), float(b)) for m, t, _, y in sets for a, b in zip(k, y, strict=True)] + [(3, 1.0, 1, 4.0)]
    c = spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 0.5), (3, 0.5)], "m long, c double")
    got = {(r.m, r.temperature): r for r in temperatures.fitted_diversity(spark.createDataFrame(rows, "m long, temperature double, k long, bits double"), c, ["m"]).collect()}
    assert sorted(got) == [(1, 1.0), (1, 2.0), (2, 1.0), (2, 2.0)]
    for (m, t), r in got.items():
        fit = fits.exponential_fit(k.astype(float), np.mean([y for a, b, _, y in sets if (a, b) == (m, t)], axis=0))
        assert r.d_fit == pytest.approx({1: 0.3, 2: 0.5}[m] * fit["e_fit"]) and r.e_fit == pytest.approx(30 * m / t / 0.4, rel=0.05)


def test_permutation_scores_have_one_coherence(spark):
    sets = spark.createDataFrame([(s, k, "a b", f"word{s} {'x ' * k} y{k * (s or 7)}") for s in (None, 2) for k in (1, 2, 3)], "s long, k long, prompt string, response string")
    alone = scorers.prequential(sets, ["s"], alone=True)
    hot = scorers.static(scorers.hash_permutations(sets, ["s"], 2), ["s", "perm"], (1.0, 2.0))
    rows = curves.permutation_scores(hot, alone, ["s"], ["temperature"]).where("s = 2").collect()
    c = curves.coherence(alone, ["s"]).where("s = 2").first().c
    assert len(rows) == 4 and {r.c for r in rows} == {c}
    bits = {}
    for r in hot.where("s = 2").orderBy("k").collect():
        bits.setdefault((r.temperature, r.perm), []).append(r.bits)
    for r in rows:
        y = bits[r.temperature, r.perm]
        assert r.d == pytest.approx(c * sum(b - y[-1] for b in y))


def test_scorers_keep_sets_whose_key_is_null(spark):
    rows = [(key, k, "a", text) for key in (None, "x") for k, text in ((1, "a b c"), (2, "b b d"))]
    sets = spark.createDataFrame(rows, "s string, k long, prompt string, response string")
    for scored in (scorers.prequential(sets, ["s"]), scorers.prequential(sets, ["s"], alone=True), scorers.static(sets, ["s"], (0.5, 2.0)), scorers.ensemble(sets, ["s"], (0.1, 1.0)), scorers.token_bits(sets, ["s"])):
        found = {}
        for r in scored.collect():
            found.setdefault(r.s, []).append(tuple(sorted((n, v) for n, v in r.asDict().items() if n != "s")))
        assert sorted(found[None]) == sorted(found["x"]) and all(dict(x)["bits"] > 0 for x in found[None])


@pytest.mark.parametrize("temperature", [0.0, -1.0])
def test_temperatures_must_be_positive(spark, temperature):
    sets = spark.createDataFrame([(1, 1, "", "a")], "s long, k long, prompt string, response string")
    with pytest.raises(ValueError, match="above 0"):
        scorers.static(sets, ["s"], (1.0, temperature))


def _jacobian(shape, values, step=1e-5):
    columns = []
    for j in range(len(values)):
        up, down = list(values), list(values)
        up[j] += step
        down[j] -= step
        columns.append((shape(up) - shape(down)) / (2 * step))
    return np.column_stack(columns)


EXPONENTIAL = lambda k: lambda v: v[0] + v[1] * np.exp(-v[2] * (k - 1))
SIGMOID = lambda k: lambda v: v[0] + v[1] / (1 + np.exp(v[2] * (k - v[3])))


@pytest.mark.parametrize(
    ("fit", "shape", "names", "true"),
    [(fits.exponential_fit, EXPONENTIAL, ("a_inf", "alpha", "beta"), (6.0, 40.0, 0.5)), (fits.sigmoid_fit, SIGMOID, ("a_inf", "alpha", "beta", "k0"), (6.0, 40.0, 0.9, 4.3))],
)
def test_standard_errors_by_finite_differences(fit, shape, names, true):
    k = np.arange(1.0, 21)
    rng = np.random.default_rng(11)
    found = fit(k, shape(k)(true) + rng.normal(0, 0.5, len(k)))
    y = shape(k)(true) + np.random.default_rng(11).normal(0, 0.5, len(k))
    values = [found[n] for n in names]
    residual = y - shape(k)(values)
    jacobian = _jacobian(shape(k), values)
    errors = np.sqrt(np.diag(np.linalg.inv(jacobian.T @ jacobian)) * (residual @ residual) / (len(k) - len(names)))
    assert [found[f"{n}_se"] for n in names] == pytest.approx(list(errors), rel=1e-3)
    assert np.abs(jacobian.T @ residual).max() < 1e-3  # the best fit is flat
    assert all(abs(found[n] - t) < 5 * found[f"{n}_se"] for n, t in zip(names, true, strict=True))
    assert residual @ residual <= ((y - shape(k)(true)) ** 2).sum()


def test_sigmoid_is_no_worse_than_a_dense_grid():
    rng = np.random.default_rng(4)
    for n in (4, 7, 15):
        k = np.arange(1.0, n + 1)
        y = np.abs(rng.normal(10, 1, n)) + 20 / (1 + np.exp(1.3 * (k - n / 3)))
        sse = fits.sigmoid_fit(k, y)["rmse"] ** 2 * n
        for k0 in np.linspace(-10, 3 * n, 80):
            for beta in np.exp(np.linspace(math.log(0.01), math.log(50), 80)):
                assert sse <= fits._nonneg_line(1 / (1 + np.exp(np.clip(beta * (k - k0), -500, 500))), y)[2] * (1 + 1e-3) + 1e-6


def test_no_standard_error_at_a_bound_or_without_spare_points(spark):
    k = np.arange(1.0, 9)
    rising = fits.exponential_fit(k, k)  # alpha is 0 there
    assert rising["alpha"] == 0 and math.isnan(rising["alpha_se"]) and math.isnan(rising["beta_se"])
    assert all(math.isnan(v) for n, v in fits.exponential_fit(k[:3], np.array([9.0, 4.0, 2.0])).items() if n.endswith("_se"))
    no_floor = fits.exponential_fit(k, 20 * np.exp(-0.3 * (k - 1)) - 0.5 + 0.01 * (-1) ** k)
    assert no_floor["a_inf"] == 0 and math.isnan(no_floor["a_inf_se"]) and no_floor["beta_se"] > 0
    rows = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(k, k, strict=True)], "g long, k long, v double")
    r = fits.fit_curves(rows, ["g"], "v").first()
    assert r.alpha_se is None and r.rmse > 0
