"""Bootstraps and subsamples: draws against their law, replicates against the same draws made in numpy, and what they estimate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyvox.operators import resample


def draws(rows, rep, seed=0):
    p = resample.PRIME
    a, b, c, d = resample._MULTIPLIERS
    h = (np.asarray(rows, dtype=np.int64) % p * a + seed + (rep + 1) * b) % p
    h = (h ^ h >> 15) * c % p
    return (h ^ h >> 13) * d % p


def times(u):
    limits = np.round(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)]) * resample.PRIME)
    return (u[:, None] >= limits).sum(axis=1)


def test_draws(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 5, 2**40 + 3, -7)], "i long")
    got = {(r.i, r.rep): r.u for r in resample.with_draws(df, "i", "u", 4, 9).collect()}
    assert got == {(i, rep): int(draws([i], rep, 9)[0]) for i in (0, 1, 5, 2**40 + 3, -7) for rep in range(4)}


def test_draws_are_even_and_independent():
    u = np.array([draws(np.arange(4000), rep) for rep in range(50)]) / resample.PRIME
    assert abs(u.mean() - 0.5) < 0.004 and abs(u.var() - 1 / 12) < 0.002
    near = [np.corrcoef(u[i], u[i + 1])[0, 1] for i in range(49)]
    assert max(map(abs, near)) < 0.08 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01
    w = np.array([times(draws(np.arange(4000), rep)) for rep in range(50)])
    share = np.bincount(w.ravel(), minlength=4)[:4] / w.size
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.005)
    assert abs(w.sum(axis=1).var() / 4000 - 1) < 0.5


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x), float(2 * x + 1 + rng.normal())) for g in ("a", None) for i, x in enumerate(rng.normal(5, 2, 150))]
    return rows, spark.createDataFrame([*rows, ("a", 999, None, 1.0), ("b", 1, float("nan"), 1.0)], "g string, i long, x double, y double").repartition(5)


def replicates(rows, g, f, reps):
    i, x, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2, 3))
    return np.array([f(times(draws(i, rep)), x, y) for rep in range(reps)])


def check(row, name, values):
    assert (row[f"{name}_se"], row[f"{name}_low"], row[f"{name}_high"]) == pytest.approx((values.std(ddof=1), *np.percentile(values, [2.5, 97.5])))


def test_bootstrap_mean_ratio_and_slope(points):
    rows, df = points
    mean = {r.g: r for r in resample.bootstrap_mean(df, ["g"], "x", "i", 300).collect()}
    ratio = {r.g: r for r in resample.bootstrap_ratio(df, ["g"], "x", "y", "i", 300).collect()}
    slope = {r.g: r for r in resample.bootstrap_slope(df, ["g"], "x", "y", "i", 300).collect()}
    assert set(mean) == set(ratio) == set(slope) == {"a", None}
    for g in ("a", None):
        x, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (2, 3))
        assert (mean[g].n, mean[g].mean, ratio[g].ratio) == pytest.approx((150, x.mean(), x.mean() / y.mean()))
        check(mean[g], "mean", replicates(rows, g, lambda w, x, y: (w * x).sum() / w.sum(), 300))
        check(ratio[g], "ratio", replicates(rows, g, lambda w, x, y: (w * x).sum() / (w * y).sum(), 300))
        fit = lambda w, x, y: np.cov(x, y, fweights=w)
        check(slope[g], "slope", replicates(rows, g, lambda w, x, y: fit(w, x, y)[0, 1] / fit(w, x, y)[0, 0], 300))
        check(slope[g], "r2", replicates(rows, g, lambda w, x, y: fit(w, x, y)[0, 1] ** 2 / fit(w, x, y)[0, 0] / fit(w, x, y)[1, 1], 300))
        assert slope[g].slope == pytest.approx(np.polyfit(x, y, 1)[0])
        assert mean[g].mean_se == pytest.approx(x.std(ddof=1) / math.sqrt(150), rel=0.15)
    whole = resample.bootstrap_mean(df.where("g = 'a'"), [], "x", "i", 300).first()
    assert (whole.mean, whole.mean_low) == pytest.approx((mean["a"].mean, mean["a"].mean_low))


def test_flat_and_empty_groups(spark):
    df = spark.createDataFrame([("a", i, 3.0, float(i)) for i in range(9)] + [("one", 1, 1.0, 0.0)], "g string, i long, x double, y double")
    got = {r.g: r for r in resample.bootstrap_slope(df, ["g"], "x", "y", "i", 50).collect()}
    assert got["a"].slope is None and got["a"].slope_low is None and got["one"].slope is None
    ratio = {r.g: r for r in resample.bootstrap_ratio(df, ["g"], "x", "y", "i", 50).collect()}
    assert ratio["one"].ratio is None and ratio["one"].ratio_low is None
    assert resample.bootstrap_mean(df.limit(0), ["g"], "x", "i", 50).count() == 0


def test_bootstrap_of_curves_and_fits(spark):
    rng = np.random.default_rng(1)
    curves = {d: [float(5 + 40 * math.exp(-0.7 * (k - 1)) + rng.normal() / 10) for k in range(1, 10 + d % 2)] for d in range(12)}
    rows = [(1, d, k, v) for d, c in curves.items() for k, v in enumerate(c, 1)] + [(2, 50, k, 1.0) for k in range(1, 6)] + [(3, d, k, 1.0) for d in (60, 61) for k in (1, 2)]
    df = spark.createDataFrame(rows, "g long, d long, k long, v double")
    y = np.array([c[:9] for c in curves.values()])
    again = np.array([(w := times(draws(np.arange(12), rep))) @ y / w.sum() for rep in range(40)])
    band = {r.k: r for r in resample.bootstrap_curves(df, ["g"], "d", "v", 40).where("g = 1").collect()}
    assert sorted(band) == list(range(1, 10))
    for k, r in band.items():
        assert r.draws == 12 and r.mean == pytest.approx(y[:, k - 1].mean())
        check(r, "mean", again[:, k - 1])
    fits_of = {r.g: r for r in resample.bootstrap_fit(df, ["g"], "d", "v", 40).collect()}
    r = fits_of[1]
    assert set(fits_of) == {1} and r.draws == 12 and r.alpha_low <= r.alpha <= r.alpha_high and abs(r.beta - 0.7) < 0.05 and r.beta_se < 0.05


def rho(a, b):
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    return np.corrcoef(rank(a), rank(b))[0, 1]


def test_subsampled_points(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, float(x), float(x + rng.normal())) for i, x in enumerate(rng.normal(size=40))] + [("b", i, float(i), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, i long, x double, y double").repartition(3)
    got = {(r.g, r.n, r.rep): r.rho for r in resample.subsampled_points(df, ["g"], "x", "y", "i", (5, 20), 30).collect()}
    assert {k[:2] for k in got} == {("a", 5), ("a", 20), ("b", 5)}
    x, y = np.array([r[2] for r in rows[:40]]), np.array([r[3] for r in rows[:40]])
    for rep in range(30):
        order = np.argsort(draws(np.arange(40), rep), kind="stable")
        for n in (5, 20):
            assert got["a", n, rep] == pytest.approx(rho(x[order[:n]], y[order[:n]]))
        assert got["b", 5, rep] == pytest.approx(1)
    spread = {(r.g, r.n): r for r in resample.rho_range(spark.createDataFrame([(*k, v) for k, v in got.items()], "g string, n int, rep int, rho double"), ["g"]).collect()}
    assert spread["b", 5].std == pytest.approx(0) and spread["a", 20].std < spread["a", 5].std and spread["a", 5].reps == 30


def test_efficiency(spark):
    rng = np.random.default_rng(6)
    truth = {f"i{k}": float(k) for k in range(12)}
    rows, row = [], 0
    for t, noise in ((1.0, 9.0), (2.0, 2.0)):
        for item, mean in truth.items():
            for _ in range(3 if item == "i0" else 30):
                rows.append((t, item, row, mean + float(rng.normal()) * noise))
                row += 1
    df = spark.createDataFrame(rows, "t double, item string, i long, v double").repartition(4)
    ref = spark.createDataFrame(list(truth.items()), "item string, truth double")
    rhos = resample.subsampled_means(df, ["t"], "item", "v", "i", ref, "truth", (3, 10), 60)
    got = {(r.t, r.n, r.rep): r.rho for r in rhos.collect()}
    for t in (1.0, 2.0):
        for rep in (0, 59):
            for n in (3, 10):
                means = []
                for item in truth:
                    mine = [(int(draws([i], rep)[0]), i, v) for tt, it, i, v in rows if tt == t and it == item]
                    means.append(np.mean([v for _, _, v in sorted(mine)[:n]]))
                assert got[t, n, rep] == pytest.approx(rho(np.array(means), np.array(list(truth.values()))))
    for r in resample.efficiency(rhos, "t", 1.0).collect():
        a, b = (np.array([got[t, r.n, rep] for rep in range(60)]) for t in (2.0, 1.0))
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        assert (r.t, r.rho, r.base_rho, r.delta, r.delta_low, r.delta_high, r.u) == pytest.approx((2.0, a.mean(), b.mean(), (a - b).mean(), *np.percentile(a - b, [2.5, 97.5]), u))
        assert r.p < 0.01 and r.delta > 0


def test_what_is_beyond_the_size_stays_in_its_task(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("i"))
    plan = resample.subsample(df, ["g"], "i", 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")
