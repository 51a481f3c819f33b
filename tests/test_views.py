"""Decomposition views, bands of ragged curves, fitted floors and separations against numpy."""

import numpy as np
import pytest

from polyvox.operators import curves, fits, tables

CELLS = "g string, s string, u string, v double"


def three_way(x):
    grand = x.mean()
    a, b, c = x.mean((1, 2)) - grand, x.mean((0, 2)) - grand, x.mean((0, 1)) - grand
    ab = x.mean(2) - grand - a[:, None] - b
    ac = x.mean(1) - grand - a[:, None] - c
    bc = x.mean(0) - grand - b[:, None] - c
    rest = x - grand - a[:, None, None] - b[:, None] - c - ab[:, :, None] - ac[:, None, :] - bc
    n, m, k = x.shape
    return [float(v) for v in (m * k * (a**2).sum(), n * k * (b**2).sum(), n * m * (c**2).sum(), k * (ab**2).sum(), m * (ac**2).sum(), n * (bc**2).sum(), (rest**2).sum(), ((x - grand) ** 2).sum())]


EFFECTS = ["ss_grader", "ss_stage", "ss_unit", "ss_grader_x_stage", "ss_grader_x_unit", "ss_stage_x_unit", "ss_residual", "ss_total"]
VIEWS = {"all": ["a", "b", "c"], "pair": ["a", "c"], "none": ["missing"]}


@pytest.fixture(scope="module")
def tensor():
    return 1e6 + np.random.default_rng(8).normal(size=(3, 4, 9)) + np.arange(3)[:, None, None]


def cells_of(x):
    return [("abc"[i], f"s{j}", f"u{k}", float(x[i, j, k])) for i in range(x.shape[0]) for j in range(x.shape[1]) for k in range(x.shape[2])]


def test_views(spark, tensor):
    # b lacks a value of u2, a has a null of u5; other graders, stages and units that are null don't count
    rows = [(g, s, u, None if (g, s, u) == ("a", "s1", "u5") else v) for g, s, u, v in cells_of(tensor) if (g, s, u) != ("b", "s0", "u2")]
    df = spark.createDataFrame([*rows, ("x", "s0", "u0", 5.0), ("a", "other", "u0", 5.0), ("a", "s0", None, 5.0), ("a", "s0", None, 5.0)], CELLS)
    got = {r.view: r for r in tables.decompose_views(df, "g", "s", "u", "v", VIEWS, ["s0", "s1", "s2", "s3"]).collect()}
    assert set(got) == {"all", "pair"}
    for view, graders, units in (("all", [0, 1, 2], [0, 1, 3, 4, 6, 7, 8]), ("pair", [0, 2], [0, 1, 2, 3, 4, 6, 7, 8])):
        r, x = got[view], tensor[graders][:, :, units]
        want = three_way(x)
        assert [r[e] for e in EFFECTS] == pytest.approx(want, rel=1e-6)
        assert (r.n_graders, r.n_units, r.n_dropped) == (len(graders), len(units), 9 - len(units))
        g, s, u, gs, gu, su, rest, total = want
        assert r.unit_frac_of_total == pytest.approx(u / total)
        assert (r.within_grader, r.within_stage, r.within_interaction) == pytest.approx(((g + gu) / (total - u), (s + su) / (total - u), (gs + rest) / (total - u)))
        means = x.mean(axis=2)
        rows_, cols = means.mean(1) - means.mean(), means.mean(0) - means.mean()
        all_of = ((means - means.mean()) ** 2).sum()
        assert (r.cell_grader, r.cell_stage) == pytest.approx((means.shape[1] * (rows_**2).sum() / all_of, means.shape[0] * (cols**2).sum() / all_of))
        assert r.cell_grader + r.cell_stage + r.cell_interaction == pytest.approx(1) and r.within_grader + r.within_stage + r.within_interaction == pytest.approx(1)


def test_a_cell_that_is_there_twice_raises(spark, tensor):
    rows = cells_of(tensor)
    with pytest.raises(Exception, match="a cell is there twice"):
        tables.decompose_views(spark.createDataFrame([*rows, rows[3]], CELLS), "g", "s", "u", "v", VIEWS, ["s0", "s1", "s2", "s3"]).collect()
    assert tables.decompose_views(spark.createDataFrame([], CELLS), "g", "s", "u", "v", VIEWS, ["s0"]).count() == 0


def test_sums_that_do_not_close_raise(spark, tensor):
    df = spark.createDataFrame(cells_of(tensor), CELLS)
    with pytest.raises(Exception, match="don't add up"):
        tables.decompose_views(df, "g", "s", "u", "v", VIEWS, ["s0", "s1", "s2", "s3"], tolerance=-1.0).collect()


def test_bands_of_ragged_curves(spark):
    ragged = {1: [5.0, 3.0, 2.0], 2: [7.0], 3: [6.0, None, 4.0, 1.0], 4: [float("nan"), 2.0]}
    df = spark.createDataFrame([("t", d, k, v) for d, c in ragged.items() for k, v in enumerate(c, 1)], "g string, d long, k long, v double")
    got = {r.k: r for r in curves.bands(df, ["g"], "v").collect()}
    for k, values in {1: [5, 7, 6], 2: [3, 2], 3: [2, 4], 4: [1]}.items():
        mean, sd = np.mean(values), np.std(values)
        sem = sd / len(values) ** 0.5
        r = got[k]
        assert (r.n, r["mean"], r.sd, r.sem, r.sd_low, r.sd_high, r.sem_low, r.sem_high) == pytest.approx((len(values), mean, sd, sem, mean - sd, mean + sd, mean - sem, mean + sem))


def test_fitted_floor(spark):
    rng = np.random.default_rng(3)
    k = np.arange(1.0, 9)
    sets = {d: 4 + 30 / (1 + np.exp(0.8 * (k - 3))) + rng.normal(size=8) / 20 for d in range(6)}
    short = {d: np.array([3.0, 2.0]) for d in (10, 11)}
    rows = [(m, d, i, float(v)) for m, group in ((5, sets), (1, short)) for d, c in group.items() for i, v in enumerate(c, 1)]
    scores = [(m, d, float((c - c[-1]).sum()), 0.5 + d / 100, float(c[-1]), 0.1) for m, group in ((5, sets), (1, short)) for d, c in group.items()]
    out = curves.fitted_floor_means(spark.createDataFrame(rows, "m long, d long, k long, bits double"), spark.createDataFrame(scores, "m long, d long, e double, c double, a_n double, sigma double"), ["d"], ["m"])
    got = {r.m: r for r in out.collect()}
    fit = fits.sigmoid_fit(k, np.mean(list(sets.values()), axis=0))
    r = got[5]
    e_sig = np.array([(c - fit["a_inf"]).sum() for c in sets.values()])
    c = np.array([0.5 + d / 100 for d in sets])
    e = np.array([(x - x[-1]).sum() for x in sets.values()])
    assert (r.sets, r.a_inf, r.e_fit) == pytest.approx((6, fit["a_inf"], fit["e_fit"]))
    assert (r.e, r.e_sem, r.e_sig, r.e_sig_sem, r.d, r.d_sig, r.d_fit) == pytest.approx((e.mean(), e.std() / 6**0.5, e_sig.mean(), e_sig.std() / 6**0.5, (c * e).mean(), (c * e_sig).mean(), fit["e_fit"] * c.mean()))
    assert got[1].a_inf is None and got[1].e_sig is None and got[1].e == pytest.approx(1) and got[1].sets == 2


def test_separation(spark):
    df = spark.createDataFrame([("a", 1, 3.0, 1.0), ("a", 1, 5.0, None), ("a", 0, 1.0, 4.0), ("b", 1, 1.0, 1.0)], "t string, l int, e double, r double")
    got = {(r.t, r.metric): r for r in curves.separation(df, ["t"], "l", ["e", "r"]).collect()}
    assert set(got) == {("a", "e"), ("a", "r")}
    assert (got["a", "e"].high_mean, got["a", "e"].low_mean, got["a", "e"]["diff"], got["a", "e"].n_high) == (4.0, 1.0, 3.0, 2)
    assert (got["a", "r"]["diff"], got["a", "r"].n_high, got["a", "r"].n_low) == (-3.0, 1, 1)
