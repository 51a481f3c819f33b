"""Statistics against enumeration and textbook values."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from polyvox.operators import length, pairwise, stats, tables

ROWS = "g long, x double, y double"


def one(df):
    return df.collect()[0]


def test_spearman(spark):
    df = spark.createDataFrame([(1, float(i), float(i**3)) for i in range(6)] + [(1, None, 1.0), (1, float("nan"), 2.0)] + [(2, 1.0, 1.0)] * 4, ROWS)
    got = {r.g: r for r in stats.spearman(df, ["g"], "x", "y").collect()}
    assert got[1].rho == pytest.approx(1) and got[1].n == 6 and got[2].rho is None


def test_spearman_with_ties(spark):
    df = spark.createDataFrame(list(zip([1] * 5, [1.0, 2.0, 2.0, 3.0, 4.0], [1.0, 3.0, 2.0, 5.0, 4.0], strict=True)), ROWS)
    assert one(stats.spearman(df, ["g"], "x", "y")).rho == pytest.approx(0.8720815992723809)


def test_kendall(spark):
    xs, ys = [1.0, 2.0, 2.0, 3.0, 4.0, 4.0], [1.0, 3.0, 3.0, 2.0, 5.0, 4.0]
    df = spark.createDataFrame(list(zip([1] * 6, xs, ys, strict=True)), ROWS)
    s = tx = ty = 0
    for i, j in itertools.combinations(range(6), 2):
        a, b = (xs[i] > xs[j]) - (xs[i] < xs[j]), (ys[i] > ys[j]) - (ys[i] < ys[j])
        s, tx, ty = s + a * b, tx + (a == 0), ty + (b == 0)
    assert one(stats.kendall(df, ["g"], "x", "y")).tau == pytest.approx(s / math.sqrt((15 - tx) * (15 - ty)))


def test_auc_and_u(spark):
    pos, neg = [3.0, 5.0, 5.0, 8.0], [1.0, 5.0, 2.0]
    df = spark.createDataFrame([(1, x, 1.0) for x in pos] + [(1, x, 0.0) for x in neg] + [(2, 1.0, 1.0), (2, 2.0, 0.0)], ROWS)
    got = {r.g: r for r in stats.rank_sum(df, ["g"], "x", "y").collect()}
    u = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got[1].u == u and got[1].auc == pytest.approx(u / 12) and got[2].auc is None


def test_threshold_accuracies(spark):
    df = spark.createDataFrame([(1, float(i), float(i > 3)) for i in range(8)] + [(2, 1.0, 0.0), (2, 2.0, 0.0)], ROWS)
    assert {r.g: r.oca for r in stats.best_threshold_accuracy(df, ["g"], "x", "y").collect()} == {1: 1.0, 2: 1.0}
    assert one(stats.median_split_accuracy(df.where("g = 1"), ["g"], "x", "y")).oca == 1.0
    roc = stats.roc_points(df.where("g = 1"), ["g"], "x", "y", "x").orderBy("pos").collect()
    assert (roc[3].fpr, roc[3].tpr, roc[-1].fpr, roc[-1].tpr) == (0.0, 1.0, 1.0, 1.0)


def test_signed_rank(spark):
    d = [1.5, -0.5, 2.0, 3.0, -1.0, 4.0, 0.0]
    r = one(stats.signed_rank(spark.createDataFrame([(1, x, 0.0) for x in d], ROWS), ["g"], "x"))
    assert (r.n, r.w_plus) == (6, 18.0)
    subsets = [sum(s) for k in range(7) for s in itertools.combinations(range(1, 7), k)]
    assert stats.signed_rank_exact_sf(18, 6) == pytest.approx(sum(s >= 18 for s in subsets) / 64)


def test_rank_sum_exact():
    us = []
    for pos in itertools.combinations(range(7), 3):
        us.append(sum(p > n for p in pos for n in set(range(7)) - set(pos)))
    for u in range(13):
        assert stats.rank_sum_exact_sf(u, 3, 4) == pytest.approx(sum(x >= u for x in us) / len(us))


def test_tails():
    assert stats.normal_sf(1.959963985) == pytest.approx(0.025, rel=1e-6)
    assert stats.t_sf(2.228138852, 10) == pytest.approx(0.025, rel=1e-6)
    assert stats.t_sf(-1.0, 1) == pytest.approx(0.75)
    assert stats.t_sf(0.0, 5) == pytest.approx(0.5)


def test_p_values_as_columns(spark):
    df = spark.createDataFrame([(1.959963985, 10.0), (-1.959963985, 0.0), (None, 3.0), (float("nan"), 3.0), (math.inf, 4.0)], "z double, df double")
    got = df.select(stats.normal_p(F.col("z")).alias("two"), stats.normal_p(F.col("z"), 1).alias("above"), stats.t_p(F.col("z"), F.col("df")).alias("t")).collect()
    assert [got[i].two for i in (0, 1, 4)] == pytest.approx([0.05, 0.05, 0], abs=1e-7)
    assert [got[i].above for i in (0, 1)] == pytest.approx([0.025, 0.975], abs=1e-7)
    assert all(v is None for v in (*got[2], *got[3])) and got[1].t is None and got[4].t == 0
    assert got[0].t == pytest.approx(2 * stats.t_sf(1.959963985, 10))


def test_p_value_of_a_correlation(spark):
    # r = 0.632 is the textbook limit of 10 pairs at 5 %.
    df = spark.createDataFrame([(0.6318969, 10), (1.0, 5), (-1.0, 5), (None, 5)], "r double, n long")
    t = stats.correlation_t(F.col("r"), F.col("n"))
    got = df.select(t.alias("t"), stats.t_p(t, F.col("n") - 2).alias("p")).collect()
    assert got[0].p == pytest.approx(0.05, abs=1e-5) and got[1].t == math.inf and got[2].t == -math.inf
    assert (got[1].p, got[2].p, got[3].p) == (0, 0, None)


def test_welch_and_effect_sizes(spark):
    df = spark.createDataFrame([(1, x, 1.0) for x in (4.0, 5.0, 6.0)] + [(1, x, 0.0) for x in (1.0, 2.0, 3.0)], ROWS)
    r = one(stats.welch(df, ["g"], "x", "y"))
    assert r.diff == 3 and r.t == pytest.approx(3 / math.sqrt(2 / 3)) and r.df == pytest.approx(4)
    assert one(stats.cohen_dz(df, ["g"], "x")).dz == pytest.approx(3.5 / math.sqrt(3.5))
    assert one(stats.adjacent_cohen_d(df, "y", "x")).d == pytest.approx(3)


def test_holm(spark):
    df = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03), (1, "d", 0.6)], "g long, name string, p double")
    got = {r.name: r.p_holm for r in stats.holm(df, ["g"], "p", "name").collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.6})


def test_zero_variance_raises(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0)] * 3, ROWS)
    with pytest.raises(Exception, match="zero variance"):
        stats.zscores(df, ["g"], "x").collect()
    assert {r.norm for r in stats.minmax(df, ["g"], "x").collect()} == {0.0}


def test_two_way(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(4)], "r long, c long, v double")
    d = one(tables.two_way(cells, "r", "c", "v"))
    assert d.ss_inter == pytest.approx(0, abs=1e-9) and d.ss_row + d.ss_col == pytest.approx(d.ss_total)
    rows_only = cells.withColumn("v", F.col("r").cast("double"))
    assert one(tables.two_way(rows_only, "r", "c", "v")).frac_row == pytest.approx(1)


def test_three_way_adds_up(spark):
    cells = spark.createDataFrame([(a, b, c, float((a * 7 + b * 3 + c * c + a * b * c) % 11)) for a in range(2) for b in range(3) for c in range(4)], "a long, b long, c long, v double")
    d = tables.three_way(cells, ["a", "b", "c"], "v").collect()
    assert len(d) == 7 and sum(r.fraction for r in d) == pytest.approx(1)


def test_resume_joins(spark):
    work = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "g long, item string")
    done = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (1, "b")], "g long, item string")
    assert [tuple(r) for r in tables.remaining(work, done, ["g", "item"]).collect()] == [(3, "a")]
    assert {r.g for r in tables.incomplete(work, done, ["g"], "item", 2).collect()} == {2, 3}
    assert [tuple(r) for r in tables.unexplained(work.where("g = 3"), done, ["g"]).collect()] == [(3,)]
    assert {tuple(r) for r in tables.symmetric_difference(work, done).collect()} == {(3, "a", "left")}


def test_keys(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "x", 6), (3, "y", 7)], "at long, id string, v long")
    assert {r.at: r.unique_key for r in tables.disambiguate(rows, "id", "at").collect()} == {1: "x__row1", 2: "x__row2", 3: "y"}
    assert {(r.id, r.v) for r in tables.last_wins(rows, ["id"], "at").collect()} == {("x", 6), ("y", 7)}
    table = spark.createDataFrame([("x", 1), ("y", 2)], "key string, score long")
    looked = tables.lookup(rows.withColumn("new", F.lit("none")), table, "new", "id", "key", "score")
    assert {(r.id, r.score) for r in looked.collect()} == {("x", 1), ("y", 2)}


def test_drift_and_bins(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k long, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 1.0)], "k long, v double")
    assert {r.k for r in tables.drift(a, b, ["k"], "v", 0.1).collect()} == {2, 3, 4}
    assert [r.bin for r in tables.binned(a, "v", [1, 2, 3]).orderBy("k").collect()] == [0, 1, None]


def test_lengths(spark):
    rows = spark.createDataFrame([("p", "a", 1, "éé"), ("p", "b", 2, "abcdefgh"), ("q", "a", 3, "x")], "prompt string, stage string, ord long, response string")
    cut = {r.ord: (r.response, r.original_bytes, r.truncation_bytes) for r in length.length_matched(rows, "prompt", 2).collect()}
    assert cut == {1: ("éé", 4, 4), 2: ("abcd", 8, 4)}
    first = {r.prompt: (r.min_bytes, r.stage) for r in length.shortest(rows, "prompt", ["stage"], "ord").collect()}
    assert first == {"p": (4, "a"), "q": (1, "a")}
    with pytest.raises(Exception, match="skip rate"):
        length.skip_rate_guard(rows, F.col("prompt") == "q", 0.1).collect()
    assert length.skip_rate_guard(rows, F.col("prompt") == "q", 0.5).count() == 3


def test_exclusive_quantile(spark):
    import statistics

    data = [3.0, 1.0, 4.0, 1.5, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(1, x, 0.0) for x in data], ROWS)
    deciles = statistics.quantiles(data, n=10)
    assert one(length.exclusive_quantile(df, ["g"], "x", 0.1)).quantile == pytest.approx(max(min(data), deciles[0]))
    assert one(length.exclusive_quantile(df, ["g"], "x", 0.3)).quantile == pytest.approx(deciles[2])


def test_pairwise(spark):
    samples = spark.createDataFrame([(m, k) for m in ("a", "b", "c") for k in range(4 + (m == "a"))], "mode string, k long")
    pairs = pairwise.rotated_pairs(samples, "mode", "k").collect()
    assert len(pairs) == 3 * 3 * 4 and all(r.ctx_k == (r.k + 1) % 4 for r in pairs)
    matrix = spark.createDataFrame([(c, t, float(ord(c) * 2 - ord(t)), 0.5, 0.1) for c in "abc" for t in "abc"], "ctx string, tgt string, mean double, std double, sem double")
    assert {(r.ctx, r.tgt): r.gap for r in pairwise.asymmetry(matrix).collect()} == {("a", "b"): -3.0, ("a", "c"): -6.0, ("b", "c"): -3.0}
    assert [r.ctx for r in pairwise.margins(matrix, "ctx").orderBy("rank").collect()] == ["c", "b", "a"]
    assert {(r.ctx, r.tgt, r.side) for r in pairwise.extremes(matrix, 1).collect()} == {("c", "a", "top"), ("a", "c", "bottom")}


def test_whole_pairs(spark):
    sizes = {"a": 7, "b": 3, "c": 1}
    samples = spark.createDataFrame([(m, k) for m, n in sizes.items() for k in range(n)] + [(None, 0)], "mode string, k long")
    pairs = pairwise.whole_pairs(samples, "mode", "k").collect()
    want = {(c, t, k, (k + 1) % sizes[c]) for c in sizes for t in sizes for k in range(sizes[t])} - {("c", "c", 0, 0)}
    assert len(pairs) == len(want) and {(r.ctx, r.tgt, r.k, r.ctx_k) for r in pairs} == want
