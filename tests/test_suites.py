"""Suites of claims, tables of metrics against labels and fits with a fall-back, held against plain versions."""

import itertools
import math
import random

import pytest

from polyvox.operators import stats, suites
from polyvox.operators.suites import Rule


def average_ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    top = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True))
    below = math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    return top / below if below else None


def scores(spark, rows):
    return spark.createDataFrame(rows, "unit string, group string, metric string, value double")


def by_name(df):
    return {r["rule"]: r.asDict() for r in df.collect()}


def test_rank_sum_is_exact_for_small_sides(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g, (a, b) in enumerate([(1, 1), (2, 3), (4, 4), (3, 6)]):
        x, y = [rng.random() for _ in range(a)], [rng.random() for _ in range(b)]
        rows += [(g, v, 1) for v in x] + [(g, v, 0) for v in y]
        u = sum(p > q for p in x for q in y)
        every = [sum(p > q for p in c for q in set(x + y) - set(c)) for c in itertools.combinations(x + y, a)]
        want[g] = u, sum(e >= u for e in every) / len(every)
    found = stats.rank_sum_test(spark.createDataFrame(rows, "g int, v double, label int"), ["g"], "v", "label").collect()
    assert {r["g"]: (r["u"], r["p_greater"]) for r in found} == {g: (u, pytest.approx(p)) for g, (u, p) in want.items()}


def test_rank_sum_is_normal_with_ties_or_many(spark):
    rows = [("tied", float(i % 5), i % 2) for i in range(12)] + [("many", float(i), int(i % 3 == 0)) for i in range(60)] + [("one side", 1.0, 1), ("equal", 2.0, 0), ("equal", 2.0, 1)]
    found = {r["g"]: r for r in stats.rank_sum_test(spark.createDataFrame(rows, "g string, v double, label int"), ["g"], "v", "label").collect()}
    for g in ("tied", "many"):
        assert found[g]["p_greater"] == pytest.approx(stats.normal_sf(found[g]["z"]))
    assert found["one side"]["p_greater"] is None and found["equal"]["p_greater"] is None


def test_exact_tail_sums_up_and_reaches_large_sides():
    assert stats.rank_sum_exact_sf(0, 8, 2500) == 1
    ways = [stats.rank_sum_exact_sf(u, 3, 5) for u in range(17)]
    assert ways[0] == 1 and ways[15] == pytest.approx(1 / 56) and ways[16] == 0 and ways == sorted(ways, reverse=True)
    assert stats.rank_sum_exact_sf(10100, 8, 2500) == pytest.approx(stats.normal_sf((10100 - 10000 - 0.5) / math.sqrt(8 * 2500 * 2509 / 12)), abs=1e-3)


def test_suite_judges_each_kind_of_claim(spark):
    rng = random.Random(2)
    rows = []
    for i in range(7):
        rows += [(f"u{i}", "high", "m", 5 + rng.random()), (f"u{i}", "mid", "m", 3 + rng.random()), (f"u{i}", "low", "m", 1 + rng.random())]
    rows += [("u0", "high", "other", -9.0), ("u9", "high", "m", None), ("u9", "low", "m", float("nan"))]
    rules = [
        Rule("u holds", "rank_sum", "m", ("high", "low"), "f"),
        Rule("u fails", "rank_sum", "m", ("low", "high"), "f"),
        Rule("w holds", "signed_rank", "m", ("high", "mid"), "f"),
        Rule("w alone", "signed_rank", "m", ("mid", "low"), "g"),
        Rule("falls", "order", "m", ("high", "mid", "low")),
        Rule("does not fall", "order", "m", ("high", "low", "mid")),
        Rule("order with a hole", "order", "m", ("high", "nobody", "low")),
        Rule("above", "threshold", "m", ("high",), threshold=5),
        Rule("below", "threshold", "m", ("high",), threshold=5, above=False),
        Rule("ratio", "ratio", "m", ("high", "low"), threshold=2),
        Rule("no values", "rank_sum", "m", ("nobody", "low"), "f"),
        Rule("no metric", "threshold", "none", ("high",), threshold=0),
    ]
    found = by_name(suites.suite(scores(spark, rows), rules))
    assert list(sorted(found)) == sorted(r.name for r in rules)
    assert {n for n, r in found.items() if r["passed"]} == {"u holds", "w holds", "w alone", "falls", "above", "ratio"}
    assert found["u holds"]["statistic"] == 49 and found["u holds"]["p"] == pytest.approx(1 / math.comb(14, 7))
    assert found["w alone"]["p"] == found["w alone"]["p_holm"] == pytest.approx(1 / 2**7)
    raw = sorted((found[n]["p"], n) for n in ("u holds", "u fails", "w holds"))
    running, want = 0.0, {}
    for i, (p, n) in enumerate(raw):
        running = max(running, (3 - i) * p)
        want[n] = min(1.0, running)
    assert {n: found[n]["p_holm"] for _, n in raw} == {n: pytest.approx(p) for n, p in want.items()}
    assert found["no values"]["p"] is None and found["no values"]["n_first"] == 0 and found["no values"]["n_last"] == 7
    assert found["no metric"]["n_first"] == 0 and found["no metric"]["mean_first"] is None
    high = [v for _, g, m, v in rows if g == "high" and m == "m" and v is not None]
    assert found["above"]["statistic"] == found["falls"]["mean_first"] == pytest.approx(sum(high) / 7)


def test_suite_takes_a_unit_once_by_its_mean(spark):
    rows = [("a", "x", "m", 1.0), ("a", "x", "m", 5.0), ("a", "y", "m", 2.0), ("b", "x", "m", 9.0), (None, "x", "m", 4.0), (None, "y", "m", 8.0)]
    found = by_name(suites.suite(scores(spark, rows), [Rule("w", "signed_rank", "m", ("x", "y"))]))
    assert (found["w"]["n_first"], found["w"]["n_last"], found["w"]["statistic"], found["w"]["p"]) == (4, 2, 1.0, pytest.approx(0.75))


def test_suite_over_no_rows_and_bad_rules(spark):
    found = by_name(suites.suite(scores(spark, []), [Rule("u", "rank_sum", "m", ("a", "b")), Rule("t", "threshold", "m", ("a",), threshold=0)]))
    assert [found[n]["passed"] for n in "ut"] == [False, False]
    bad = [
        [Rule("x", "rank_sum", "m", ("a",))],
        [Rule("x", "nothing", "m", ("a", "b"))],
        [Rule("x", "threshold", "m", ("a",))],
        [Rule("x", "order", "m", ("a", "a"))],
        [Rule("x", "order", "m", ("a", "b")), Rule("x", "order", "m", ("b", "a"))],
    ]
    for rules in bad:
        with pytest.raises(ValueError):
            suites.suite(scores(spark, []), rules)


def test_falling_curves_make_a_majority_claim(spark):
    shapes = {("a", 1): [5, 4, 3, 1], ("a", 2): [5, 6, 2, 1], ("a", 3): [1, 2, 3, 4], ("b", 1): [1, 2, 3, 4], ("b", 2): [3, 2, 1, 0], ("b", 3): [2, 2, 2, 2]}
    curve = spark.createDataFrame([(g, s, k, float(v)) for (g, s), c in shapes.items() for k, v in enumerate(c, 1)], "group string, unit int, k long, bits double")
    fell = suites.falling_curves(curve, ["group", "unit"], "bits")
    assert {(r["group"], r["unit"]): r["falls"] for r in fell.collect()} == {("a", 1): 1, ("a", 2): 1, ("a", 3): 0, ("b", 1): 0, ("b", 2): 1}
    long = fell.selectExpr("unit", "group", "'falls' AS metric", "falls AS value")
    found = by_name(suites.suite(long, [Rule(g, "threshold", "falls", (g,), threshold=0.5) for g in "ab"]))
    assert found["a"]["passed"] and not found["b"]["passed"]


def test_label_associations(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.randrange(8)), rng.random() if i % 5 else None, rng.randrange(2), float(rng.randrange(4))) for g in ("a", None) for i in range(40)]
    rows += [("few", 1.0, 1.0, 1, 1.0), ("few", 2.0, float("nan"), 0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, flag int, temp double")
    found = {(r["g"], r["metric"], r["label"]): r for r in suites.label_associations(df, ["g"], ["x", "y"], ["flag", "temp"]).collect()}
    assert len(found) == 12
    for (g, metric, label), r in found.items():
        at = {"x": 1, "y": 2, "flag": 3, "temp": 4}
        pairs = [(row[at[metric]], row[at[label]]) for row in rows if row[0] == g and row[at[metric]] is not None and not math.isnan(row[at[metric]])]
        xs, ys = zip(*pairs, strict=True)
        assert r["n"] == len(pairs) and r["binary"] == (set(ys) == {0, 1})
        if len(pairs) < 5:
            assert r["rho"] is None and r["p"] is None
        else:
            rho = pearson(average_ranks(xs), average_ranks(ys))
            t = rho * math.sqrt((len(pairs) - 2) / (1 - rho * rho))
            assert (r["rho"], r["p"]) == (pytest.approx(rho), pytest.approx(2 * stats.t_sf(abs(t), len(pairs) - 2)))
        pos, neg = [x for x, y in pairs if y == 1], [x for x, y in pairs if y == 0]
        if not r["binary"]:
            assert r["auc"] is r["auc_inverse"] is r["oca"] is None
            continue
        if len(pos) < 2 or len(neg) < 2:
            assert r["auc"] is None
        else:
            auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
            assert (r["auc"], r["auc_inverse"]) == (pytest.approx(auc), pytest.approx(1 - auc))
        best = max(sum((x >= cut) == (y == 1) for x, y in pairs) for cut in [*xs, math.inf])
        assert r["oca"] == pytest.approx(best / len(pairs))


def test_label_associations_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double, flag int")
    assert suites.label_associations(df, ["g"], ["x"], ["flag"]).collect() == []


def test_fitted_or_discrete(spark):
    plain = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (None, 40.0), (5, None), (6, float("nan"))], "id int, e double")
    fits = spark.createDataFrame([(1, 11.0), (2, float("nan")), (None, 44.0), (5, 55.0), (9, 99.0)], "id int, e_fit double")
    found = {r["id"]: (r["e"], r["e_exp"], r["e_exp_fitted"]) for r in suites.fitted_or_discrete(plain, fits, ["id"], "e", {"e_exp": "e_fit"}).collect()}
    assert found == {1: (10.0, 11.0, True), 2: (20.0, 20.0, False), 3: (30.0, 30.0, False), None: (40.0, 44.0, True)}
