"""Scorers and curves on hand-made sets: values that can be worked out on paper, and identities."""

import math

import pytest

from polyvox.operators import curves, fits, lexical
from polyvox.functions import text as T
from polyvox.plans import scorers
from pyspark.sql import functions as F

SETS = "set_id long, k long, prompt string, response string"


def sets(spark, *rows):
    return spark.createDataFrame(list(rows), SETS)


def values(df, order="k", column="bits"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_prequential_by_hand(spark):
    s = sets(spark, (1, 1, "a", "a b"), (1, 2, "a", "b b"))
    # history a; three word types at most: a, b -> types 2, alpha 1: p = (count + 1) / (tokens + 3)
    first = -math.log2(2 / 4) - math.log2(1 / 5)
    second = -math.log2(2 / 6) - math.log2(3 / 7)
    assert values(scorers.prequential(s, ["set_id"], 1.0)) == pytest.approx([first, second])
    alone = -math.log2(1 / 4) - math.log2(2 / 5)
    assert values(scorers.prequential(s, ["set_id"], 1.0, alone=True)) == pytest.approx([first, alone])


def test_repeats_get_cheaper(spark):
    s = sets(spark, *[(1, k, "", "the same words again") for k in range(1, 6)])
    bits = values(scorers.prequential(s, ["set_id"]))
    assert all(a > b for a, b in zip(bits, bits[1:], strict=False))


def test_empty_responses_cost_nothing(spark):
    s = sets(spark, (1, 1, "", ""), (1, 2, "", " \n"), (1, 3, "", "x"))
    assert values(scorers.prequential(s, ["set_id"]))[:2] == [0.0, 0.0]
    assert values(scorers.static(s, ["set_id"]))[:2] == [0.0, 0.0]


def test_uniform(spark):
    s = sets(spark, (1, 1, "", "a b c"), (1, 2, "", ""))
    assert values(scorers.uniform(s, ["set_id"], 100)) == pytest.approx([3 * math.log2(100), 0])


def test_temperature_against_renormalising(spark):
    s = sets(spark, (1, 1, "a a b", "a c"), (1, 2, "a a b", "b c c"))
    rows = {(r.temperature, r.k): r.bits for r in scorers.static(s, ["set_id"], (0.5, 1.0, 2.0), 0.5).collect()}
    for t in (0.5, 1.0, 2.0):
        history, types = ["a", "a", "b"], ["a", "b", "c", None]
        for k, words in ((1, ["a", "c"]), (2, ["b", "c", "c"])):
            weight = {w: (history.count(w) + 0.5) ** (1 / t) for w in types}
            assert rows[t, k] == pytest.approx(sum(-math.log2(weight[w] / sum(weight.values())) for w in words))
            history += words


def test_ensemble_of_one_is_the_scorer(spark):
    s = sets(spark, (1, 1, "p", "a b"), (1, 2, "p", "b c"))
    assert values(scorers.ensemble(s, ["set_id"], (0.5,))) == pytest.approx(values(scorers.static(s, ["set_id"], (1.0,), 0.5)))
    assert values(scorers.ensemble(s, ["set_id"], (0.5, 0.5))) == pytest.approx(values(scorers.ensemble(s, ["set_id"], (0.5,))))


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        scorers.prequential(spark.createDataFrame([(1, 1)], "set_id long, k long"), ["set_id"])


def test_straddling_token_counts_twice(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 3, 1.0), (1, 1, 3, 7, 2.0), (1, 2, 7, 9, 4.0)], "set_id long, t long, c_start long, c_end long, bits double")
    spans = spark.createDataFrame([(1, 1, 0, 5, 5), (1, 2, 5, 9, 4), (1, 3, 9, 9, 0)], "set_id long, k long, s_start long, s_end long, bytes long")
    assert [tuple(r)[1:] for r in scorers.span_overlap(tokens, spans, ["set_id"]).orderBy("k").collect()] == [(1, 0, 2, 3.0), (2, 1, 3, 6.0)]
    assert values(scorers.external(tokens, spans, ["set_id"])) == [3.0, 6.0, 0.0]


def test_mean_of_ratios_is_not_ratio_of_means(spark):
    c = spark.createDataFrame([(1, 0, 1, 100.0, 10), (1, 1, 1, 10.0, 100)], "set_id long, perm int, k long, bits double, bytes long")
    assert curves.mean_of_ratios(c, ["set_id"]).first().per_byte == pytest.approx(5.05)
    assert curves.ratio_of_means(c, ["set_id"]).first().per_byte == pytest.approx(1.0)
    empty = c.withColumn("bytes", F.when(F.col("perm") == 0, 0).otherwise(F.col("bytes")))
    assert curves.mean_of_ratios(empty, ["set_id"]).first().per_byte == pytest.approx(0.1)
    assert curves.mean_of_ratios(c.withColumn("bytes", F.lit(0)), ["set_id"]).first().per_byte is None


def test_scores_of_a_curve(spark):
    curve = spark.createDataFrame([(1, 1, 40.0, 10), (1, 2, 30.0, 10), (1, 3, 10.0, 10)], "set_id long, k long, bits double, bytes long")
    alone = spark.createDataFrame([(1, k, 10.0 * k, 10) for k in (1, 2, 3)], "set_id long, k long, bits double, bytes long")
    r = curves.diversity(curve, alone, ["set_id"]).first()
    assert (r.e, r.e_rate, r.a_1, r.a_n, r.a_n_per_byte, r.n, r.is_monotone) == (50.0, 5.0, 40.0, 10.0, 1.0, 3, True)
    assert r.c == pytest.approx(0.25) and r.sigma == pytest.approx(math.sqrt(2 / 3))
    assert (r.d_c_an, r.d_c_e) == pytest.approx((0.25, 12.5))
    assert r.c_plus * r.c_minus == pytest.approx(r.c**2)
    up = curve.withColumn("bits", -F.col("bits"))
    assert not curves.excess_entropy(up, ["set_id"]).first().is_monotone


def test_permutations_are_permutations(spark):
    s = sets(spark, *[(1, k, "p", f"r{k}") for k in range(1, 8)], (2, 1, "q", "only"))
    rows = scorers.hash_permutations(s, ["set_id"], 4).collect()
    for perm in range(4):
        mine = [r for r in rows if r.set_id == 1 and r.perm == perm]
        assert sorted(r.k for r in mine) == sorted(r.idx for r in mine) == list(range(1, 8))
        assert all(r.response == f"r{r.idx}" for r in mine)


def test_permutation_spread_of_one_is_zero(spark):
    s = sets(spark, (1, 1, "", "a b"), (1, 2, "", "b"))
    alone = scorers.prequential(s, ["set_id"], alone=True)
    one = scorers.prequential(scorers.hash_permutations(s, ["set_id"], 1), ["set_id", "perm"])
    r = curves.permutation_spread(one, alone, ["set_id"]).first()
    assert (r.e_std, r.d_std) == (0.0, 0.0)


def test_distinct_ngrams(spark):
    texts = spark.createDataFrame([(1, "a b c"), (1, "a b."), (2, ""), (2, "x")], "g long, text string")
    got = {(r.g, r.n): (r.uniq, r.total, r.distinct) for r in lexical.distinct_ngrams(texts, ["g"], T.dot_words, (1, 2)).collect()}
    assert got == {(1, 1): (3, 5, 0.6), (1, 2): (2, 3, pytest.approx(2 / 3)), (2, 1): (1, 1, 1.0), (2, 2): (0, 0, 0.0)}
    with pytest.raises(ValueError, match="start at 1"):
        lexical.distinct_ngrams(texts, ["g"], T.dot_words, (0,))


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0]), (3, [-2.0, -2.0]), (4, [1.0, 0.0]), (5, [0.0, 0.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g long, embedding array<double>")
    got = {r.g: r.mean_cosine for r in lexical.mean_pairwise_cosine(df, ["g"]).collect()}
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx(0) and got[3] == pytest.approx(-1) and got[4] is None and got[5] is None
    assert {r.g: r.mean_cosine for r in lexical.mean_pairwise_cosine(df, ["g"], clip=1e-8).collect()}[5] == pytest.approx(0)


def test_fits_find_their_own_curves():
    import numpy as np

    k = np.arange(1.0, 13)
    e = fits.exponential_fit(k, 5 + 40 * np.exp(-0.7 * (k - 1)))
    assert (e["a_inf"], e["alpha"], e["beta"]) == pytest.approx((5, 40, 0.7), rel=1e-4) and e["r2"] == pytest.approx(1)
    s = fits.sigmoid_fit(k, 5 + 40 / (1 + np.exp(0.9 * (k - 4))))
    assert (s["a_inf"], s["alpha"], s["beta"], s["k0"]) == pytest.approx((5, 40, 0.9, 4), rel=1e-3)
    flat = fits.exponential_fit(k, np.full(12, 3.0))
    assert flat["a_inf"] + flat["alpha"] == pytest.approx(3) and math.isnan(flat["r2"])


def test_seen_before_by_counting(spark):
    import itertools

    counts = [3, 1, 2]
    draws = [g for g, c in enumerate(counts) for _ in range(c)]
    df = spark.createDataFrame([(1, c) for c in counts], "g long, c long")
    got = values(fits.seen_before(df, ["g"], "c", 4), "k", "p")
    for k in range(4):
        orders = list(itertools.permutations(range(6), k + 1))
        share = sum(draws[o[-1]] in [draws[i] for i in o[:-1]] for o in orders) / len(orders)
        assert got[k] == pytest.approx(share)


def test_token_bits_add_up(spark):
    s = sets(spark, (1, 1, "p a", "a b a"), (1, 2, "p a", ""), (1, 3, "p a", "b c"), (2, 1, "", "x"))
    whole = {(r.set_id, r.k): r.bits for r in scorers.prequential(s, ["set_id"]).collect()}
    got = {(r.set_id, r.k): r.b for r in scorers.token_bits(s, ["set_id"]).groupBy("set_id", "k").agg(F.sum("bits").alias("b")).collect()}
    assert got == pytest.approx({k: v for k, v in whole.items() if k != (1, 2)})


def test_groups_of_null_keys_are_apart(spark):
    df = spark.createDataFrame([("x", None, "a b c"), (None, "x", "a b"), (None, None, "a"), ("x", "x", "a a"), ("x", None, None)], "g string, h string, text string")
    got = {(r.g, r.h, r.n): (r.uniq, r.total) for r in lexical.distinct_ngrams(df, ["g", "h"], T.ws_words, (1, 2)).collect()}
    assert got == {
        ("x", None, 1): (3, 3), ("x", None, 2): (2, 2), (None, "x", 1): (2, 2), (None, "x", 2): (1, 1), (None, None, 1): (1, 1), (None, None, 2): (0, 0), ("x", "x", 1): (1, 2), ("x", "x", 2): (1, 1),
    }


@pytest.mark.parametrize("at_once", [1, 7, 400_000])
def test_grams_over_batches(spark, monkeypatch, at_once):
    import random

    rng = random.Random(5)
    texts = [(rng.choice("ab"), " ".join(rng.choices("uvwxé", k=rng.randrange(12)))) for _ in range(60)]
    monkeypatch.setattr(lexical, "WORDS_AT_ONCE", at_once)
    got = {(r.g, r.n): (r.uniq, r.total) for r in lexical.distinct_ngrams(spark.createDataFrame(texts, "g string, text string"), ["g"], T.ws_words, (1, 3, 4)).collect()}
    for g in "ab":
        for n in (1, 3, 4):
            grams = [tuple(w[i : i + n]) for w in (t.split() for x, t in texts if x == g) for i in range(len(w) - n + 1)]
            assert got[g, n] == (len(set(grams)), len(grams))
