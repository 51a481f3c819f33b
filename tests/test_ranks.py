"""Ranks, running sums and quantiles over groups cut into many parts, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyvox.operators import length, ranks, stats

ROWS = "g string, h string, x double, y double"


@pytest.fixture(params=[250_000, 5])
def per_part(request, monkeypatch):
    monkeypatch.setattr(ranks, "VALUES_PER_PART", request.param)
    return request.param


def rows(n=400, hot=0.3):
    """Groups whose keys may be null, ties, and one value that very many rows have."""
    rng = random.Random(2)
    out = []
    for _ in range(n):
        g, h = rng.choice([("a", "b"), ("a", "b"), ("a", None), (None, "a"), (None, None)])
        out.append((g, h, 7.0 if rng.random() < hot else float(rng.randrange(-60, 60)), float(rng.randrange(40))))
    return [*out, ("z", "z", 1.0, 1.0), ("n", "n", None, 1.0)]


def by_group(data):
    found = {}
    for r in data:
        found.setdefault(r[:2], []).append(r)
    return found


def test_parts_follow_the_values(spark, per_part):
    df = spark.createDataFrame(rows(), ROWS).where("x IS NOT NULL").withColumn(ranks.GROUP, ranks.group_of(["g", "h"]))
    got = ranks.with_part(df.select(ranks.GROUP, "x").distinct(), "x", "part").select("_g.g", "_g.h", "x", "part").collect()
    parts = {}
    for r in got:
        parts.setdefault((r.g, r.h), []).append((r.x, r.part))
    for group in parts.values():
        assert [p for _, p in sorted(group)] == sorted(p for _, p in group)
        for part, values in itertools.groupby(sorted(group, key=lambda v: v[1]), key=lambda v: v[1]):
            values = list(values)
            assert len(values) == 1 or part % 2 == 0
            assert per_part > 100 or len(values) <= 4 * per_part
    assert len({p for g in parts.values() for _, p in g}) >= (1 if per_part > 100 else 10)


def test_average_rank(spark, per_part):
    data = rows()
    got = {}
    for r in ranks.average_rank(spark.createDataFrame(data, ROWS), ["g", "h"], "x", "r").collect():
        got.setdefault((r.g, r.h), []).append((r.x, r.r))
    want = {}
    for key, group in by_group([d for d in data if d[2] is not None]).items():
        xs = [d[2] for d in group]
        want[key] = sorted((x, sum(o < x for o in xs) + (xs.count(x) + 1) / 2) for x in xs)
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("descending", [False, True])
def test_positions(spark, per_part, descending):
    data = [d for d in rows() if d[2] is not None] + [("a", "b", 7.0, 3.0)] * 3
    one = F.when(F.col("y") > 20, 1).otherwise(0)
    got = {}
    for r in ranks.positions(spark.createDataFrame(data, ROWS), ["g", "h"], "x", "y", {"high": one}, descending).collect():
        got.setdefault((r.g, r.h), []).append((r.pos, r.high_upto))
    want = {}
    for key, group in by_group(data).items():
        ordered = sorted(group, key=lambda d: (-d[2] if descending else d[2], d[3]))
        want[key] = list(enumerate(itertools.accumulate(int(d[3] > 20) for d in ordered), 1))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_quantiles(spark, per_part):
    data = rows()
    df = spark.createDataFrame(data, ROWS)
    got = {(r.g, r.h): (r.low, r.mid, r.top) for r in ranks.quantiles(df, ["g", "h"], "x", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    groups = by_group([d for d in data if d[2] is not None])
    assert set(got) == set(groups)
    for key, group in groups.items():
        assert got[key] == pytest.approx(tuple(np.quantile([d[2] for d in group], [0.1, 0.5, 1.0])))
    outer = {(r.g, r.h): r["quantile"] for r in length.exclusive_quantile(df, ["g", "h"], "x", 0.1).collect()}
    for key, group in groups.items():
        assert outer[key] == pytest.approx(np.quantile([d[2] for d in group], 0.1, method="weibull"))


def brute_kendall(points):
    s = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(points, 2):
        s += ((a > c) - (a < c)) * ((b > d) - (b < d))
        tx, ty = tx + (a == c), ty + (b == d)
    n = len(points) * (len(points) - 1) / 2
    return s, s / ((n - tx) * (n - ty)) ** 0.5 if n > tx and n > ty else None


def test_kendall_in_parts(spark, per_part):
    data = rows(300)
    got = {(r.g, r.h): (r.n, r.s, r.tau) for r in stats.kendall(spark.createDataFrame(data, ROWS), ["g", "h"], "x", "y").collect()}
    for key, group in by_group([d for d in data if d[2] is not None]).items():
        s, tau = brute_kendall([d[2:] for d in group])
        n, got_s, got_tau = got.pop(key)
        assert (n, got_s) == (len(group), s)
        assert got_tau == (pytest.approx(tau) if tau is not None else None)
    assert not got


def test_kendall_of_a_million_points(spark, monkeypatch):
    monkeypatch.setattr(ranks, "VALUES_PER_PART", 40_000)
    n, shift = 1_000_000, 123_457
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("x"), ((F.col("id") + shift) % n).alias("y"))
    r = stats.kendall(df, ["g"], "x", "y").first()
    assert r.n == n and r.s == n * (n - 1) / 2 - 2 * shift * (n - shift)


def test_inversions():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 50, 131):
        y, c = rng.integers(0, 30, size), rng.integers(1, 5, size)
        assert stats.inversions(y, c) == sum(int(c[i] * c[j]) for i in range(size) for j in range(i, size) if y[i] > y[j])


def test_kendall_p(spark):
    for n in (2, 4, 6):
        all_s = [brute_kendall(list(enumerate(p)))[0] for p in itertools.permutations(range(n))]
        for s in set(all_s):
            assert stats.kendall_exact_p(n, s) == pytest.approx(min(1, 2 * sum(abs(x) >= abs(s) and x * s > 0 for x in all_s) / len(all_s)) if s else 1)
    df = spark.createDataFrame([("a", "a", float(i), float(i if i != 3 else 9)) for i in range(8)], ROWS)
    r = stats.kendall(df, ["g"], "x", "y").first()
    assert r.p == pytest.approx(stats.kendall_exact_p(8, r.s))
    # ties: the normal score, corrected; figures worked out by hand from the textbook's variance
    tied = [(1, 2), (1, 3), (2, 2), (3, 5), (4, 4), (5, 5)]
    r = stats.kendall(spark.createDataFrame([("a", "a", float(x), float(y)) for x, y in tied], ROWS), ["g"], "x", "y").first()
    v = (6 * 5 * 17 - 1 * 2 * 1 * 9 - 2 * 2 * 1 * 9) / 18 + 2 * 1 * 2 / (6 * 5)
    assert r.z == pytest.approx(brute_kendall(tied)[0] / v**0.5) and r.p == pytest.approx(2 * stats.normal_sf(r.z))
    assert stats.kendall(spark.createDataFrame([], ROWS), ["g"], "x", "y").count() == 0
    assert stats.kendall(spark.createDataFrame([("a", "a", 1.0, 2.0)], ROWS), ["g"], "x", "y").first().tau is None


def test_rank_statistics_in_parts(spark, monkeypatch):
    data = [(d[0], d[1], d[2], float(d[3] > 20)) for d in rows() if d[2] is not None]
    df = spark.createDataFrame(data, ROWS)

    def all_of():
        keys = ["g", "h"]
        tables = [
            stats.rank_sum(df, keys, "x", "y"), stats.spearman(df, keys, "x", "y"), stats.best_threshold_accuracy(df, keys, "x", "y"),
            stats.signed_rank(df, keys, "x"), stats.roc_points(df.withColumn("id", F.monotonically_increasing_id()), keys, "x", "y", "id").drop("g", "h"),
        ]
        return [sorted((tuple(r) for r in t.collect()), key=repr) for t in tables]

    whole = all_of()
    monkeypatch.setattr(ranks, "VALUES_PER_PART", 4)
    for a, b in zip(whole, all_of(), strict=True):
        assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))
    assert len(whole[0]) == len(by_group(data))  # groups whose keys are null are there
