"""Bootstraps and subsamples in which no group is ever a row: replicates are sums, or the first rows by a hash.

Every row draws for itself, by a hash of its number and the replicate's: how often a Poisson bootstrap takes it, or its place in a
subsample. So results depend on the rows and the seed, not on partitions, and what was lost is drawn again alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvox.operators import fits, ranks, stats

#: Draws are whole numbers below this prime (2^31 - 1), of two rounds of multiplying and mixing; fixed multipliers.
PRIME = 2_147_483_647
_MULTIPLIERS = (1_664_525, 69_069, 1_103_515_245, 1_812_433_253)


def with_draws(rows: DataFrame, row: str, out: str, reps: int, seed: int = 0) -> DataFrame:
    """Each row once for every replicate (rep, from 0), with what it draws there: a number from 0 to PRIME - 1.

    Steps are columns of their own: what the next one reads twice is then worked out once.
    """
    a, b, c, d = _MULTIPLIERS
    numbered = rows.withColumn("_number", F.pmod(F.col(row).cast("long"), F.lit(PRIME)) * a + seed).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    first = numbered.withColumn("_h", (F.col("_number") + (F.col("rep").cast("long") + 1) * b) % PRIME)
    second = first.withColumn("_h", F.col("_h").bitwiseXOR(F.shiftright("_h", 15)) * c % PRIME)
    return second.withColumn(out, F.col("_h").bitwiseXOR(F.shiftright("_h", 13)) * d % PRIME).drop("_number", "_h")


def poisson(number: Column) -> Column:
    """How often a Poisson bootstrap takes a row with this draw: a Poisson number of mean 1, from 0 to 10."""
    chance, total, limits = math.exp(-1), 0.0, []
    for k in range(10):
        total += chance
        limits.append(round(total * PRIME))
        chance /= k + 1
    return reduce(lambda n, limit: n + F.when(number >= limit, 1).otherwise(0), limits, F.lit(0)).cast("long")


def weighted_sums(rows: DataFrame, keys: Sequence[str], row: str, sums: dict[str, Column], reps: int, seed: int = 0) -> DataFrame:
    """keys, rep, `weight` and the weighted sum of each column of sums, for each replicate of a Poisson bootstrap; one scan, summed within tasks first.

    `row` numbers the rows: rows that share a number are drawn together. A replicate that takes no row of a group is not there for it.
    """
    taken = with_draws(rows.withColumns({f"_of{name}": value for name, value in sums.items()}), row, "_u", reps, seed).withColumn("_w", poisson(F.col("_u")))
    summed = taken.groupBy(*keys, "rep").agg(F.sum("_w").alias("weight"), *[F.sum(F.col("_w") * F.col(f"_of{name}")).alias(name) for name in sums])
    return summed.where("weight > 0")


def _interval(replicates: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, and of each name its deviation over replicates and their 2.5th and 97.5th percentile: as many values as replicates at most."""
    at = lambda n, q: F.percentile(n, F.lit(q))
    columns = [x for n in names for x in (F.stddev_samp(n).alias(f"{n}_se"), at(n, 0.025).alias(f"{n}_low"), at(n, 0.975).alias(f"{n}_high"))]
    return replicates.groupBy(*keys).agg(*columns) if keys else replicates.agg(*columns)


def _beside(whole: DataFrame, spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both tables' columns, by keys of which any may be null."""
    left, right = whole.withColumn("_k", ranks.group_of(keys)), spread.withColumn("_k", ranks.group_of(keys)).drop(*keys)
    return left.join(right, "_k", "left").drop("_k")


def bootstrap_mean(rows: DataFrame, keys: Sequence[str], value: str, row: str, reps: int = 5_000, seed: int = 0) -> DataFrame:
    """keys, n, mean, and its standard error and 95 % interval over replicates."""
    x = F.col(value).cast("double")
    real = rows.where(x.isNotNull() & ~F.isnan(x))
    again = weighted_sums(real, keys, row, {"_x": x}, reps, seed).select(*keys, (F.col("_x") / F.col("weight")).alias("mean"))
    whole = real.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"))
    return _beside(whole, _interval(again, keys, ["mean"]), keys)


def bootstrap_ratio(pairs: DataFrame, keys: Sequence[str], num: str, den: str, row: str, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """keys, n, ratio of means, and its error and interval; pairs are drawn together, replicates whose denominator is 0 left out."""
    real = stats.real_pairs(pairs, num, den)
    x, y = F.col(num).cast("double"), F.col(den).cast("double")
    again = weighted_sums(real, keys, row, {"_x": x, "_y": y}, reps, seed).select(*keys, F.try_divide("_x", "_y").alias("ratio"))
    whole = real.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(x), F.sum(y)).alias("ratio"))
    return _beside(whole, _interval(again, keys, ["ratio"]), keys)


def bootstrap_slope(points: DataFrame, keys: Sequence[str], x: str, y: str, row: str, reps: int = 1_000, seed: int = 0) -> DataFrame:
    """keys, n, slope, intercept and r2 of y on x, and errors and intervals of slope and r2; null where x doesn't vary.

    Sums are of distances from the means of all points, one row that goes to every task, so that values far from 0 lose no digits.
    """
    real = stats.real_pairs(points, x, y).withColumn("_k", ranks.group_of(keys))
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    whole = real.groupBy("_k").agg(F.count("*").alias("n"), F.regr_slope(yc, xc).alias("slope"), F.regr_intercept(yc, xc).alias("intercept"), F.regr_r2(yc, xc).alias("r2"))
    near = real.join(F.broadcast(real.agg(F.avg(xc).alias("_mx"), F.avg(yc).alias("_my"))))
    dx, dy = xc - F.col("_mx"), yc - F.col("_my")
    s = weighted_sums(near, ["_k"], row, {"_x": dx, "_y": dy, "_xx": dx * dx, "_xy": dx * dy, "_yy": dy * dy}, reps, seed)
    w = F.col("weight")
    sxx, sxy, syy = (F.col(f"_{a}{b}") - F.col(f"_{a}") * F.col(f"_{b}") / w for a, b in ("xx", "xy", "yy"))
    varies = sxx > 1e-12 * F.col("_xx")
    again = s.select("_k", F.when(varies, sxy / sxx).alias("slope"), F.when(varies & (syy > 1e-12 * F.col("_yy")), sxy * sxy / (sxx * syy)).alias("r2"))
    out = whole.join(_interval(again, ["_k"], ["slope", "r2"]), "_k", "left")
    return out.select(*[F.col("_k").getField(k).alias(k) for k in keys], "n", "slope", "intercept", "r2", *[f"{n}_{e}" for n in ("slope", "r2") for e in ("se", "low", "high")])


def _mean_curves(curves: DataFrame, keys: Sequence[str], draw_id: str, value: str, reps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """keys, draws, k, mean of all draws; and keys, rep, k, mean of each replicate: slots that every draw of the group has."""
    sized = curves.groupBy(*keys, draw_id).agg(F.max("k").alias("_last"))
    shortest = sized.groupBy(*keys).agg(F.count("*").alias("draws"), F.min("_last").alias("_slots")).withColumn("_k", ranks.group_of(keys))
    cut = curves.withColumn("_k", ranks.group_of(keys)).join(shortest.drop(*keys), "_k").where(F.col("k") <= F.col("_slots"))
    v = F.col(value).cast("double")
    whole = cut.groupBy(*keys, "draws", "k").agg(F.avg(v).alias("mean"))
    again = weighted_sums(cut, [*keys, "k"], draw_id, {"_v": v}, reps, seed).select(*keys, "rep", "k", (F.col("_v") / F.col("weight")).alias("mean"))
    return whole, again


def bootstrap_curves(curves: DataFrame, keys: Sequence[str], draw_id: str, value: str, reps: int = 1_000, seed: int = 0) -> DataFrame:
    """keys, draws, k, mean curve with its standard error and 95 % band; a draw (a whole number) is taken with all its slots."""
    whole, again = _mean_curves(curves, keys, draw_id, value, reps, seed)
    return _beside(whole, _interval(again, [*keys, "k"], ["mean"]), [*keys, "k"])


def bootstrap_fit(curves: DataFrame, keys: Sequence[str], draw_id: str, value: str, reps: int = 1_000, seed: int = 0) -> DataFrame:
    """keys, draws, and a_inf, alpha, beta, e_fit of the mean curve, each with its error and 95 % interval over replicates.

    Each replicate's mean curve is fitted by itself, as a row. Groups with fewer than two draws or three slots give no row.
    """
    names = ["a_inf", "alpha", "beta", "e_fit"]
    whole, again = _mean_curves(curves, keys, draw_id, value, reps, seed)
    fitted = fits.fit_curves(whole.where("draws > 1"), [*keys, "draws"], "mean").select(*keys, "draws", *names)
    spread = _interval(fits.fit_curves(again, [*keys, "rep"], "mean"), keys, names)
    return _beside(fitted, spread, keys).select(*keys, "draws", *[f"{n}{e}" for n in names for e in ("", "_se", "_low", "_high")])


# --- subsamples -----------------------------------------------------------


def subsample(rows: DataFrame, keys: Sequence[str], row: str, most: int, reps: int, seed: int = 0) -> DataFrame:
    """The first `most` rows of each group and replicate (rep) by their draws, with their place (from 1): without replacement, and smaller samples lie in larger ones.

    Rows beyond `most` are dropped in each task before they are shuffled.
    """
    drawn = with_draws(rows, row, "_d", reps, seed)
    order = Window.partitionBy(*keys, "rep").orderBy("_d", row)
    return drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_d")


def _rho(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, points, rho to 12 digits, so that equal ones tie; for groups of few rows, ranked by windows."""
    rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
    ranked = pairs.select(*keys, rank(x).alias("_rx"), rank(y).alias("_ry"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("points"), F.round(stats.safe_corr("_rx", "_ry"), 12).alias("rho"))


def subsampled_points(points: DataFrame, keys: Sequence[str], x: str, y: str, row: str, sizes: Sequence[int], reps: int = 200, seed: int = 0) -> DataFrame:
    """keys, n, rep, rho: rank correlation within n points of each group; no row where a group has fewer."""
    real = stats.real_pairs(points, x, y)
    chosen = subsample(real, keys, row, max(sizes), reps, seed).withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("place") <= F.col("n"))
    return _rho(chosen, [*keys, "n", "rep"], x, y).where(F.col("points") == F.col("n")).drop("points")


def subsampled_means(values: DataFrame, keys: Sequence[str], item: str, value: str, row: str, reference: DataFrame, ref: str, sizes: Sequence[int], reps: int = 200, seed: int = 0) -> DataFrame:
    """keys, n, rep, rho: rank correlation, over items, of a reference (item, ref) with means of n values of each item, or of all that it has.

    Only the chosen values of an item meet, and only items of one replicate are ranked together.
    """
    x = F.col(value).cast("double")
    real = values.where(x.isNotNull() & ~F.isnan(x)).select(*keys, item, row, x.alias("_x"))
    chosen = subsample(real, [*keys, item], row, max(sizes), reps, seed)
    means = chosen.groupBy(*keys, item, "rep").agg(*[F.avg(F.when(F.col("place") <= n, F.col("_x"))).alias(f"_{n}") for n in sizes])
    long = means.select(*keys, item, "rep", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("_mean")) for n in sizes])).alias("_s")).select(*keys, item, "rep", "_s.*")
    both = long.join(reference.select(item, F.col(ref).cast("double").alias("_ref")), item)
    return _rho(both, [*keys, "n", "rep"], "_mean", "_ref").drop("points")


def rho_range(rhos: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, reps, rho (mean over replicates) with its deviation and 95 % range; replicates without a rho are left out."""
    at = lambda q: F.percentile("rho", F.lit(q))
    return rhos.groupBy(*keys, "n").agg(F.count("rho").alias("reps"), F.avg("rho").alias("rho"), F.stddev_pop("rho").alias("std"), at(0.025).alias("low"), at(0.975).alias("high"))


def efficiency(rhos: DataFrame, key: str, baseline: object) -> DataFrame:
    """key, n: mean rho and the baseline's, the mean of their differences by replicate with a 95 % interval, and the rank-sum test that rho is greater (u, z, p)."""
    base = rhos.where(F.col(key) == F.lit(baseline)).select("n", "rep", F.col("rho").alias("_base"))
    others = rhos.where(F.col(key) != F.lit(baseline)).select(key, "n", "rep", "rho")
    delta = F.col("rho") - F.col("_base")
    at = lambda q: F.percentile(delta, F.lit(q))
    paired = others.join(base, ["n", "rep"]).groupBy(key, "n").agg(
        F.avg("rho").alias("rho"), F.avg("_base").alias("base_rho"), F.avg(delta).alias("delta"), at(0.025).alias("delta_low"), at(0.975).alias("delta_high")
    )
    names = others.select(key, "n").distinct()
    both = others.select(key, "n", "rho", F.lit(1).alias("own")).unionByName(base.join(names, "n").select(key, "n", F.col("_base").alias("rho"), F.lit(0).alias("own")))
    tests = stats.rank_sum(both, [key, "n"], "rho", "own").select(key, "n", "u", "z", stats.normal_p(F.col("z"), sides=1).alias("p"))
    return paired.join(tests, [key, "n"])
