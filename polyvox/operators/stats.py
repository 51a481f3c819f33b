"""Statistics of groups as aggregates and windows; p-values of small aggregate rows by closed forms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyvox.operators.ranks import GROUP, average_rank, group_of, keys_of, positions, running_sums, with_part


def real_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows in which neither value is null or NaN."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    return df.where(xc.isNotNull() & yc.isNotNull() & ~F.isnan(xc) & ~F.isnan(yc))


def _when_enough(n: int, value: Column) -> Column:
    return F.when(F.col("n") >= n, value)


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r, null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 5) -> DataFrame:
    """keys, n, rho; null with fewer than `least` pairs."""
    keys = list(keys)
    rows = real_pairs(df, x, y).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_rank(average_rank(rows, keys, "_x", "_rx"), keys, "_y", "_ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("_rx", "_ry").alias("rho")).select(*keys, "n", _when_enough(least, F.col("rho")).alias("rho"))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    rows = real_pairs(df, x, y)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(x, y).alias("r")).select(*keys, "n", _when_enough(least, F.col("r")).alias("r"))


def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, tau (tau-b, ties in either taken out), s (concordant less discordant pairs), z and the two-sided p of no order.

    p is exact for up to 33 pairs without ties, else normal, corrected for ties. Discordant pairs are counted without forming any: x and y are cut into
    parts. Pairs within one part of x are counted there, those across parts of x but within one of y in that part, and the
    rest from the numbers of points in each cell of parts. A part that holds one value has no such pair and isn't looked at.
    """
    xs, ys = F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    points = real_pairs(df, x, y).groupBy(group_of(keys), xs, ys).agg(F.count("*").alias("c"))
    parted = with_part(with_part(points, "x", "px"), "y", "py")
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c, "c"))).alias("p")
    inner = parted.where("px % 2 = 0").groupBy(GROUP, "px").agg(listed("x", "y"))
    cells = parted.groupBy(GROUP, "px", "py").agg(F.sum("c").alias("c"))
    lanes = parted.where("py % 2 = 0").groupBy(GROUP, "py", "px", "y").agg(F.sum("c").alias("c")).groupBy(GROUP, "py").agg(listed("px", "y"))
    grid = cells.groupBy(GROUP).agg(listed("px", F.col("py").alias("y")))
    against = [t.select(GROUP, _inversions(F.col("p.y"), F.col("p.c")).alias("d")) for t in (inner, lanes, grid)]
    discordant = against[0].unionByName(against[1]).unionByName(against[2]).groupBy(GROUP).agg(F.sum("d").alias("d"))
    ties = lambda by, c, name: points.groupBy(GROUP, by).agg(F.sum("c").cast("double").alias("c")).groupBy(GROUP).agg(*[F.sum(f(F.col("c"))).alias(f"{name}{i}") for i, f in enumerate(c)])
    pairs, triples, var = (lambda c: c * (c - 1) / 2), (lambda c: c * (c - 1) * (c - 2)), (lambda c: c * (c - 1) * (2 * c + 5))
    own = points.groupBy(GROUP).agg(F.sum("c").alias("n"), F.sum(pairs(F.col("c").cast("double"))).alias("both"))
    all_of = own.join(discordant, GROUP).join(ties("x", (pairs, triples, var), "x"), GROUP).join(ties("y", (pairs, triples, var), "y"), GROUP)
    n = F.col("n").cast("double")
    total = pairs(n)
    s = total - F.col("x0") - F.col("y0") + F.col("both") - 2 * F.col("d")
    tau = F.try_divide(s, F.sqrt(total - F.col("x0")) * F.sqrt(total - F.col("y0")))
    spread = (var(n) - F.col("x2") - F.col("y2")) / 18 + F.try_divide(2 * F.col("x0") * F.col("y0"), n * (n - 1)) + F.coalesce(F.try_divide(F.col("x1") * F.col("y1"), 9 * triples(n)), F.lit(0.0))
    scored = all_of.select(*keys_of(keys), "n", tau.alias("tau"), s.alias("s"), F.try_divide(s, F.sqrt(spread)).alias("z"), ((F.col("x0") == 0) & (F.col("y0") == 0) & (n <= 33) & (n > 1)).alias("_exact"))
    return scored.select(*keys, "n", "tau", "s", "z", F.when(F.col("_exact"), _kendall_exact(F.col("n"), F.col("s"))).otherwise(normal_p(F.col("z"))).alias("p"))


def inversions(y: np.ndarray, c: np.ndarray) -> int:
    """Sum of c_i c_j over pairs i < j with y_i > y_j: for each bit of the ranks of y, from the highest, the pairs that differ there first."""
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    c, found = c.astype(np.int64), 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        before = np.cumsum(np.where(one, c, 0))
        same = rank >> (bit + 1)
        starts = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        earlier = before - np.repeat(np.r_[0, before][starts], np.diff(np.r_[starts, len(rank)]))
        found += int((c[~one] * earlier[~one]).sum())
        order = np.argsort(rank >> bit, kind="stable")  # ranks that agree so far stay in the order of x
        rank, c = rank[order], c[order]
    return found


@F.pandas_udf(T.LongType())
def _inversions(ys: pd.Series, cs: pd.Series) -> pd.Series:
    return pd.Series([inversions(np.asarray(y), np.asarray(c)) for y, c in zip(ys, cs, strict=True)], dtype="int64")


def kendall_exact_p(n: int, s: float) -> float:
    """Chance that n points in random order have as many pairs out of balance as s says, on either side, by counting orders."""
    ways = [1]
    for m in range(2, n + 1):
        running = np.cumsum([*map(int, ways), *[0] * (m - 1)], dtype=object)
        ways = [running[i] - (running[i - m] if i >= m else 0) for i in range(len(running))]
    fewest = round((n * (n - 1) / 2 - abs(s)) / 2)
    return min(1.0, 2 * sum(ways[: fewest + 1]) / math.factorial(n))


@F.pandas_udf(T.DoubleType())
def _kendall_exact(ns: pd.Series, ss: pd.Series) -> pd.Series:
    return pd.Series([kendall_exact_p(int(n), s) if 1 < n <= 33 else None for n, s in zip(ns, ss, strict=True)], dtype="float64")


def _rank_sums(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """The group with n_pos, n_neg, u and ties (sum of t^3 - t) of the ranks of both labels' scores."""
    rows = real_pairs(df, score, label).where(F.col(label).isin(0, 1)).select(group_of(keys), F.col(score).alias("_x"), F.col(label).alias("_l"))
    counts = rows.groupBy(GROUP, "_x").agg(F.count("*").alias("c"), F.sum("_l").alias("p"))
    ranked = running_sums(counts, "_x", ["c"]).withColumn("r", F.col("c_before") + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(GROUP).agg(
        F.sum("p").cast("long").alias("n_pos"), F.sum(F.col("c") - F.col("p")).cast("long").alias("n_neg"), F.sum(F.col("r") * F.col("p")).alias("w"), F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties")
    )
    return sums.withColumn("u", F.col("w") - F.col("n_pos") * (F.col("n_pos") + 1) / 2)


def _rank_sum_z() -> Column:
    pos, neg, n = F.col("n_pos"), F.col("n_neg"), F.col("n_pos") + F.col("n_neg")
    var = pos * neg / 12.0 * (n + 1 - F.try_divide(F.col("ties"), (n * (n - 1)).cast("double")))
    return F.try_divide(F.col("u") - pos * neg / 2 - 0.5, F.sqrt(var))


def _auc() -> Column:
    pos, neg = F.col("n_pos"), F.col("n_neg")
    return F.when((pos >= 2) & (neg >= 2), F.try_divide(F.col("u"), (pos * neg).cast("double")))


def rank_sum(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """keys, n_pos, n_neg, u, auc, z: Mann-Whitney U of label 1 over label 0, with the tie-corrected normal score.

    auc is null with fewer than two of either label.
    """
    sums = _rank_sums(df, list(keys), score, label)
    return sums.select(*keys_of(keys), "n_pos", "n_neg", "u", _auc().alias("auc"), _rank_sum_z().alias("z"))


#: The distribution of U is counted out if the smaller side has up to so many scores, none of them tied, and the pairs of both sides are no more than the second.
RANK_EXACT, RANK_EXACT_PAIRS = 8, 20_000


def rank_sum_test(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """keys, n_pos, n_neg, u, auc, z and p_greater, the chance of a U as large without any difference: exact for small sides without ties, else normal.

    p_greater is null where a label has no score, or all scores are equal.
    """
    sums = _rank_sums(df, list(keys), score, label)
    pos, neg = F.col("n_pos"), F.col("n_neg")
    exact = (F.least(pos, neg) >= 1) & (F.least(pos, neg) <= RANK_EXACT) & (pos * neg <= RANK_EXACT_PAIRS) & (F.col("ties") == 0)
    p = F.when(exact, _rank_sum_exact("u", "n_pos", "n_neg")).when(F.least(pos, neg) >= 1, normal_p(_rank_sum_z(), 1))
    return sums.select(*keys_of(keys), "n_pos", "n_neg", "u", _auc().alias("auc"), _rank_sum_z().alias("z"), p.alias("p_greater"))


@F.pandas_udf(T.DoubleType())
def _rank_sum_exact(us: pd.Series, ps: pd.Series, ns: pd.Series) -> pd.Series:
    """Asked for all rows of a batch, so larger groups, which don't use it, are skipped here."""
    small = lambda p, n: 1 <= min(p, n) <= RANK_EXACT and p * n <= RANK_EXACT_PAIRS
    return pd.Series([rank_sum_exact_sf(u, int(p), int(n)) if small(p, n) else float("nan") for u, p, n in zip(us, ps, ns, strict=True)], dtype="float64")


def roc_points(df: DataFrame, keys: Sequence[str], score: str, label: str, tie: str) -> DataFrame:
    """keys, pos, fpr, tpr after each row in descending score; ties stay apart, in the order of `tie`."""
    keys = list(keys)
    rows = real_pairs(df, score, label)
    one = F.when(F.col(label) == 1, 1).otherwise(0)
    run = positions(rows, keys, score, tie, {"tp": one, "fp": 1 - one}, descending=True).withColumn(GROUP, group_of(keys))
    totals = rows.groupBy(group_of(keys)).agg(F.sum(one).alias("n_pos"), F.sum(1 - one).alias("n_neg"))
    share = lambda c, n: F.try_divide(F.col(c).cast("double"), F.col(n).cast("double"))
    return run.join(totals, GROUP).select(*keys, F.col("pos").cast("int").alias("pos"), share("fp_upto", "n_neg").alias("fpr"), share("tp_upto", "n_pos").alias("tpr"))


def best_threshold_accuracy(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """keys, oca: accuracy of the best single threshold that calls everything at or above it positive, or nothing."""
    keys = list(keys)
    rows = real_pairs(df, score, label)
    counts = rows.groupBy(group_of(keys), F.col(score).alias("_x")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("c"))
    run = running_sums(counts, "_x", ["p", "c"], descending=True)
    ahead = 2 * (F.col("p_before") + F.col("p")) - (F.col("c_before") + F.col("c"))  # hits less misses among those called positive
    best = run.groupBy(GROUP).agg(F.sum("c").alias("n"), F.sum(F.col("c") - F.col("p")).alias("none"), F.greatest(F.max(ahead), F.lit(0)).alias("more"))
    return best.select(*keys_of(keys), "n", ((F.col("none") + F.col("more")) / F.col("n")).alias("oca"))


def median_split_accuracy(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """keys, oca: share of rows on the side of the median that their label says (above it for label 1)."""
    keys = list(keys)
    rows = real_pairs(df, score, label)
    middle = rows.groupBy(*keys).agg(F.percentile(F.col(score).cast("double"), F.lit(0.5)).alias("_m"))
    hit = F.when((F.col(score) > F.col("_m")).cast("int") == F.col(label), 1.0).otherwise(0.0)
    return rows.join(middle, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("oca"))


def _signed_sums(diffs: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The group with n, w_plus and ties (sum of t^3 - t) of the ranks of the non-zero differences."""
    d = F.col(column).cast("double")
    rows = diffs.where(d.isNotNull() & ~F.isnan(d) & (d != 0)).select(group_of(keys), F.abs(d).alias("_a"), (d > 0).cast("int").alias("_s"))
    counts = rows.groupBy(GROUP, "_a").agg(F.count("*").alias("c"), F.sum("_s").alias("p"))
    ranked = running_sums(counts, "_a", ["c"]).withColumn("r", F.col("c_before") + (F.col("c") + 1) / 2)
    return ranked.groupBy(GROUP).agg(F.sum("c").alias("n"), F.sum(F.col("r") * F.col("p")).alias("w_plus"), F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"))


def _signed_z() -> Column:
    n = F.col("n")
    return F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))


def signed_rank(diffs: DataFrame, keys: Sequence[str], column: str, least: int = 5) -> DataFrame:
    """keys, n, w_plus, z: Wilcoxon signed ranks of the non-zero differences, tie-corrected; z null with fewer than `least`."""
    sums = _signed_sums(diffs, list(keys), column)
    return sums.select(*keys_of(keys), "n", "w_plus", _when_enough(least, _signed_z()).alias("z"))


#: Differences up to which the distribution of signed ranks is counted out, as long as none are tied.
SIGNED_EXACT = 50


def signed_rank_test(diffs: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, n, w_plus, z, p_greater, p_less, p of Wilcoxon's signed ranks: differences above 0, below 0, either.

    Exact for up to 50 differences without ties or zeros, else normal, corrected for ties. A group without any non-zero difference gives no row.
    """
    zero = diffs.groupBy(group_of(keys)).agg(F.count_if(F.col(column) == 0).alias("zeros"))
    sums = _signed_sums(diffs, list(keys), column).join(zero, GROUP)
    exact = (F.col("n") <= SIGNED_EXACT) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    n, w, z = F.col("n"), F.col("w_plus"), _signed_z()
    up = F.when(exact, _signed_exact(n, w)).otherwise(normal_p(z, 1))
    down = F.when(exact, _signed_exact(n, n * (n + 1) / 2 - w)).otherwise(normal_p(-z, 1))
    found = sums.select(*keys_of(keys), "n", "w_plus", z.alias("z"), up.alias("p_greater"), down.alias("p_less"))
    return found.withColumn("p", F.least(F.lit(1.0), 2 * F.least("p_greater", "p_less")))


@F.pandas_udf(T.DoubleType())
def _signed_exact(ns: pd.Series, ws: pd.Series) -> pd.Series:
    """Asked for all rows of a batch, so larger groups, which don't use it, are skipped here."""
    return pd.Series([signed_rank_exact_sf(w, int(n)) if n <= SIGNED_EXACT else float("nan") for n, w in zip(ns, ws, strict=True)])


def welch(df: DataFrame, keys: Sequence[str], value: str, label: str) -> DataFrame:
    """keys, n1, n0, diff, se, t, df of the means of label 1 and 0, with unequal variances."""
    one, two = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    agg = df.groupBy(*keys).agg(
        F.count(one).alias("n1"), F.count(two).alias("n0"), F.avg(one).alias("m1"), F.avg(two).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v0")
    )
    a, b = F.try_divide(F.col("v1"), F.col("n1").cast("double")), F.try_divide(F.col("v0"), F.col("n0").cast("double"))
    freedom = F.try_divide(F.pow(a + b, F.lit(2.0)), F.try_divide(a * a, (F.col("n1") - 1).cast("double")) + F.try_divide(b * b, (F.col("n0") - 1).cast("double")))
    diff = F.col("m1") - F.col("m0")
    return agg.select(*keys, "n1", "n0", diff.alias("diff"), F.sqrt(a + b).alias("se"), F.try_divide(diff, F.sqrt(a + b)).alias("t"), freedom.alias("df"))


def one_sample_t(df: DataFrame, keys: Sequence[str], value: str, mean: float = 0.0) -> DataFrame:
    agg = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return agg.select(*keys, "n", F.try_divide(F.col("m") - mean, F.col("s") / F.sqrt("n")).alias("t"))


def cohen_dz(diffs: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Mean over sample deviation of paired differences."""
    return diffs.groupBy(*keys).agg(F.count(column).alias("n"), F.try_divide(F.avg(column), F.stddev_samp(column)).alias("dz"))


def adjacent_cohen_d(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, next_group, d: pooled Cohen's d between each group and the next one in order."""
    agg = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    order = Window.partitionBy().orderBy(group)  # one row per group
    nxt = lambda c: F.lead(c).over(order)
    both = agg.select(group, nxt(group).alias("next_group"), "n", "m", "v", nxt("n").alias("n2"), nxt("m").alias("m2"), nxt("v").alias("v2")).where(F.col("next_group").isNotNull())
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n") + F.col("n2") - 2))
    return both.select(group, "next_group", F.try_divide(F.col("m2") - F.col("m"), pooled).alias("d"))


def bonferroni(p: Column, tests: Column | int) -> Column:
    return F.least(F.lit(1.0), p * tests)


def holm(tests: DataFrame, keys: Sequence[str], p: str, tie: str) -> DataFrame:
    """Adds p_holm: the running maximum of (m - rank) p in ascending p, at most 1."""
    order = Window.partitionBy(*keys).orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy(*keys))
    step = (m - F.row_number().over(order) + 1) * F.col(p)
    stepped = tests.withColumn("_step", step)
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def zscores(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """Adds (value - mean) / sample deviation within each group; a group without variance raises."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    checked = F.when(F.col("_s") == 0, F.raise_error(F.lit("zero variance"))).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))
    return df.join(stats, list(keys)).withColumn(out, checked).drop("_m", "_s")


def minmax(df: DataFrame, keys: Sequence[str], value: str, out: str = "norm") -> DataFrame:
    """Adds the value on the scale from its group's minimum to its maximum; 0 where these are equal."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce(F.try_divide((F.col(value) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    return df.join(stats, list(keys)).withColumn(out, scaled).drop("_lo", "_hi")


def threshold_checks(df: DataFrame, keys: Sequence[str], value: str, threshold: float, above: bool = True) -> DataFrame:
    """keys, mean, passed: whether a group's mean is on the asked side of a threshold."""
    mean = F.avg(value)
    return df.groupBy(*keys).agg(mean.alias("mean"), ((mean > threshold) if above else (mean < threshold)).alias("passed"))


# --- p-values of aggregate rows ---------------------------------------------


def normal_p(z: Column, sides: int = 2) -> Column:
    """Chance of a standard normal value as far out as z, on both sides or above it; null for null or NaN."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else 2 * normal_sf(abs(v)) if sides == 2 else normal_sf(v)).astype("float64")

    return tail(z.cast("double"))


def t_p(t: Column, freedom: Column, sides: int = 2) -> Column:
    """The same of Student's t; null, too, where there is no degree of freedom."""

    def one(v: float, df: float) -> float | None:
        if pd.isna(v) or pd.isna(df) or df <= 0:
            return None
        return 2 * t_sf(abs(v), df) if sides == 2 else t_sf(v, df)

    @F.pandas_udf("double")
    def tail(values: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([one(v, d) for v, d in zip(values, dfs, strict=True)], dtype="float64")

    return tail(t.cast("double"), freedom.cast("double"))


def correlation_t(r: Column, n: Column) -> Column:
    """t of a correlation of n pairs, with n - 2 degrees of freedom; infinite for a perfect one."""
    t = r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))
    return F.when(F.abs(r) >= 1, F.signum(r) * F.lit(math.inf)).otherwise(t)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t, by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    half = 0.5 * _beta_inc(df / 2, 0.5, x)
    return half if t >= 0 else 1 - half


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def signed_rank_exact_sf(w_plus: float, n: int) -> float:
    """P(W+ >= w_plus) without ties, by counting subsets of ranks."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(ways) - 1, rank - 1, -1):
            ways[s] += ways[s - rank]
    return sum(ways[math.ceil(w_plus - 1e-9) :]) / 2**n


def rank_sum_exact_sf(u: float, n_pos: int, n_neg: int) -> float:
    """P(U >= u) without ties, by counting arrangements: the coefficients of the product of (1 - q^(m + i)) / (1 - q^i) for i up to the smaller side."""
    few, m = sorted((n_pos, n_neg))
    ways = [1] + [0] * (few * m)
    for i in range(1, few + 1):
        for s in range(few * m, m + i - 1, -1):
            ways[s] -= ways[s - m - i]
        for s in range(i, few * m + 1):
            ways[s] += ways[s - i]
    return sum(ways[math.ceil(u - 1e-9) :]) / sum(ways)
