"""From curves of bits to diversity scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvox.functions.text import safe_divide
from polyvox.operators import fits


def mean_of_ratios(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k, per_byte: mean over permutations of bits per byte, slots without bytes skipped; null where all are."""
    return curves.groupBy(*keys, "k").agg(F.avg(F.try_divide("bits", F.nullif(F.col("bytes"), F.lit(0)))).alias("per_byte"))


def ratio_of_means(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k, per_byte: mean bits over mean bytes; 0 without bytes."""
    return curves.groupBy(*keys, "k").agg(safe_divide(F.avg("bits"), F.avg("bytes")).alias("per_byte"))


def mean_curves(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k, bits, bytes (rounded half to even), per_byte with 0 for slots without bytes."""
    return curves.groupBy(*keys, "k").agg(
        F.avg("bits").alias("bits"), F.bround(F.avg("bytes"), 0).cast("long").alias("bytes"), F.avg(safe_divide(F.col("bits"), F.col("bytes"))).alias("per_byte")
    )


def excess_entropy(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, e = sum of (a_k - a_n), e_rate the same per byte, a_1, a_n, a_n_per_byte, is_monotone."""
    pb = safe_divide(F.col("bits"), F.col("bytes")) if "per_byte" not in curve.columns else F.col("per_byte")
    row = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "bits", pb.alias("pb")))).alias("c"))
    last = F.element_at("c", -1)
    steps = F.zip_with("c", F.slice("c", 2, F.size("c")), lambda a, b: b.isNull() | (a["bits"] >= b["bits"]))
    return row.select(
        *keys,
        F.size("c").cast("long").alias("n"),
        F.aggregate("c", F.lit(0.0), lambda s, x: s + x["bits"] - last["bits"]).alias("e"),
        F.aggregate("c", F.lit(0.0), lambda s, x: s + x["pb"] - last["pb"]).alias("e_rate"),
        F.element_at("c", 1)["bits"].alias("a_1"),
        last["bits"].alias("a_n"),
        last["pb"].alias("a_n_per_byte"),
        F.forall(steps, lambda x: x).alias("is_monotone"),
    )


def coherence(alone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, c = 2^-mean surprise per byte, sigma (population), mean_byte_length, from unconditional bits and bytes."""
    h = safe_divide(F.col("bits"), F.col("bytes"))
    return alone.groupBy(*keys).agg(F.pow(F.lit(2.0), -F.avg(h)).alias("c"), F.stddev_pop(h).alias("sigma"), F.avg("bytes").alias("mean_byte_length"))


def diversity(curve: DataFrame, alone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All scores of a set; d_c_an is the primary one, d_c_e and d_c_e_rate its alternatives, the rest the band around them."""
    keys = list(keys)
    both = excess_entropy(curve, keys).join(coherence(alone, keys), keys)
    up, down = F.col("c") * F.pow(F.lit(2.0), F.col("sigma")), F.col("c") * F.pow(F.lit(2.0), -F.col("sigma"))
    return both.withColumns(
        {
            "d_c_an": F.col("c") * F.col("a_n_per_byte"),
            "d_c_e": F.col("c") * F.col("e"),
            "d_c_e_rate": F.col("c") * F.col("e_rate"),
            "c_plus": up,
            "c_minus": down,
            "d_plus": up * F.col("e_rate"),
            "d_minus": down * F.col("e_rate"),
        }
    )


def permutation_scores(curves: DataFrame, alone: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """keys, within, perm, n, e, e_rate, c, d = c e, d_rate = c e_rate of each permutation of a set.

    c is that of the set (keys), whatever `within` says: with curves at several temperatures, one coherence for all of them.
    """
    keys, within = list(keys), list(within)
    per = excess_entropy(curves, [*keys, *within, "perm"]).join(coherence(alone, keys).select(*keys, "c"), keys)
    return per.select(*keys, *within, "perm", "n", "e", "e_rate", "c", (F.col("c") * F.col("e")).alias("d"), (F.col("c") * F.col("e_rate")).alias("d_rate"))


def permutation_spread(curves: DataFrame, alone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample deviations across permutations of e, e_rate, c * e and c * e_rate; 0 with fewer than two."""
    spread = [F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"{x}_std") for x in ("e", "e_rate", "d", "d_rate")]
    return permutation_scores(curves, alone, keys).groupBy(*keys).agg(*spread)


def bands(curves: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, k, n, mean, sd (population), sem, of the curves that reach slot k, and the bands of one sd and one sem around the mean.

    Curves may have any lengths; null and NaN values are slots that a curve doesn't have.
    """
    v = F.col(value).cast("double")
    moments = curves.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, "k").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    sem = moments.withColumn("sem", F.col("sd") / F.sqrt("n"))
    return sem.withColumns({f"{b}_{side}": F.col("mean") + sign * F.col(b) for b in ("sd", "sem") for side, sign in (("low", -1), ("high", 1))})


def fitted_floor_means(curve: DataFrame, scores: DataFrame, keys: Sequence[str], by: Sequence[str], value: str = "bits") -> DataFrame:
    """by, sets, a_inf and e_fit of the sigmoid fitted to the mean curve, and mean and standard error over sets of e, c, a_n, sigma, d and of
    e_sig = sum of (a_k - a_inf), d_sig = c e_sig.

    curve: by, keys, k and value; scores: by, keys, e, c, a_n, sigma. One fit for each group of sets, on its mean curve alone; where that
    cannot be made (fewer than four slots) what needs it is null.
    """
    by, keys = list(by), list(keys)
    mean_curve = curve.groupBy(*by, "k").agg(F.avg(value).alias("_mean"))
    fitted = fits.fit_curves(mean_curve, by, "_mean", "sigmoid", 4).select(F.struct(*by).alias("_by"), "a_inf", "e_fit")
    sums = curve.groupBy(*by, *keys).agg(F.sum(value).alias("_sum"), F.count("*").alias("_slots"))
    sets = scores.join(sums, [*by, *keys]).withColumn("_by", F.struct(*by)).join(fitted, "_by", "left")
    e_sig = F.col("_sum") - F.col("_slots") * F.col("a_inf")
    values = {"e": F.col("e"), "c": F.col("c"), "a_n": F.col("a_n"), "sigma": F.col("sigma"), "d": F.col("c") * F.col("e"), "e_sig": e_sig, "d_sig": F.col("c") * e_sig}
    moments = [x for n, v in values.items() for x in (F.avg(v).alias(n), (F.stddev_pop(v) / F.sqrt(F.count("*"))).alias(f"{n}_sem"))]
    out = sets.groupBy("_by", "a_inf", "e_fit").agg(F.count("*").alias("sets"), *moments)
    return out.select("_by.*", "sets", "a_inf", "e_fit", (F.col("e_fit") * F.col("c")).alias("d_fit"), *[x for n in values for x in (n, f"{n}_sem")])


def separation(scores: DataFrame, keys: Sequence[str], label: str, metrics: Sequence[str]) -> DataFrame:
    """keys, metric, high_mean, low_mean, diff, n_high, n_low: of sets labelled 1 and 0, for each metric; groups without either label give no row."""
    long = scores.select(*keys, label, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("_v")) for m in metrics])).alias("_s")).select(*keys, label, "_s.*")
    side = lambda x: F.when(F.col(label) == x, F.col("_v"))
    means = long.groupBy(*keys, "metric").agg(F.avg(side(1)).alias("high_mean"), F.avg(side(0)).alias("low_mean"), F.count(side(1)).alias("n_high"), F.count(side(0)).alias("n_low"))
    return means.where("n_high > 0 AND n_low > 0").withColumn("diff", F.col("high_mean") - F.col("low_mean"))
