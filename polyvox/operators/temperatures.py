"""What the scorer's temperature does to the scores: their spread over permutations, and the order of groups by fitted diversity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyvox.operators import fits, stats
from polyvox.session import settled

T = "temperature"


def spreads(scores: DataFrame, unit: Sequence[str], value: str = "d") -> DataFrame:
    """unit, temperature, perms, mean and sd (population) of a score over the permutations of a unit at each temperature; nulls don't count."""
    v = F.col(value).cast("double")
    return scores.groupBy(*unit, T).agg(F.count(v).alias("perms"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def spread_reduction(spread: DataFrame, unit: Sequence[str], by: Sequence[str] = (), reference: float = 1.0, level: float = 0.05) -> DataFrame:
    """by, temperature, units, mean_sd, ref_mean_sd, n, w_plus, z, p, reject for each temperature but the reference.

    Each unit's spread at the reference is paired with its spread at the other temperature; p is that of signed ranks for a larger one at
    the reference. Units without both count nowhere. Where all pairs are equal nothing is tested: n and w_plus are 0, z is null, p is 1.
    A unit's temperatures are few and meet in one window, so no table is joined with itself; the pairs are written once, since ranks read them often.
    """
    by = list(by)
    at_reference = F.max(F.when(F.col(T) == reference, F.col("sd"))).over(Window.partitionBy(*by, *unit))
    pairs = spread.withColumn("_ref", at_reference).where(f"{T} <> {float(reference)!r} AND sd IS NOT NULL AND _ref IS NOT NULL")
    pairs = settled(pairs.select(*by, T, "sd", "_ref", (F.col("_ref") - F.col("sd")).alias("_diff")))
    means = pairs.groupBy(*by, T).agg(F.count("*").alias("units"), F.avg("sd").alias("mean_sd"), F.avg("_ref").alias("ref_mean_sd"))
    tested = stats.signed_rank_test(pairs, [*by, T], "_diff").select(F.struct(*by, T).alias("_g"), "n", "w_plus", "z", "p_greater")
    p = F.coalesce("p_greater", F.lit(1.0))
    joined = means.withColumn("_g", F.struct(*by, T)).join(tested, "_g", "left").withColumns({"p": p, "reject": p < level})
    return joined.select(*by, T, "units", "mean_sd", "ref_mean_sd", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), "z", "p", "reject")


def fitted_diversity(curve: DataFrame, coherence: DataFrame, by: Sequence[str], value: str = "bits", kind: str = "exponential") -> DataFrame:
    """by, temperature, a_inf, e_fit, c, d_fit = mean c of the group times e_fit of its mean curve at each temperature.

    coherence: by, c, a row a set. Groups whose mean curve is too short to be fitted give no row.
    """
    by = list(by)
    mean_curve = curve.groupBy(*by, T, "k").agg(F.avg(F.col(value).cast("double")).alias("_mean")).where("_mean IS NOT NULL")
    fitted = fits.fit_curves(mean_curve, [*by, T], "_mean", kind, 4 if kind == "sigmoid" else 3).withColumn("_g", F.struct(*by))
    means = coherence.groupBy(F.struct(*by).alias("_g")).agg(F.avg("c").alias("c"))
    return fitted.join(means, "_g").select(*by, T, "a_inf", "e_fit", "c", (F.col("c") * F.col("e_fit")).alias("d_fit"))


def order_preservation(values: DataFrame, group: str, by: Sequence[str] = (), value: str = "d_fit", reference: float = 1.0, level: float = 0.05) -> DataFrame:
    """by, temperature, n, rho, p, preserved: rank correlation of the groups' values at each temperature with those at the reference.

    The groups are those with a value at the reference; one without a value at another temperature counts as 0 there. The reference itself
    is held against itself. p is two-sided, of Student's t; preserved: p below `level` and rho above 0. rho is null with fewer than three groups.
    """
    by = list(by)
    values = settled(values.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, group, T, value))
    own = values.groupBy(*by, group).agg(F.max(F.when(F.col(T) == reference, F.col(value))).alias("_ref"), F.map_from_entries(F.collect_list(F.struct(T, value))).alias("_at")).where("_ref IS NOT NULL")
    seen = values.groupBy(F.struct(F.lit(0), *by).alias("_by")).agg(F.collect_set(T).alias("_ts"))
    grid = own.withColumn("_by", F.struct(F.lit(0), *by)).join(seen, "_by").select(*by, group, "_ref", "_at", F.explode("_ts").alias(T))
    pairs = grid.withColumn("_v", F.coalesce(F.try_element_at("_at", F.col(T)), F.lit(0.0)))
    found = stats.spearman(pairs, [*by, T], "_ref", "_v", least=3)
    p = stats.t_p(stats.correlation_t(F.col("rho"), F.col("n")), F.col("n") - 2)
    return found.withColumn("p", p).withColumn("preserved", (F.col("p") < level) & (F.col("rho") > 0))
