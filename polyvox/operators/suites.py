"""Suites of claims about groups of scores, and tables of every metric against every label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvox.operators import stats
from polyvox.operators.ranks import GROUP, group_of, keys_of, running_sums
from polyvox.session import settled

#: Claims are configuration: they are sent to all tasks, so their number is checked.
MOST_RULES = 10_000

TESTS = ("rank_sum", "signed_rank", "order", "threshold", "ratio")


@dataclass(frozen=True)
class Rule:
    """A claim about one metric.

    rank_sum: the first group's values are above the second's. signed_rank: the same of units that both groups have, by their mean values.
    order: the groups' means fall strictly as listed. threshold: the group's mean is above (or below) the threshold. ratio: the first mean
    over the last is above (or below) the threshold. Claims of one family are corrected together.
    """

    name: str
    test: str
    metric: str
    groups: tuple[str, ...]
    family: str = "all"
    threshold: float | None = None
    above: bool = True


def _checked(rules: Sequence[Rule]) -> None:
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules share a name")
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    for r in rules:
        fewest, most = {"threshold": (1, 1), "order": (2, 100)}.get(r.test, (2, 2))
        if r.test not in TESTS or not fewest <= len(r.groups) <= most or len(set(r.groups)) < len(r.groups):
            raise ValueError(f"rule {r.name!r}: test {r.test!r} of {len(r.groups)} groups")
        if r.test in ("threshold", "ratio") and r.threshold is None:
            raise ValueError(f"rule {r.name!r} has no threshold")


def suite(scores: DataFrame, rules: Sequence[Rule], alpha: float = 0.05) -> DataFrame:
    """One row a rule: rule, family, test, metric, n_first, n_last, mean_first, mean_last, statistic, p, p_holm, passed.

    scores has unit, group, metric and value, a row or more for each; null and NaN values are left out. All rules are planned together: rows
    meet their rules once and are written to the shared folder, each kind of test is one aggregation over all its rules. statistic is U, W+, the ratio of means or, for a threshold,
    the mean; null for an order. p is one-sided, p_holm is Holm's within the family. A test passes if p_holm < alpha, other claims if
    they hold. A rule whose groups have no values, or no p, does not pass and isn't counted in its family.
    """
    _checked(rules)
    spark = scores.sparkSession
    places = [(r.name, r.test, r.metric, g, i) for r in rules for i, g in enumerate(r.groups)]
    claimed = spark.createDataFrame(places, "rule string, test string, metric string, group string, place int")
    rows = stats.real_pairs(scores, "value", "value").join(F.broadcast(claimed), ["metric", "group"]).select("rule", "test", "place", "unit", F.col("value").cast("double").alias("value"))
    rows = settled(rows)

    of_group = rows.groupBy("rule", "place").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    listed = F.array_sort(F.collect_list(F.struct("place", "n", "mean"))).alias("g")
    falls = F.forall(F.sequence(F.lit(1), F.greatest(F.size("g") - 1, F.lit(1))), lambda i: F.coalesce(F.get("g", i - 1)["mean"] > F.get("g", i)["mean"], F.lit(False)))
    at = lambda i, field: F.get(F.filter("g", lambda x: x["place"] == i), F.lit(0))[field]
    first, last = F.lit(0), F.col("last")

    ranked = stats.rank_sum_test(rows.where("test = 'rank_sum'").withColumn("label", 1 - F.col("place")), ["rule"], "value", "label")
    side = lambda i: F.avg(F.when(F.col("place") == i, F.col("value")))
    paired = rows.where("test = 'signed_rank'").groupBy("rule", "unit").agg((side(0) - side(1)).alias("diff")).where("diff IS NOT NULL")
    signed = stats.signed_rank_test(paired, ["rule"], "diff")
    tested = ranked.select("rule", F.col("u").alias("s"), F.col("p_greater").alias("p")).unionByName(signed.select("rule", F.col("w_plus").alias("s"), F.col("p_greater").alias("p")))

    about = spark.createDataFrame(
        [(r.name, r.family, r.test, r.metric, len(r.groups) - 1, None if r.threshold is None else float(r.threshold), r.above) for r in rules],
        "rule string, family string, test string, metric string, last int, threshold double, above boolean",
    )
    found = about.join(of_group.groupBy("rule").agg(listed), "rule", "left").join(tested, "rule", "left")
    ratio = F.try_divide(at(first, "mean"), at(last, "mean"))
    reached = F.when(F.col("test") == "threshold", at(first, "mean")).when(F.col("test") == "ratio", ratio)
    rows_out = found.select(
        "rule", "family", "test", "metric", F.coalesce(at(first, "n"), F.lit(0)).alias("n_first"), F.coalesce(at(last, "n"), F.lit(0)).alias("n_last"),
        at(first, "mean").alias("mean_first"), at(last, "mean").alias("mean_last"), F.coalesce("s", reached).alias("statistic"), "p",
        F.when(F.col("test") == "order", (F.size("g") == F.col("last") + 1) & falls).otherwise(F.when(F.col("above"), reached > F.col("threshold")).otherwise(reached < F.col("threshold"))).alias("holds"),
    )
    # A family's rows are at most the rules, so a window over one is small.
    kept = rows_out.withColumn("with_p", F.col("p").isNotNull())
    corrected = stats.holm(kept, ["family", "with_p"], "p", "rule")
    passed = F.when(F.col("test").isin("rank_sum", "signed_rank"), F.col("p_holm") < alpha).otherwise(F.col("holds"))
    return corrected.select(*rows_out.columns[:-1], F.when(F.col("with_p"), F.col("p_holm")).alias("p_holm"), F.coalesce(F.when(F.col("with_p") | ~F.col("test").isin("rank_sum", "signed_rank"), passed), F.lit(False)).alias("passed"))


def falling_curves(curves: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, tau, falls: Kendall's tau of each curve (k, value) with its slots, and 1.0 where it is below 0, else 0.0; curves without any tau are left out.

    The mean of `falls` above one half is the claim that most curves of a group fall: a threshold rule on that metric.
    """
    taus = stats.kendall(curves, list(keys), "k", value).where("tau IS NOT NULL")
    return taus.select(*keys, "tau", (F.col("tau") < 0).cast("double").alias("falls"))


def label_associations(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], labels: Sequence[str], least: int = 5) -> DataFrame:
    """keys, metric, label, n, rho, p, binary, auc, auc_inverse, oca: every metric against every label within each group of keys.

    rho is Spearman's, null with fewer than `least` pairs, p two-sided by t. binary says that the labels of the group are 0 and 1, both and no
    others; only then are auc (null with fewer than two of either), 1 - auc and oca, the accuracy of the best threshold, given. Pairs with
    a null or NaN are left out, pair by pair; a group without any pair gives no row. Equal pairs are counted first and the counts written to the shared folder; all statistics come
    from them, by one ranking of metrics and one of labels.
    """
    by = [*keys, "metric", "label"]
    named = lambda names, field: F.array(*[F.struct(F.lit(c).alias(field), F.col(c).cast("double").alias(f"{field}_value")) for c in names])
    long = rows.select(*keys, F.explode(named(metrics, "metric")).alias("_m"), named(labels, "label").alias("_l")).select(*keys, "_m.*", F.explode("_l").alias("_l")).select(*keys, "metric", "metric_value", "_l.*")
    pairs = stats.real_pairs(long, "metric_value", "label_value").groupBy(group_of(by), F.col("metric_value").alias("x"), F.col("label_value").alias("y")).agg(F.count("*").alias("c"))
    pairs = settled(pairs)
    rank = F.col("c_before") + (F.col("c") + 1) / 2
    xs = running_sums(pairs.groupBy(GROUP, "x").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("p")), "x", ["c", "p"]).select(GROUP, "x", "p", "c_before", "p_before", rank.alias("rx"))
    ys = running_sums(pairs.groupBy(GROUP, "y").agg(F.sum("c").alias("c")), "y", ["c"]).select(GROUP, "y", rank.alias("ry"))
    # Hits less misses among those at or above x are these, less the like sum over all.
    one = xs.groupBy(GROUP).agg(F.sum("p").alias("pos"), F.sum(F.col("rx") * F.col("p")).alias("w"), F.max(F.col("c_before") - 2 * F.col("p_before")).alias("ahead"))
    v, c = F.col("y"), F.col("c")
    product = lambda a, b: F.sum(c * F.col(a) * F.col(b))
    moments = pairs.join(xs.select(GROUP, "x", "rx"), [GROUP, "x"]).join(ys, [GROUP, "y"]).groupBy(GROUP).agg(
        F.sum("c").alias("n"), product("rx", "ry").alias("xy"), product("rx", "rx").alias("xx"), product("ry", "ry").alias("yy"),
        ((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))).alias("varies"), (F.bool_and(v.isin(0.0, 1.0)) & (F.min(v) == 0) & (F.max(v) == 1)).alias("binary"),
    )
    n, pos = F.col("n"), F.col("pos")
    centre = n * F.pow((n + 1) / 2, F.lit(2.0))
    rho = F.when(F.col("varies") & (n >= least), (F.col("xy") - centre) / F.sqrt(F.col("xx") - centre) / F.sqrt(F.col("yy") - centre))
    both = moments.join(one, GROUP).withColumn("rho", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), rho)))
    both = both.withColumn("rho", F.when(rho.isNotNull(), F.col("rho")))
    neg = n - pos
    auc = F.when(F.col("binary") & (pos >= 2) & (neg >= 2), (F.col("w") - pos * (pos + 1) / 2) / (pos * neg))
    oca = F.when(F.col("binary"), (neg + F.greatest(2 * pos - n + F.col("ahead"), F.lit(0))) / n)
    p = stats.t_p(stats.correlation_t(F.col("rho"), n), n - 2)
    return both.select(*keys_of(by), "n", "rho", p.alias("p"), "binary", auc.alias("auc"), (1 - auc).alias("auc_inverse"), oca.alias("oca"))


def fitted_or_discrete(discrete: DataFrame, fitted: DataFrame, keys: Sequence[str], value: str, names: dict[str, str]) -> DataFrame:
    """keys, `value` and under each new name of `names` the fitted column it points to, or the discrete value where that is null or NaN or there is no fit.

    `<name>_fitted` says which it is. Rows without a discrete value are left out, as nothing is there to fall back to.
    """
    fits = fitted.select(group_of(keys), *[F.col(c).alias(f"_{n}") for n, c in names.items()])
    base = discrete.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(group_of(keys), F.col(value).cast("double").alias(value))
    good = {n: F.col(f"_{n}").isNotNull() & ~F.isnan(F.col(f"_{n}")) for n in names}
    chosen = [c for n, ok in good.items() for c in (F.when(ok, F.col(f"_{n}")).otherwise(F.col(value)).alias(n), ok.alias(f"{n}_fitted"))]
    return base.join(fits, GROUP, "left").select(*keys_of(keys), value, *chosen)
