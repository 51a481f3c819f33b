"""Joins, set operations and checks over keyed tables: resume, reconcile, pair up, decompose, compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of work whose key isn't done yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def incomplete(work: DataFrame, done: DataFrame, group: Sequence[str], item: str, expected: int) -> DataFrame:
    """Rows of work whose group doesn't have all of its expected items done."""
    full = done.groupBy(*group).agg(F.count_distinct(item).alias("n")).where(F.col("n") >= expected)
    return work.join(full.select(*group), list(group), "left_anti")


def unexplained(missing: DataFrame, skipped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing keys that no skip record explains."""
    return missing.select(*keys).distinct().join(skipped.select(*keys).distinct(), list(keys), "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")


def lookup(rows: DataFrame, table: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """Adds `value` of the table by the first key, or by the second where the first has none."""
    one = table.select(F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    two = table.select(F.col(key).alias("_k2"), F.col(value).alias("_v2"))
    joined = rows.join(one, F.col(first) == F.col("_k1"), "left").join(two, F.col(second) == F.col("_k2"), "left")
    return joined.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def disambiguate(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds unique_key: the key itself if it occurs once, else with its row number."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.join(counts, key).withColumn("unique_key", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("__row"), rn.cast("string")))).drop("_n")


def conflicting(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one distinct label."""
    return rows.groupBy(key).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).where("labels > 1")


def paired(rows: DataFrame, stage: str, key: str, value: str, a: str, b: str) -> DataFrame:
    """key, a, b, diff of the keys that both stages have."""
    side = lambda s, name: rows.where(F.col(stage) == s).select(key, F.col(value).alias(name))
    return side(a, "a").join(side(b, "b"), key).withColumn("diff", F.col("a") - F.col("b"))


def complete_keys(rows: DataFrame, stage: str, key: str, stages: int) -> DataFrame:
    """Keys that all stages have."""
    return rows.groupBy(key).agg(F.count_distinct(stage).alias("stages")).where(F.col("stages") == stages).select(key)


def drift(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Keys of one side only, or whose values differ by more than the tolerance."""
    left, right = a.select(*keys, F.col(value).alias("left_value")), b.select(*keys, F.col(value).alias("right_value"))
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return left.join(right, list(keys), "full").where(gap.isNull() | (gap > tolerance))


def binned(rows: DataFrame, value: str, edges: Sequence[float], out: str = "bin") -> DataFrame:
    """Adds the number (from 0) of the half-open bin [edge, next edge), or null outside."""
    bins: Column = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        bins = F.when((F.col(value) >= lo) & (F.col(value) < hi), i).otherwise(bins)
    return rows.withColumn(out, bins)


def unpivot_metrics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, metric, score: one row per key and metric, nulls kept."""
    typed = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(list(keys), list(metrics), "metric", "score")


def two_way(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """One row: sums of squares of rows, columns and interaction of a balanced table, and their fractions."""
    marginal = lambda *by: F.avg(value).over(Window.partitionBy(*by))
    x = cells.select(F.col(value).alias("_v"), marginal(row).alias("_r"), marginal(col).alias("_c"))
    x = x.join(F.broadcast(cells.agg(F.avg(value).alias("_g"))))
    v, r, c, g = (F.col(name) for name in ("_v", "_r", "_c", "_g"))
    square = lambda d: F.sum(F.pow(d, F.lit(2.0)))
    sums = x.agg(square(r - g).alias("ss_row"), square(c - g).alias("ss_col"), square(v - r - c + g).alias("ss_inter"), square(v - g).alias("ss_total"))
    return sums.select("*", *[F.try_divide(F.col(f"ss_{k}"), F.col("ss_total")).alias(f"frac_{k}") for k in ("row", "col", "inter")])


def three_way(cells: DataFrame, factors: Sequence[str], value: str) -> DataFrame:
    """effect, ss, fraction for the seven effects of a balanced three-way table, by grouping sets."""
    names = list(factors)
    subsets = [[f for i, f in enumerate(names) if mask >> i & 1] for mask in range(8)]
    means = {tuple(s): cells.groupBy(*s).agg(F.avg(value).alias("m_" + "_".join(s))) if s else cells.agg(F.avg(value).alias("m_")) for s in subsets if len(s) < 3}
    x = cells.select(*names, F.col(value).alias("m_" + "_".join(names)))
    for s, m in means.items():
        x = x.join(F.broadcast(m), list(s)) if s else x.join(F.broadcast(m))

    def effect(s: list[str]) -> Column:
        total = F.lit(0.0)
        for t in subsets:
            if {*t} <= {*s}:
                total = total + (-1) ** (len(s) - len(t)) * F.col("m_" + "_".join(t))
        return F.sum(F.pow(total, F.lit(2.0)))

    agg = x.agg(*[effect(s).alias("_".join(s)) for s in subsets if s], F.sum(F.pow(F.col("m_" + "_".join(names)) - F.col("m_"), F.lit(2.0))).alias("_total"))
    effects = ["_".join(s) for s in subsets if s]
    return agg.unpivot(["_total"], effects, "effect", "ss").select("effect", "ss", F.try_divide("ss", "_total").alias("fraction"))


def decompose_views(
    cells: DataFrame, grader: str, stage: str, unit: str, value: str, views: Mapping[str, Sequence[str]], stages: Sequence[str], tolerance: float = 1e-9
) -> DataFrame:
    """One row per view, a named set of graders: two- and three-way decompositions of value over the units that the view has whole.

    cells has a value for each grader, stage and unit. A view's units are those with a value of each of its graders in each of stages; n_dropped counts
    the others. Gives view, n_graders, n_units, n_dropped, the sums of squares of the seven effects (residual: all three factors) and
    their total, unit_frac_of_total, the shares within units (grader, stage and interaction, each with its part across units) and the shares of the table of
    cell means. Raises where a cell is there twice or the effects don't add up to the total. A view without a whole unit gives no row.
    Each row is copied to the views that have its grader once, and all sums come from one pass over grouping sets.
    """
    levels = sorted({g for graders in views.values() for g in graders})
    member = F.create_map(*[x for g in levels for x in (F.lit(g), F.array(*[F.lit(v) for v, graders in views.items() if g in graders]))])
    sizes = F.create_map(*[x for v, graders in views.items() for x in (F.lit(v), F.lit(len(set(graders))))])
    g, s, u = F.col(grader).alias("_g"), F.col(stage).alias("_s"), F.col(unit).alias("_u")
    rows = cells.where(F.col(grader).isin(levels) & F.col(stage).isin(list(stages)) & F.col(unit).isNotNull()).select(g, s, u, F.col(value).cast("double").alias("_v"))
    seen = rows.select("*", F.explode(F.element_at(member, F.col("_g"))).alias("view"))
    found = seen.groupBy("view", "_u").agg(F.count("*").alias("_rows"), F.count("_v").alias("_values"), F.count_distinct("_g", "_s").alias("_cells"))
    once = F.when(F.col("_rows") > F.col("_cells"), F.raise_error(F.concat(F.lit("a cell is there twice: "), F.col("_u").cast("string")))).otherwise(F.col("_values"))
    units = found.select("view", "_u", (once == F.element_at(sizes, F.col("view")) * len(set(stages))).alias("_whole"))
    kept = seen.join(units.where("_whole"), ["view", "_u"], "left_semi")
    centred = kept.join(kept.groupBy("view").agg(F.avg("_v").alias("_m")), "view").select("view", "_g", "_s", "_u", (F.col("_v") - F.col("_m")).alias("_d"))
    factors = ["_g", "_s", "_u"]
    sets = [[f for i, f in enumerate(factors) if mask >> i & 1] for mask in range(8)]
    by = centred.groupingSets([["view", *x] for x in sets], "view", *factors).agg(*[F.grouping(f).alias(f"_no{f}") for f in factors], F.sum("_d").alias("_sum"), F.count("*").alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("_square"))
    is_set = lambda x: reduce(lambda a, b: a & b, [F.col(f"_no{f}") == int(f not in x) for f in factors])
    names = {tuple(x): "q" + "".join(x) for x in sets}
    moments = by.groupBy("view").agg(*[F.sum(F.when(is_set(x), F.col("_sum") * F.col("_sum") / F.col("_n"))).alias(names[tuple(x)]) for x in sets], F.max(F.when(is_set([]), F.col("_square"))).alias("ss_total"), F.count_if(is_set(["_u"])).alias("n_units"))

    def effect(x: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [(-1) ** (len(x) - len(t)) * F.col(names[tuple(t)]) for t in sets if {*t} <= {*x}])

    effects = {"grader": ["_g"], "stage": ["_s"], "unit": ["_u"], "grader_x_stage": ["_g", "_s"], "grader_x_unit": ["_g", "_u"], "stage_x_unit": ["_s", "_u"], "residual": factors}
    ss = moments.select("*", *[effect(x).alias(f"ss_{n}") for n, x in effects.items()])
    added = reduce(lambda a, b: a + b, [F.col(f"ss_{n}") for n in effects])
    open_by = F.abs(added - F.col("ss_total")) > tolerance * F.col("ss_total") + 1e-15
    closed = ss.withColumn("ss_total", F.when(open_by, F.raise_error(F.lit("sums of squares don't add up"))).otherwise(F.col("ss_total")))
    part = lambda names, of: F.try_divide(reduce(lambda a, b: a + b, [F.col(f"ss_{n}") for n in names]), of)
    within, table = F.col("ss_total") - F.col("ss_unit"), F.col("ss_grader") + F.col("ss_stage") + F.col("ss_grader_x_stage")
    dropped = units.groupBy("view").agg(F.count_if(~F.col("_whole")).alias("n_dropped"))
    return closed.join(dropped, "view").select(
        "view", F.element_at(sizes, F.col("view")).alias("n_graders"), "n_units", "n_dropped", *[f"ss_{n}" for n in effects], "ss_total",
        part(["unit"], F.col("ss_total")).alias("unit_frac_of_total"),
        part(["grader", "grader_x_unit"], within).alias("within_grader"), part(["stage", "stage_x_unit"], within).alias("within_stage"), part(["grader_x_stage", "residual"], within).alias("within_interaction"),
        part(["grader"], table).alias("cell_grader"), part(["stage"], table).alias("cell_stage"), part(["grader_x_stage"], table).alias("cell_interaction"),
    )


def ordering_passes(means: DataFrame, rank: str, value: str) -> DataFrame:
    """passes, pairs: how many pairs of stages have their means in descending order of the stages."""
    a, b = means.alias("a"), means.alias("b")
    pairs = a.join(b, F.col(f"a.{rank}") < F.col(f"b.{rank}"))
    return pairs.agg(F.count_if(F.col(f"a.{value}") > F.col(f"b.{value}")).alias("passes"), F.count("*").alias("pairs"))


def rename_tagged(rows: DataFrame, tag: str, columns: Mapping[str, str]) -> DataFrame:
    """Drops columns of an earlier run with the same tag and names the new ones metric_<name>_<tag>."""
    fresh = {old: f"metric_{new}_{tag}" for old, new in columns.items()}
    return rows.drop(*fresh.values()).withColumnsRenamed(fresh)
