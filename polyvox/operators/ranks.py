"""Ranks and running sums within groups of any size.

A group is cut into parts that follow one another in the order of a value, at approximate quantiles from a mergeable sketch. Sums of the parts
before a row's own, and a window inside its part, give what a window over the whole group would, without a task that holds one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a group that a part holds, about; beyond MOST_PARTS times as many, parts grow instead. The root of MOST_PARTS is whole.
VALUES_PER_PART = 250_000
MOST_PARTS = 1_024
_STEP = 32

GROUP = "_g"


def group_of(keys: Sequence[str]) -> Column:
    """One column that stands for the keys, equal where all of them are, nulls included."""
    return F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys]).alias(GROUP)


def keys_of(keys: Sequence[str]) -> list[Column]:
    """The keys back from group_of."""
    return [F.col(GROUP).getField(k).alias(k) for k in keys]


def with_part(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the number of the part of its group in which a row's value lies, ascending with the value.

    Equal values share a part. An odd part holds one value only, so that a value which very many rows have is alone. Groups of up to
    VALUES_PER_PART rows are one part, 0. Limits of parts are joined by group: there are at most MOST_PARTS - 1 for
    each large group, and Spark broadcasts them only if their measured size allows it.
    """
    value = F.col(column).cast("double")
    edges = F.array(*[F.lit(i / MOST_PARTS) for i in range(1, MOST_PARTS)])
    sketch = rows.groupBy(GROUP).agg(F.count("*").alias("_n"), F.percentile_approx(value, edges, 8 * MOST_PARTS).alias("_q"))
    wanted = F.least(F.lit(MOST_PARTS), F.ceil(F.col("_n") / VALUES_PER_PART))
    step = F.ceil(F.lit(MOST_PARTS) / wanted)
    limits = sketch.where(F.col("_n") > VALUES_PER_PART).select(GROUP, F.array_distinct(F.filter("_q", lambda _, i: (i + 1) % step == 0)).alias("_limits"))
    coarse = limits.select(GROUP, "_limits", F.filter("_limits", lambda _, i: (i + 1) % _STEP == 0).alias("_coarse"))
    below = lambda points: F.size(F.filter(points, lambda p: p < value))
    first = below(F.col("_coarse")) * _STEP
    near = F.slice("_limits", first + 1, _STEP)
    part = 2 * (first + below(near)) + F.when(F.array_contains(near, value), 1).otherwise(0)
    return rows.join(coarse, GROUP, "left").withColumn(out, F.coalesce(part, F.lit(0))).drop("_limits", "_coarse")


def running_sums(rows: DataFrame, order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds `<name>_before` for each name of sums: its sum over the rows of the group that stand before this one.

    rows has a column GROUP, and each value of `order` once in a group: count what is equal first.
    """
    turn = lambda c: F.desc(c) if descending else F.asc(c)
    parted = with_part(rows, order, "_part")
    earlier = Window.partitionBy(GROUP).orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)  # two rows for each of MOST_PARTS at most
    totals = parted.groupBy(GROUP, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    zero = F.lit(0).cast("long")
    starts = totals.select(GROUP, "_part", *[F.coalesce(F.sum(f"_{s}").over(earlier), zero).alias(f"_{s}") for s in sums])
    within = Window.partitionBy(GROUP, "_part").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = parted.join(starts, [GROUP, "_part"])
    return joined.withColumns({f"{s}_before": F.col(f"_{s}") + F.coalesce(F.sum(s).over(within), zero) for s in sums}).drop("_part", *[f"_{s}" for s in sums])


def average_rank(values: DataFrame, keys: Sequence[str], column: str, rank: str) -> DataFrame:
    """Adds the average rank of `column` within each group; a null key is a key, rows whose value is null go."""
    grouped = values.where(F.col(column).isNotNull()).withColumn(GROUP, group_of(keys))
    counts = grouped.groupBy(GROUP, column).agg(F.count("*").alias("_c"))
    ranks = running_sums(counts, column, ["_c"]).select(GROUP, column, (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(rank))
    return grouped.join(ranks, [GROUP, column]).drop(GROUP)


def positions(rows: DataFrame, keys: Sequence[str], order: str, tie: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """keys, `pos` (from 1) and `<name>_upto`, running sums of whole numbers up to and with the row, in the order of `order`, then `tie` ascending.

    Rows that agree in both stand in either order. Equal values of `order` are summed up first; among them rows are ordered by `tie`, a
    number, in parts of their own.
    """
    names = ["_one", *sums]
    whole = rows.select(group_of(keys), F.col(order).alias("_order"), F.col(tie).alias("_tie"), F.lit(1).cast("long").alias("_one"), *[c.cast("long").alias(n) for n, c in sums.items()])
    total = [F.sum(n).alias(n) for n in names]
    outer = running_sums(whole.groupBy(GROUP, "_order").agg(*total), "_order", names, descending)
    outer = outer.select(F.struct(GROUP, "_order").alias("_at"), *[F.col(f"{n}_before").alias(f"_out_{n}") for n in names])
    cells = whole.groupBy(F.struct(GROUP, "_order").alias(GROUP), "_tie").agg(*total)
    inner = running_sums(cells, "_tie", names).select(F.col(GROUP).alias("_at"), "_tie", *[F.col(f"{n}_before").alias(f"_in_{n}") for n in names])
    starts = inner.join(outer, "_at").select(F.struct("_at", "_tie").alias("_cell"), *[(F.col(f"_in_{n}") + F.col(f"_out_{n}")).alias(f"_start_{n}") for n in names])
    equal = Window.partitionBy("_cell").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    placed = whole.withColumn("_cell", F.struct(F.struct(GROUP, "_order").alias("_at"), "_tie")).join(starts, "_cell")
    upto = lambda n: F.col(f"_start_{n}") + F.sum(n).over(equal)
    return placed.select(*keys_of(keys), upto("_one").alias("pos"), *[upto(n).alias(f"{n}_upto") for n in sums])


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], exclusive: bool = False) -> DataFrame:
    """keys and, under each name of wanted, the quantile: between the neighbours of place 1 + q (n - 1), or of q (n + 1) within 1 and n if exclusive. Nulls are left out."""
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull()).groupBy(group_of(keys), v.alias("_v")).agg(F.count("*").alias("_c"))
    sizes = counts.groupBy(GROUP).agg(F.sum("_c").alias("_n"))
    placed = running_sums(counts, "_v", ["_c"]).join(sizes, GROUP)
    n, before = F.col("_n"), F.col("_c_before")
    holds = lambda place: ((before < place) & (place <= before + F.col("_c"))).cast("int")

    def at(q: float) -> Column:
        place = F.greatest(F.lit(1.0), F.least(n.cast("double"), q * (n + 1))) if exclusive else 1 + q * (n - 1)
        low = F.floor(place)
        return F.sum(F.when(holds(low) + holds(low + 1) > 0, F.col("_v") * (holds(low) * (1 - (place - low)) + holds(low + 1) * (place - low))))

    return placed.groupBy(GROUP).agg(*[at(q).alias(name) for name, q in wanted.items()]).select(*keys_of(keys), *wanted)
