"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source is cut into blocks of documents. A source of m parts, of M that all sources have, gets m blocks in each cycle of
M slots, spread evenly: its block j is released at floor(j M / m) and due at ceil((j + 1) M / m). Of the released
blocks the one with the earliest deadline takes the slot. That is optimal for one slot at a time, so all deadlines
are met, and until a source runs out none has had a whole block more or less than its share at any time. The slots of
a source that has run out stay empty, so that the others go on in the same proportions.

All cycles are alike, and sources of equal weight differ in their turn only. So the schedule is made once, by a fold
over what the configuration has: for each weight, its blocks of a cycle, each as many slots as there are sources of
that weight. Its size grows with the weights that are told apart, not with sources or rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_GROUPS, salted_rank

BLOCK_DOCS = 16
#: Target weights of the registered query and the pipeline; sources that are not named weigh 1 each.
WEIGHTS: dict[str | None, float] = {"src0": 8, "src1": 4, "src2": 2}
#: Parts of all different weights together, up to which weights are exact; beyond it they are rounded to so many parts.
MAX_PARTS = 1_000

#: Earliest deadline first over one cycle: classes are the different weights (m parts, q sources each). A step runs one
#: class until its block's turn is over or a block of another class is released. runs: class i from its job g on, n slots from `at` on.
_EARLIEST_DEADLINE = """
aggregate(
  sequence(1L, 2L * aggregate(classes, 0L, (a, c) -> a + c.m)),
  named_struct('t', 0L, 'given', transform(classes, c -> 0L), 'runs', cast(array() as array<struct<i: int, g: bigint, at: bigint, n: bigint>>)),
  (s, step) -> if(s.t >= cycle, s, transform(
    transform(
      array(named_struct(
        'i', array_min(filter(transform(classes, (c, i) -> if(
            s.given[i] < c.q * c.m and ((s.given[i] div c.q) * cycle) div c.m <= s.t,
            named_struct('due', ((s.given[i] div c.q + 1L) * cycle + c.m - 1L) div c.m, 'i', i),
            null)), x -> x is not null)).i,
        'until', coalesce(array_min(filter(transform(classes, (c, i) -> if(s.given[i] < c.q * c.m, ((s.given[i] div c.q) * cycle) div c.m, null)), x -> x > s.t)), cycle))),
      p -> named_struct('i', p.i, 'n', least(classes[p.i].q - s.given[p.i] % classes[p.i].q, p.until - s.t))),
    p -> named_struct(
      't', s.t + p.n,
      'given', transform(s.given, (g, i) -> if(i = p.i, g + p.n, g)),
      'runs', array_append(s.runs, named_struct('i', p.i, 'g', s.given[p.i], 'at', s.t, 'n', p.n))))[0]),
  s -> s.runs)
"""


def _source_key(source: Column) -> Column:
    """A key that is never null and tells null from every text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def whole_parts(weights: Mapping[str | None, float] | None) -> tuple[dict[str | None, int], int]:
    """Parts of the sources that are named, and of each other one, in the proportions of their weights (1 for the others)."""
    exact = {s: Fraction(str(w)) for s, w in (weights or {}).items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights are positive numbers")
    unit = Fraction(1, math.lcm(1, *(w.denominator for w in exact.values())))
    every = {Fraction(1), *exact.values()}
    if sum(every) / unit > MAX_PARTS:
        unit = sum(every) / MAX_PARTS
    parts = {w: max(1, round(w / unit)) for w in every}
    common = math.gcd(*parts.values())
    return {s: parts[w] // common for s, w in exact.items()}, parts[Fraction(1)] // common


def _parts(weights: Mapping[str | None, float] | None) -> Column:
    """Parts of the source whose key is in column src."""
    named, other = whole_parts(weights)
    if not named:
        return F.lit(other).cast("long")
    keys = {("null" if s is None else f"={s}"): n for s, n in named.items()}
    table = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col("src")), F.lit(other)).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """From (src, m): cycle, m, q and for each block k of a cycle its runs (first turn e, slot at, n): one row for each weight and block."""
    classes = sources.groupBy("m").agg(F.count("*").alias("q"))
    row = classes.agg(F.sort_array(F.collect_list(F.struct("m", "q"))).alias("classes")).withColumn("cycle", F.expr("aggregate(classes, 0L, (a, c) -> a + c.m * c.q)"))
    runs = row.where("cycle > 0").select("classes", "cycle", F.expr(_EARLIEST_DEADLINE).alias("runs")).select("classes", "cycle", F.explode("runs").alias("r"))
    of = runs.select("cycle", F.expr("classes[r.i].m").alias("m"), F.expr("classes[r.i].q").alias("q"), "r")
    by_block = of.groupBy("cycle", "m", "q", F.expr("r.g div q").alias("k"))
    return by_block.agg(F.collect_list(F.struct(F.expr("r.g % q").alias("e"), F.col("r.at").alias("at"), F.col("r.n").alias("n"))).alias("runs"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Each row of docs as struct `doc`, with src, block, slot, release, deadline and position.

    Weights are positive numbers, whole or not; sources without one (all, by default) weigh 1. All rows come out once, none
    twice: where a source runs out, its slots stay empty and the others go on by their weights. Within a source the order is a hash order
    that depends on ids and texts only; repeated rows take places of their own. A null source is a source. position orders
    the whole mix: slot, then place in the block. An empty table gives an empty result.
    """
    row = F.struct("*")
    rows = docs.select(row.alias("doc")).select("doc", _source_key(F.col("doc.source")).alias("src"), F.col("doc.doc_id").cast("long").alias("id"), F.xxhash64("doc.text").alias("th"))
    counts = rows.groupBy("src").agg(F.count("*").alias("_size"))
    turn = F.row_number().over(Window.partitionBy("m").orderBy("src")).cast("long") - 1
    sources = counts.select("src", "_size", _parts(weights).alias("m")).withColumn("e", turn)
    small = len(sources.limit(MAX_BROADCAST_GROUPS + 1).take(MAX_BROADCAST_GROUPS + 1)) <= MAX_BROADCAST_GROUPS
    known = rows.join(F.broadcast(sources) if small else sources, "src")
    ranked = salted_rank(known, "src", ["id", "th"], "rank", F.col("_size")).withColumn("block", F.expr(f"rank div {int(block_docs)}"))
    placed = ranked.select("*", F.expr("block div m").alias("c"), F.expr("block % m").alias("k"))
    joined = placed.join(F.broadcast(schedule(sources.select("src", "m"))), ["m", "k"])
    slot = F.expr("c * cycle + filter(transform(runs, r -> if(e >= r.e and e < r.e + r.n, r.at + e - r.e, null)), x -> x is not null)[0]")
    return joined.select(
        "doc",
        F.when(F.col("src") == "null", None).otherwise(F.substring("src", 2, 2**31 - 1)).alias("src"),
        "block",
        slot.alias("slot"),
        F.expr("c * cycle + (k * cycle) div m").alias("release"),
        F.expr("c * cycle + ((k + 1L) * cycle + m - 1L) div m").alias("deadline"),
        (slot * block_docs + F.expr(f"rank % {int(block_docs)}")).alias("position"),
    )
