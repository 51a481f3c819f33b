"""Connected components: tasks contract the edges that they hold, alternating large and small stars join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Edges that a task contracts at once.
EDGES_AT_ONCE = 200_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of edges (a, b), and the smallest id that each reaches by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return ids, ids[root]


def _contracted(edges: DataFrame) -> DataFrame:
    """In place of each EDGES_AT_ONCE edges of a task, one from each of their ids to the smallest that it reaches by them, itself included."""
    most = EDGES_AT_ONCE

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            columns = _roots(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in "ab"))
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["a", "b"])

        for batch in (x.slice(i, most) for x in batches for i in range(0, len(x), most)):
            if held and sum(map(len, held)) + len(batch) > most:
                yield out()
                held = []
            held.append(batch)
        if held:
            yield out()

    return edges.where("a <> b").select("a", "b").mapInArrow(contract, "a long, b long")


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct edges, the larger end first, without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = _pairs(both.where(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return _pairs(moved)


def _apart(edges: DataFrame) -> bool:
    """Whether an id has two smaller ones, or a smaller one that has one, too."""
    up, down = edges.where("a > b").select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), edges.where("a > b").select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.unionByName(down).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(ends.where("up > 1 or (up > 0 and down > 0)").take(1))


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every id that an edge (a, b) touches. Edges are read twice, from a table best.

    Tasks contract EDGES_AT_ONCE edges each. Fewer are one task's and done with that; of more, what tasks have left is joined
    in rounds, each one written table, so a lost executor costs no more than a round; the
    rounds needed grow with the logarithm of the longest chain, and each drops the table of the one before. Edges are never
    collected. A hub's edges are summed up before they are dealt out, and meet its smallest neighbour in a join that adaptive
    execution splits where they are many.
    """
    tasks = -(-edges.count() // EDGES_AT_ONCE)
    now = stored(_contracted(edges.coalesce(max(1, tasks))), "edges")
    if tasks <= 1:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while _apart(now):
        before, now = now, stored(_contracted(_stars(now)), "edges")
        discard(before)
    members = now.where("a > b").select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
