"""How filters act together: each order's kept, removed and redundant documents, from one histogram of what each document fails.

A document's outcome under all orders of the filters follows from the set of filters that it fails, a mask of five bits. So the documents are
counted by part, mask and label once; the histograms, stacked as rows of a matrix of 32 columns, are multiplied by integer matrices of 32 rows and
a column for each order and step (600), which say what becomes of a mask there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, discard, let, stored

FILTERS = "ABCDE"


def failures(text: Column) -> Column:
    """Bits 0 to 3 for filters A to D of a text that isn't null.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * [A-Z] > 2 * code points; D: holds any of [#$%&*|].
    """
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")

    def bits(words: Column) -> Column:
        n = F.size(words)
        capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
        fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals.cast("long") > 2 * F.char_length(text).cast("long"), text.rlike("[#$%&*|]")]
        return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))

    return let(words, bits)


def _digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, bits, h1, h2, good, toxic: what a document is judged by, without its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        failures(text).alias("bits"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )
    told = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    yes = lambda name: F.coalesce(name, F.lit(False)).cast("int").alias(name)
    return rows.join(told, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "part", "bits", "h1", "h2", yes("good"), yes("toxic"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail, bit 4 (filter E) being a text that a smaller doc_id has, too.

    Texts are read once; what is judged by goes to the shared folder. Copies are told by 128-bit hashes: the first holder of each text by an
    aggregate that combines within a task, and its rows by a join on hash and doc_id, so that copies, however many, are dealt out evenly.
    """
    digests = stored(_digests(docs, labels), "digests")
    firsts = digests.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    copies = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("bits") + F.when(copies, 16).otherwise(0)
    counts = (
        digests.join(firsts, ["h1", "h2", "doc_id"], "left")
        .groupBy("part", mask.alias("mask"))
        .agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    )
    out = stored(counts, "masks")
    discard(digests)
    return out


def outcomes() -> tuple[list[str], dict[str, np.ndarray]]:
    """The 120 orders, and for each outcome its matrix: masks by (order, step)."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    masks = np.arange(1 << len(FILTERS))
    found = {name: np.zeros((len(masks), len(orders) * len(FILTERS)), dtype=np.int64) for name in ("kept", "removed", "redundant", "unique_fails")}
    column = 0
    for order in orders:
        gone = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails, before = masks & bit != 0, masks & gone != 0
            found["removed"][:, column] = fails & ~before
            found["redundant"][:, column] = fails & before
            found["unique_fails"][:, column] = masks == bit
            gone |= bit
            found["kept"][:, column] = masks & gone == 0
            column += 1
    return orders, found


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step (from 1) and, for the filter at that step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is a value of `source`, null being the empty string. A null text is empty. Rows without a doc_id, which is smaller than none, are no copies and have no
    labels; rows that share the smallest doc_id of a text are no copies of one another. A document counts as good (toxic) if any of its rows in labels
    says so. Other columns may have any name. Every part has a row for each of the 120 orders and 5 steps; an empty table has no parts.
    """
    entry = F.struct("mask", "n", "good", "toxic")
    parts = histograms(docs, labels).groupBy("part").agg(F.collect_list(entry).alias("masks"))  # 32 masks at most

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, matrices = outcomes()
        steps, turns = len(FILTERS), len(orders) * len(FILTERS)
        names = pa.array([o for o in orders for _ in range(steps)])
        numbers = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders)))
        at = np.array([FILTERS.index(letter) for order in orders for letter in order])
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                stack = np.zeros((len(part), 3, 1 << steps), dtype=np.int64)
                for row, masks in enumerate(part.column("masks").to_pylist()):
                    for m in masks:
                        stack[row, :, m["mask"]] = m["n"], m["good"], m["toxic"]
                found = {name: stack[:, 0] @ matrix for name, matrix in matrices.items()}
                found["good_lost"], found["toxic_lost"] = stack[:, 1] @ matrices["removed"], stack[:, 2] @ matrices["removed"]
                found["shapley"] = np.stack([found["removed"][:, at == f].sum(axis=1) for f in range(steps)], axis=1)[:, at]
                for row, name in enumerate(part.column("part").to_pylist()):
                    columns = [pa.array([name] * turns, pa.string()), names, numbers, *(pa.array(found[c][row]) for c in COLUMNS)]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COLUMNS])

    return parts.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))
