"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- native expressions ---------------------------------------------------


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched.

    lower() does the same, and much faster than translate(), unless the text
    holds a cased character outside ASCII.
    """
    cased = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"
    return (
        F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
        .when(~text.rlike(cased), F.lower(text))
        .otherwise(F.translate(text, UPPER, LOWER))
    )


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- tables cut off from their lineage ------------------------------------


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own, gone at exit, where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="polyvox-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


#: Settings for the time in which a table is stored, where the session has Spark's defaults: few rows at once for a Python
#: worker, and no tables sent to all executors but those that an operator has checked itself.
_WHILE_STORED = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.autoBroadcastJoinThreshold": ("10485760b", "-1"),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": (None, "-1"),
}


@contextlib.contextmanager
def _own_settings(spark: SparkSession) -> Iterator[None]:
    """_WHILE_STORED for one job; the session's settings are put back after it."""
    before = {key: spark.conf.get(key, None) for key in _WHILE_STORED}
    changed = [key for key, (default, _) in _WHILE_STORED.items() if before[key] in (None, default)]
    for key in changed:
        spark.conf.set(key, _WHILE_STORED[key][1])
    try:
        yield
    finally:
        for key in changed:
            spark.conf.unset(key) if before[key] is None else spark.conf.set(key, before[key])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again, so that no later job repeats its work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _own_settings(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() has given, when nothing that is still to run reads them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


# --- on Python workers ----------------------------------------------------


#: Text, in bytes, that a worker has as Python objects at once. What reaches it at once is bounded by Spark itself
#: (spark.sql.execution.arrow.maxBytesPerBatch).
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose `column` holds about `most` bytes, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def kept_by_worker(key: str, make: Callable[[], object]):
    """make(), once in a worker's life: tasks that share the worker share what it made."""
    kept = sys.modules.setdefault("polyvox_worker", types.ModuleType("polyvox_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


#: Bytes of a text that are hashed at once.
_PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_IS_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(_PIECE, base, dtype=np.uint64)], dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII blanks, as a polynomial of their bytes that running sums give for all at once."""
    if len(text) <= _PIECE:
        return _mixed(_piece_hashes(np.frombuffer(text, dtype=np.uint8)))
    data, out, start = np.frombuffer(text, dtype=np.uint8), [], 0
    while start < len(data):
        piece = data[start : start + _PIECE]
        if start + _PIECE < len(data):
            blanks = np.nonzero(_IS_BLANK[piece])[0]
            if not len(blanks):  # a word longer than a piece: its parts' sums, each raised to its place
                value, place = 0, 0
                while start < len(data) and not _IS_BLANK[data[start]]:
                    part = data[start : start + _PIECE]
                    ends = np.nonzero(_IS_BLANK[part])[0]
                    part = part[: ends[0]] if len(ends) else part
                    total = int(((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)]).sum())
                    value = (value + total * pow(_BASE, place, 1 << 64)) % (1 << 64)
                    place += len(part)
                    start += len(part)
                out.append(np.array([value], dtype=np.uint64))
                continue
            piece = piece[: blanks[-1] + 1]
        out.append(_piece_hashes(piece))
        start += len(piece)
    return _mixed(np.concatenate(out))


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    edges = np.diff(np.concatenate([[True], _IS_BLANK[data], [True]]).view(np.int8))
    starts, stops = np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
    return (sums[stops] - sums[starts]) * _INVERSES[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, by doubling: two halves of known length make one."""
    if len(words) < size:
        return words[:0]
    spans, power = {1: words}, 1
    while power * 2 <= size:
        spans[power * 2] = _joined(spans[power], spans[power], power)
        power *= 2
    out, length = spans[power], power
    for part in sorted(spans, reverse=True):
        while length + part <= size:
            out = _joined(out, spans[part], length)
            length += part
    return out


def _joined(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Hashes of left spans followed by the right spans that start `length` words later."""
    count = len(right) - length
    mixed = (left[:count] ^ (left[:count] >> np.uint64(29))) * _STEP + right[length:] * np.uint64(2 * length + 0x632BE59B)
    return mixed ^ (mixed >> np.uint64(32))


# --- ranks within groups of any size --------------------------------------

#: Rows that one salted part of a group holds on average.
ROWS_PER_PART = 2_000
#: Most groups whose sizes are broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST_GROUPS = 50_000


def salted_rank(rows: DataFrame, group: str, order: list[str], rank: str, sizes: Column | None = None) -> DataFrame:
    """rows with the rank (from 0, no gaps) of each within its group, though a group may be a third of all rows.

    A group is dealt by hash into parts of about ROWS_PER_PART rows; parts are
    numbered within their group by running sums of their sizes, and rows within their
    part by `order`. Rows that agree in group and order may stand in either order.
    group must not be null. sizes: the number of rows of a row's group, where it is known.
    """
    if sizes is None:
        table = rows.groupBy(group).agg(F.count("*").alias("_size"))
        small = len(table.limit(MAX_BROADCAST_GROUPS + 1).take(MAX_BROADCAST_GROUPS + 1)) <= MAX_BROADCAST_GROUPS
        sized = rows.join(F.broadcast(table) if small else table, group)
    else:
        sized = rows.withColumn("_size", sizes)
    parts = F.greatest(F.ceil(F.col("_size") / ROWS_PER_PART).cast("long"), F.lit(1).cast("long"))
    dealt = sized.withColumn("_part", F.pmod(F.xxhash64(F.lit(7), *order), parts)).drop("_size")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(group, "_part")
        .agg(F.count("*").alias("_rows"))
        .select(group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(group, "_part").orderBy(*order)
    return dealt.join(starts, [group, "_part"]).withColumn(rank, F.col("_start") + F.row_number().over(within) - 1).drop("_part", "_start")
