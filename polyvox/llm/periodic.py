"""Runs of periodic repetition in texts: heavy and light lag counting, then island scans of the lags that matter.

For a text's words, the number of places where a word stands again `lag` words later is counted for all lags at once:
words that are frequent in the text by FFT autocorrelation of their places (whole numbers below 2^53, so rounding is exact), rare ones by
the differences of their places. A run of period q matches itself at lag q in a stretch as long as the run less q, so only lags with enough
matches are scanned for such stretches (islands), and what a run of period q adds to the lags 2q, 3q, ... is taken off these
before they are judged. A text is one row and is worked on by itself: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK_RUN, column_bytes, let, slices

MIN_WORDS = 12
#: Pairs of places of rare words that are held at once.
PAIRS_AT_ONCE = 1 << 20


def lag_matches(ids: np.ndarray, frequent: float | None = None) -> np.ndarray:
    """For each lag up to half the words, the number of words that stand again that many words later.

    Words with more than `frequent` places (by default half the square root of n log n, where both ways cost about the same) go
    through the FFT, one at a time, all others through pairs of places, PAIRS_AT_ONCE at a time: memory grows with the words only.
    """
    n, most = len(ids), len(ids) // 2
    counts = np.bincount(ids)
    frequent = max(8.0, (n * np.log2(max(n, 2))) ** 0.5 / 2) if frequent is None else frequent
    heavy = np.flatnonzero(counts > frequent)
    found = np.zeros(most + 1, dtype=np.int64)
    if len(heavy):
        size = 1 << (n + most - 1).bit_length()  # no lag up to `most` meets another one that wraps around
        spectrum = np.zeros(size // 2 + 1)
        for word in heavy:
            part = np.fft.rfft(ids == word, size)
            spectrum += part.real**2 + part.imag**2
        found += np.rint(np.fft.irfft(spectrum, size)[: most + 1]).astype(np.int64)
    places = np.argsort(ids, kind="stable")
    places = places[counts[ids[places]] <= frequent]
    own = ids[places]
    later = np.searchsorted(own, own, side="right") - np.arange(1, len(own) + 1)  # places of the same word after this one
    upto = np.cumsum(later)
    start = 0
    while start < len(own):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + PAIRS_AT_ONCE, side="right")))
        many = later[start:stop]
        first = np.repeat(np.arange(start, stop), many)
        second = first + 1 + np.arange(len(first)) - np.repeat(upto[start:stop] - many - before, many)
        lags = places[second] - places[first]
        found += np.bincount(lags[lags <= most], minlength=most + 1)
        start = stop
    found[0] = n
    return found


def islands(ids: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """Starts and stops of the longest stretches of at least `least` places whose word stands again `lag` words later."""
    step = least // 2
    if step >= 3:  # a stretch holds a multiple of step and the two places after it
        at = np.arange(0, len(ids) - lag - 2, step)
        for more in range(3):
            at = at[ids[at + more] == ids[at + more + lag]]
        if not len(at):
            return
    same = np.zeros(len(ids) - lag + 2, dtype=np.int8)
    same[1:-1] = ids[:-lag] == ids[lag:]
    edges = np.flatnonzero(np.diff(same))
    starts, stops = edges[::2], edges[1::2]
    for i in np.flatnonzero(stops - starts >= least):
        yield int(starts[i]), int(stops[i])


def runs_of(ids: np.ndarray, min_words: int = MIN_WORDS, frequent: float | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of each longest stretch with smallest period q and at least max(min_words, 2 q) words, by start, then period."""
    n = len(ids)
    if n < max(2, min_words):
        return []
    left = lag_matches(ids, frequent)
    lags = np.arange(len(left))
    need = np.maximum(lags, min_words - lags)
    seen: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero((left >= need) & (lags > 0)).tolist():
        if left[lag] < need[lag]:
            continue
        for start, stop in islands(ids, lag, int(need[lag])):
            if (start, stop + lag) not in seen:  # else a run of a period that divides this lag
                seen[start, stop + lag] = lag
                length = stop + lag - start
                again = np.arange(2 * lag, min(length, len(left)), lag)
                left[again] -= length - again
    return sorted((start, stop - start, lag) for (start, stop), lag in seen.items())


def _ids(words: list[bytes]) -> np.ndarray:
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Each row of docs as struct `doc`, with n_words, its runs (start, length, period; by start, then period) and `collapsed`.

    Words stand between the characters [\\x20\\x09-\\x0D]. A run is a stretch of words with smallest period q, at least max(min_words, 2 q)
    words long, which no neighbouring word extends. collapsed: the words that no run contains after its first q ones, joined by
    one space. A null or empty text has no words, no runs and collapses to an empty text. Rows are judged one by one, so ids may be null or
    repeated and rows too; all columns of docs pass through in `doc`, under any name. An empty table gives an empty result. A worker
    needs some 150 bytes for each word of its longest text.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, every, collapsed = [], [], []
            for value in column_bytes(batch, "text"):
                words = (value or b"").split()  # of bytes: at exactly these characters
                runs = runs_of(_ids(words), min_words)
                sizes.append(len(words))
                every.append([{"start": s, "length": size, "period": q} for s, size, q in runs])
                if runs:
                    gone = np.zeros(len(words) + 1, dtype=np.int32)
                    for s, size, q in runs:
                        gone[s + q] += 1
                        gone[s + size] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                collapsed.append(b" ".join(words))
            of_runs = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
            texts = pa.array(collapsed, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(every, of_runs), texts], names=["doc", "n_words", "runs", "collapsed"]
            )

    schema = T.StructType([rows.schema["doc"], *T.StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").fields])
    return rows.mapInArrow(find, schema)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length; of equals the one that starts first, then that of the smallest period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def repeat_tail(text: Column, at: Column, period: Column) -> Column:
    """The text's words, joined by one space, with each word from number `at` (from 0) on taken again from the first `period` of these. Both see n words > 0."""
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")

    def changed(words: Column) -> Column:
        n = F.size(words)
        return F.when(
            n > 0,
            F.array_join(
                let(
                    F.struct(at(n).cast("int").alias("a"), period(n).cast("int").alias("p")),
                    lambda s: F.transform(
                        F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]))
                    ),
                ),
                " ",
            ),
        ).otherwise(text)

    return let(words, changed)
