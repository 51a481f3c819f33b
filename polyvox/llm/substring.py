"""Substring dedup by suffix trees over prefix partitions.

A passage counts as repeated from `window` words on, so trees are cut at that depth.

1. Sampled suffixes. Of the runs of `prefix` words inside a window the one with the smallest hash starts a
   sampled suffix; equal windows have the same one at the same place, and neighbouring windows mostly share
   it. A prefix that only one document has leads to no inner node: its suffixes are leaves and go no further.
2. Groups. Where a prefix is found in several documents, the words around it (all windows that contain it as
   their sample) go to the group of that prefix, in real words.
3. Subtrees. A group that fits GROUP_WORDS gets its suffix tree level by level, by prefix doubling: suffixes that
   agree in 1, 2, 4 ... `window` words are one node of that depth. Inner nodes at the full depth with leaves of two
   documents are repeats, and neighbouring ones join to maximal repeats. Nodes are made from words, not from hashes.
4. Longer prefixes. A group that doesn't fit is never held: its suffixes go on one by one to groups by a longer
   prefix of their own (LENGTHS of the window), as long as it takes. Suffixes that agree in all `window` words are
   compared with the smallest document's as they come, in no memory to speak of.

Before anything is sent, a task settles the repeats inside its own batch with the same tree, and so does a
group before its suffixes go on: a later copy is removed at once, and only the first one goes on. So a passage
that a third of all documents share sends one row per batch, and its next prefix gets one row per GROUP_WORDS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, gram_hashes, slices, stored, word_hashes

WINDOW, PREFIX = 50, 10
#: Text, in bytes, that a mapper settles at once.
BATCH_BYTES = 8_000_000
#: Words that a group may have to be held in memory and made a subtree of.
GROUP_WORDS = 1_500_000
#: Words of the longer prefixes, as shares of the window; the last is all of it.
LENGTHS = (0.4, 0.7, 1.0)

#: kind 0: windows start..stop are found repeats; kind 1: words from start on go to the group of `prefix`.
_SENT = "kind int, prefix long, doc_id long, row long, start int, stop int, words binary"
_NAMES = ["kind", "prefix", "doc_id", "row", "start", "stop", "words"]
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
_SCATTER = 0x9E3779B97F4A7C15


def samples(words: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' hashes: place of each sampled suffix, the first window that has it, and the hash of its prefix.

    The windows of one sample follow each other; the leftmost of equal runs is taken.
    """
    none = np.empty(0, np.int64)
    if len(words) < window:
        return none, none, words[:0]
    runs = gram_hashes(words, prefix)
    low, at, width = runs, np.arange(len(runs)), 1  # sliding minimum by doubling, with its place
    while width * 2 <= window - prefix + 1:
        low, at = _lower(low[:-width], at[:-width], low[width:], at[width:])
        width *= 2
    rest, n = window - prefix + 1 - width, len(words) - window + 1
    if rest:
        low, at = _lower(low[:n], at[:n], low[rest : rest + n], at[rest : rest + n])
    first = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
    return at[first], first, runs[at[first]]


def _lower(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    right = b < a
    return np.where(right, b, a), np.where(right, bt, at)


# --- subtrees -------------------------------------------------------------


def tree_nodes(words: list[bytes], depth: int) -> np.ndarray:
    """For each suffix of the words the number of its node at `depth`: equal for those that agree in so many words."""
    known: dict[bytes, int] = {}
    node = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    level = 1
    while level * 2 <= depth:
        node = _children(node[:-level], node[level:])
        level *= 2
    return _children(node[: len(node) - depth + level], node[depth - level :]) if level < depth else node


def _children(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left * (right.max(initial=0) + 1) + right
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def later_windows(stretches: list[list[bytes]], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each stretch of words, which of its windows also start in a stretch of a smaller document."""
    sizes = np.array([len(s) for s in stretches])
    node = tree_nodes([w for s in stretches for w in s], window)
    begin = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    node, doc = node[at], np.repeat(docs, counts)
    first = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, node, doc)
    return np.split(doc > first[node], np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray, breaks: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """(start, stop, flag) of the runs of equal flags, and equal values in breaks."""
    new = np.r_[True, flags[1:] != flags[:-1]]
    if breaks is not None:
        new[1:] |= breaks[1:] != breaks[:-1]
    starts = np.nonzero(new)[0]
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(flags)], flags[starts].tolist(), strict=True))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


# --- 1: prefixes that several documents have ------------------------------


def _sampler(window: int, prefix: int):
    """Mapper: kind 0 samples are known to be shared, kind 1 samples wait, kind 2 rows say that a prefix is shared."""

    def settle(held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(h[2]) for h in held]
        prefixes, places = np.concatenate([h[3] for h in held]), np.concatenate([h[2] for h in held])
        docs, rows = (np.repeat(np.array([h[i] for h in held]), sizes) for i in (0, 1))
        order = np.lexsort((docs, prefixes))
        prefixes, places, docs, rows = prefixes[order], places[order], docs[order], rows[order]
        head = np.nonzero(np.r_[True, prefixes[1:] != prefixes[:-1]])[0]
        last = np.r_[head[1:], len(prefixes)] - 1
        several = docs[head] != docs[last]
        shared = np.repeat(several, last - head + 1)
        known = prefixes[head[several]]
        kind = np.r_[np.where(shared, 0, 1), np.full(len(known), 2)].astype(np.int32)
        scattered = (docs.astype(np.uint64) + places.astype(np.uint64)) * np.uint64(_SCATTER)
        none = np.zeros(len(known), np.int64)
        columns = [kind, np.r_[np.where(shared, scattered, prefixes), known].view(np.int64), np.r_[docs, none], np.r_[rows, none], np.r_[places, none].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "prefix", "doc_id", "row", "place"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text"):
            columns = (batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), column_bytes(batch, "text"))
            for doc_id, row, text in zip(*columns, strict=True):
                places, _, prefixes = samples(word_hashes(text), window, prefix)
                if len(places):
                    held.append((doc_id, row, places, prefixes))
                    size += len(text)
                if size >= BATCH_BYTES:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    return send


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, place of the samples whose prefix has two documents; rows come sorted by prefix and are not held beyond that."""
    names = ["kind", "prefix", "doc_id", "row", "place"]
    held, known = None, None  # samples of the last prefix, if still of one document; the last prefix found to be shared
    for batch in batches:
        now = pa.Table.from_batches([batch.select(names)])
        table = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
        kind, prefix, doc = (table.column(c).to_numpy() for c in names[:3])
        if not len(kind):
            continue
        head = np.nonzero(np.r_[True, prefix[1:] != prefix[:-1]])[0]
        number = np.cumsum(np.r_[False, prefix[1:] != prefix[:-1]])
        real = kind == 1
        low, high = np.full(len(head), np.iinfo(np.int64).max), np.full(len(head), np.iinfo(np.int64).min)
        np.minimum.at(low, number[real], doc[real])
        np.maximum.at(high, number[real], doc[real])
        several = (low < high) | (prefix[head] == known) if known is not None else low < high
        several[number[kind == 2]] = True
        take = (kind == 0) | (real & several[number])
        yield from table.filter(pa.array(take)).select(names[2:]).to_batches()
        if several[-1]:
            held, known = None, prefix[-1]
        else:
            held = table.filter(pa.array(real & (number == number[-1])))


# --- 2: the words around them ---------------------------------------------


def _sender(window: int, prefix: int):
    """Mapper over documents with the places of their shared samples."""

    def settle(held: list[tuple[int, int, int, list[bytes], np.ndarray]]) -> pa.RecordBatch:
        rows = []
        later = later_windows([h[3] for h in held], np.array([h[0] for h in held]), window)
        for (doc_id, row, start, words, prefixes), flags in zip(held, later, strict=True):
            for a, b, gone in _runs(flags, prefixes):
                if gone:
                    rows.append((0, _signed(doc_id * _SCATTER + start + a), doc_id, row, start + a, start + b, None))
                else:
                    rows.append((1, int(prefixes[a]), doc_id, row, start + a, start + b, b" ".join(words[a : b + window - 1])))
        return _table(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # stretches of neighbouring windows
        for batch in slices(batches, "text"):
            columns = (batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), column_bytes(batch, "text"), batch.column("places"))
            for doc_id, row, text, some in zip(*columns, strict=True):
                words = text.split()
                places, first, prefixes = samples(word_hashes(text), window, prefix)
                windows = np.diff(np.r_[first, len(words) - window + 1])
                shared = np.repeat(np.isin(places, some.values.to_numpy()), windows)
                prefixes = np.repeat(prefixes.view(np.int64), windows)
                for a, b, found in _runs(shared):
                    if found:
                        held.append((doc_id, row, a, words[a : b + window - 1], prefixes[a:b]))
                        size += 6 * (b - a + window)
                if size >= BATCH_BYTES:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    return send


# --- 3 and 4: groups ------------------------------------------------------


def _grouper(window: int, longer: int | None):
    """Reducer over rows of kind 1, sorted by prefix and doc_id: kind 0 for repeats, kind 1 for what needs `longer` words of prefix."""

    def solve(rows: list[tuple], small: bool) -> pa.RecordBatch:
        """Repeats among rows (prefix, doc_id, row, start, words); if not small, the others go on by a longer prefix."""
        stretches, out = [r[4].split() for r in rows], []
        for (_, doc_id, row, start, _), words, flags in zip(rows, stretches, later_windows(stretches, np.array([r[1] for r in rows]), window), strict=True):
            for a, b, gone in _runs(flags):
                if gone:
                    out.append((0, 0, doc_id, row, start + a, start + b, None))
                elif not small:
                    for at in range(a, b):
                        text = b" ".join(words[at : at + window])
                        key = xxhash.xxh3_64_intdigest(b" ".join(words[at : at + longer]), seed=longer)
                        out.append((1, _signed(key), doc_id, row, start + at, start + at + 1, text))
        return _table(out)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # whole groups, and the last one as far as it is read
        own, own_size, small = 0, 0, True  # rows and words of the last group among the held ones
        last = None
        for batch in batches:
            settled = batch.filter(pa.array(batch.column("kind").to_numpy() == 0))
            if len(settled):
                yield settled
            batch = batch.filter(pa.array(batch.column("kind").to_numpy() == 1))
            columns = [batch.column(c).to_pylist() for c in ("prefix", "doc_id", "row", "start", "words")]
            for row in zip(*columns, strict=True):
                if row[0] != last:
                    if held and (not small or size >= GROUP_WORDS):
                        yield solve(held, small)
                        held, size = [], 0
                    last, own, own_size, small = row[0], 0, 0, True
                words = row[4].count(b" ") + 1
                if own and own_size + words > GROUP_WORDS:
                    # Too much for one subtree: what came before it is done with, and it goes on in parts.
                    if len(held) > own:
                        yield solve(held[:-own], True)
                    yield solve(held[len(held) - own :], False)
                    held, size, own, own_size, small = [], 0, 0, 0, False
                held.append(row)
                size, own, own_size = size + words, own + 1, own_size + words
        if held:
            yield solve(held, small)

    return group


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer over single windows, sorted by the hash of all their words and doc_id: each against the first with the same words."""
    last, first = None, {}
    for batch in batches:
        out = []
        for key, doc_id, row, start, words in zip(*(batch.column(c).to_pylist() for c in ("prefix", "doc_id", "row", "start", "words")), strict=True):
            if key != last:
                last, first = key, {}
            if first.setdefault(words, doc_id) < doc_id:
                out.append((0, 0, doc_id, row, start, start + 1, None))
        yield _table(out)


def grouped(rows: DataFrame, reducer) -> DataFrame:
    return rows.repartition("prefix").sortWithinPartitions("prefix", "doc_id").mapInArrow(reducer, _SENT)


def shared_samples(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """doc_id, row, place of the sampled suffixes whose prefix starts one in another document, too."""
    sent = texts.mapInArrow(_sampler(window, prefix), "kind int, prefix long, doc_id long, row long, place int")
    return sent.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_shared, "doc_id long, row long, place int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, row, start, stop: ranges of window starts whose windows also start in a smaller doc_id.

    row is xxhash64 of the text. Rows without doc_id or text take no part.
    """
    prefix = min(prefix, window)
    # Texts that are too short for a window needn't be looked at.
    long = F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * window - 1)
    texts = docs.where(long).select("doc_id", F.xxhash64("text").alias("row"), "text")
    places = shared_samples(texts, window, prefix).groupBy("doc_id", "row").agg(F.collect_set("place").alias("places"))
    around = texts.join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places")
    lengths = [n for n in sorted({max(prefix, round(window * share)) for share in LENGTHS}) if n > prefix] or [window]
    now = stored(grouped(around.mapInArrow(_sender(window, prefix), _SENT), _grouper(window, lengths[0])), "groups")
    found = now.where("kind = 0")
    for length, longer in zip(lengths, [*lengths[1:], None], strict=True):
        now = now.where("kind = 1")
        if now.isEmpty():
            break
        now = stored(grouped(now, _equal_windows if longer is None else _grouper(window, longer)), f"groups-{length}")
        found = found.unionByName(now.where("kind = 0"))
    return found.select("doc_id", "row", "start", "stop")


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, one space between) of each row of docs.

    A word goes if a window that covers it also starts in a document with
    a smaller doc_id; windows are judged on the input. Rows that share a doc_id never outrank each
    other, and each comes out by itself; a row without doc_id loses nothing
    and removes nothing. A null text has no words. An empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = (
        repeated_windows(rows, window, prefix)
        .groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
        .select(F.col("doc_id").alias("range_id"), F.col("row").alias("range_row"), F.col("ranges.start").alias("starts"), F.col("ranges.stop").alias("stops"))
    )
    joined = rows.join(found, (F.col("doc_id") == F.col("range_id")) & (F.xxhash64("text") == F.col("range_row")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], []]
            columns = (column_bytes(batch, "text"), batch.column("starts").to_pylist(), batch.column("stops").to_pylist())
            for text, starts, stops in zip(*columns, strict=True):
                words = (text or b"").split()
                n = len(words)
                if starts:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, np.array(stops) + window - 1, -1)
                    words = [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]
                for column, value in zip(out, (n, n - len(words), b" ".join(words)), strict=True):
                    column.append(value)
            kept = pa.array(out[2], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), kept],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.select("doc_id", "text", "starts", "stops").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
