"""Lexical and embedding diversity of groups of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words that a worker has at once, one text at least; words of contexts that it counts at once, one bucket at least.
WORDS_AT_ONCE, COUNTED_AT_ONCE = 1_200_000, 700_000
#: Contexts of one bucket are counted together.
BUCKETS = 4_096
#: Ends a word in a packed context; no byte of UTF-8 has this value.
_END = b"\xff"
#: Odd multipliers of the two halves of a gram's hash; fixed values.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def distinct_ngrams(texts: DataFrame, keys: Sequence[str], words: Callable[[Column], Column], sizes: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """keys, n, uniq, total, distinct: n-grams pooled over the texts of a group, every size of every group; 0 without n-grams.

    Each gram belongs to its longest word (of equally long ones the one with the smallest hash, then the first), and each word travels once with
    as many neighbours as the grams of any size that belong to it need: 3.6 words for sizes up to 5, where the grams themselves would be
    15. Equal contexts are counted by batch of texts first. What belongs to a word of a group meets in one of BUCKETS buckets, which are
    worked on one after the other. Short words, the frequent ones, own next to nothing. Groups stand as 64-bit hashes, null keys told apart.
    """
    if any(n < 1 for n in sizes):
        raise ValueError("n-gram sizes start at 1")
    marked = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    group = F.xxhash64(F.lit(0), *marked).alias("_g")
    wanted = sorted({*sizes})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(_lengths(batch.column("_words")))
            start = 0
            while start < len(batch):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
                start = stop
                if size >= WORDS_AT_ONCE or start < len(batch):
                    yield from _contexts(held, wanted[-1])
                    held, size = [], 0
        if size:
            yield from _contexts(held, wanted[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket = [], 0, None
        for batch in batches:
            for b, n, packed in zip(*(batch.column(c).to_pylist() for c in ("_b", "_n", "_packed")), strict=True):
                if size >= COUNTED_AT_ONCE and b != bucket:
                    yield _gram_counts(held, wanted)
                    held, size = [], 0
                held.append((n, packed))
                size, bucket = size + n, b
        if held:
            yield _gram_counts(held, wanted)

    packed = texts.select(group, words(F.col("text")).alias("_words")).mapInArrow(pack, "_b int, _n int, _packed binary")
    parts = packed.repartition("_b").sortWithinPartitions("_b").mapInArrow(count, "_g long, n int, uniq long, total long")
    counted = parts.groupBy("_g", "n").agg(F.sum("uniq").alias("uniq"), F.sum("total").alias("total"))
    grid = texts.select(*keys).distinct().withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).select("*", group)
    zero = F.lit(0).cast("long")
    return grid.join(counted, ["_g", "n"], "left").select(
        *keys,
        "n",
        F.coalesce("uniq", zero).alias("uniq"),
        F.coalesce("total", zero).alias("total"),
        F.coalesce(F.col("uniq") / F.col("total"), F.lit(0.0)).alias("distinct"),
    )


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(count: int) -> np.ndarray:
    """Two random 64-bit numbers for each of the words that one worker has numbered."""
    return np.random.default_rng(0).integers(0, 2**64, size=(count, 2), dtype=np.uint64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + steps


def _contexts(texts: list[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Words with the neighbours that grams of theirs need, equal ones once with their number, packed by bucket."""
    lists = pa.concat_arrays([t.column("_words") for t in texts])
    told = lists.flatten().dictionary_encode()
    if not len(told):
        return
    spelled = [w.encode() for w in told.dictionary.to_pylist()]
    hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in spelled), dtype="<u8")
    ranks = np.array([255 - min(len(w), 255) for w in spelled], dtype=np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
    word = told.indices.to_numpy()
    lengths = _lengths(lists)
    row = np.repeat(np.arange(len(lists)), lengths)
    rank, own = ranks[word], _numbers(len(spelled))[:, 0][word]
    left, right = np.zeros(len(word), dtype=np.int64), np.zeros(len(word), dtype=np.int64)
    to_left, to_right = np.ones(len(word), dtype=bool), np.ones(len(word), dtype=bool)
    for d in range(1, min(longest, len(word))):
        near = row[d:] == row[:-d]
        to_left[:d], to_right[-d:] = False, False
        to_left[d:] &= near & (rank[:-d] > rank[d:])
        to_right[:-d] &= near & (rank[d:] >= rank[:-d])
        left += to_left
        right += to_right
    start, size = np.arange(len(word)) - left, left + 1 + right
    content = left.astype(np.uint64)
    for d in range(int(size.max())):
        goes_on = size > d
        content[goes_on] = content[goes_on] * _MULTIPLIERS[0] + own[start[goes_on] + d]
    groups = np.concatenate([t.column("_g").to_numpy() for t in texts])
    group = groups[row]
    content += group.view(np.uint64)
    bucket = (hashes[word] ^ group.view(np.uint64) * _MULTIPLIERS[0]) % np.uint64(BUCKETS)
    code = np.unique(groups, return_inverse=True)[1][row].astype(np.uint64) % np.uint64(1 << 12)
    order = np.argsort(bucket << np.uint64(52) | code << np.uint64(40) | content >> np.uint64(24))
    start, size, left, content, group, bucket = (x[order] for x in (start, size, left, content, group, bucket))
    same = (content[1:] == content[:-1]) & (group[1:] == group[:-1]) & (size[1:] == size[:-1]) & (left[1:] == left[:-1])
    for d in range(int(size.max())):  # content is only a hash
        at = np.flatnonzero(same & (size[1:] > d))
        same[at] = word[start[1:][at] + d] == word[start[:-1][at] + d]
    first = np.flatnonzero(np.r_[True, ~same])
    counts = np.diff(np.r_[first, len(order)])
    start, size, left, group, bucket = (x[first] for x in (start, size, left, group, bucket))
    # Spelled out, each word with its end.
    spell = pa.array([w + _END for w in spelled], type=pa.large_binary()).take(pa.array(word[_ranges(start, size)]))
    ends = np.frombuffer(spell.buffers()[1], dtype=np.int64)[: len(spell) + 1]
    letters = memoryview(spell.buffers()[2])
    upto = np.r_[0, np.cumsum(size)]
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(first)]
    rows = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        runs = np.flatnonzero(np.r_[True, group[i + 1 : j] != group[i : j - 1]])
        head = np.array([j - i, len(runs)], dtype="<i4").tobytes()
        told_by = [group[i:j][runs].astype("<i8"), np.diff(np.r_[runs, j - i]).astype("<i4"), left[i:j].astype("<i4"), size[i:j].astype("<i4"), counts[i:j].astype("<i4")]
        raw = b"".join([head, *(_planes(x) for x in told_by), letters[ends[upto[i]] : ends[upto[j]]]])
        rows.append((int(bucket[i]), int(upto[j] - upto[i]), len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)))
    b, n, packed = zip(*rows, strict=True)
    for i in range(0, len(rows), 1000):
        cut = slice(i, i + 1000)
        yield pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int32()), pa.array(n[cut], pa.int32()), pa.array(packed[cut], pa.binary())], names=["_b", "_n", "_packed"])


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then all second ones, and so on: they compress better."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(raw: memoryview, count: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(-1, count).T).view(kind).reshape(count).astype(np.int64)


def _gram_counts(packed: list[tuple[int, bytes]], sizes: Sequence[int]) -> pa.RecordBatch:
    """Grams told apart and all grams, of each group and size, in the contexts of some buckets."""
    parts, letters = [], []
    for _, blob in packed:
        raw = memoryview(pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
        n, runs = np.frombuffer(raw[:8], dtype="<i4").tolist()
        at, found = 8, []
        for count, kind in ((runs, "<i8"), (runs, "<i4"), (n, "<i4"), (n, "<i4"), (n, "<i4")):
            width = count * int(kind[2])
            found.append(_unplanes(raw[at : at + width], count, kind))
            at += width
        parts.append((np.repeat(found[0], found[1]), *found[2:]))
        letters.append(raw[at:])
    group, left, size, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    text = np.frombuffer(b"".join(letters), dtype=np.uint8)
    ends = np.flatnonzero(text == _END[0]) + 1
    offsets = np.r_[0, ends].astype(np.int64)
    word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
    own = _numbers(len(word.dictionary))[word.indices.to_numpy()]
    middle, right = np.cumsum(size) - size + left, size - 1 - left
    names, code = np.unique(group, return_inverse=True)
    gram, made, out = own, 1, []
    for n in sizes:
        while made < n and len(gram) > 1:  # grams of the next size
            gram = gram[:-1] * _MULTIPLIERS + own[made:]
            made += 1
        if made < n:
            break
        have = [np.flatnonzero((left >= a) & (right >= n - 1 - a)) for a in range(n)]
        which = np.concatenate(have)
        if not len(which):
            continue
        found = gram[np.concatenate([middle[h] - a for a, h in enumerate(have)])]
        of = code[which]
        order = np.argsort(found[:, 0] + of.astype(np.uint64))
        found, named = found[order], of[order]
        fresh = np.r_[True, (found[1:] != found[:-1]).any(axis=1) | (named[1:] != named[:-1])]
        uniq = np.bincount(named[fresh], minlength=len(names))
        total = np.zeros(len(names), dtype=np.int64)
        np.add.at(total, of, counts[which])
        some = np.flatnonzero(total)
        out.append((names[some], np.full(len(some), n), uniq[some], total[some]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 4
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns, types, strict=True)], names=["_g", "n", "uniq", "total"])


def averaged_distinct(distinct: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, avg_distinct and a map from size to value."""
    per_n = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "distinct"))))
    return distinct.groupBy(*keys).agg(F.avg("distinct").alias("avg_distinct"), per_n.alias("per_n"))


def expectation_adjusted(distinct: DataFrame, keys: Sequence[str], vocabulary: int = 50_257) -> DataFrame:
    """keys, ead: unique n-grams over those expected of as many random draws from the vocabulary, averaged over sizes."""
    expected = vocabulary * (1 - F.pow(F.lit((vocabulary - 1) / vocabulary), F.col("total")))
    value = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("uniq").cast("double"), expected), F.lit(0.0)))
    return distinct.groupBy(*keys).agg(F.avg(value).alias("ead"))


def mean_pairwise_cosine(vectors: DataFrame, keys: Sequence[str], column: str = "embedding", clip: float | None = None) -> DataFrame:
    """keys, n, mean_cosine over all unordered pairs of a group, in time linear in its rows.

    The sum over pairs is (|sum of unit vectors|^2 - sum of their squared lengths) / 2, so only
    per-dimension sums are needed. Null with fewer than two vectors. A zero vector has no direction: it
    makes the result null, or counts as a zero vector if its norm is clipped.
    """
    x = F.transform(column, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    if clip is not None:
        norm = F.greatest(norm, F.lit(clip))
    unit = F.transform(x, lambda v: F.try_divide(v, norm))
    rows = vectors.select(*keys, F.posexplode(unit).alias("dim", "u"))
    dims = rows.groupBy(*keys, "dim").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), F.count("*").alias("n"), F.count("u").alias("real"))
    return dims.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.when(F.min("real") == F.max("n"), F.try_divide(F.sum(F.col("s") * F.col("s") - F.col("q")), (F.max("n") * (F.max("n") - 1)).cast("double"))).alias("mean_cosine"),
    )
