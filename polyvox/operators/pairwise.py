"""Cross-mode analysis: what one mode's sample tells about another's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyvox.functions.text import ws_words
from polyvox.operators import lexical, ranks
from polyvox.operators.ranks import GROUP


def rotated_pairs(samples: DataFrame, mode: str, k: str) -> DataFrame:
    """ctx, tgt, k, ctx_k: each sample k (from 0) of each target mode with sample (k + 1) mod m of every context mode.

    m is the number of samples of the smallest mode. The sample number is an equality key, so
    the pairs are linear in the samples.
    """
    size = samples.groupBy(mode).agg(F.count("*").alias("n")).agg(F.min("n").alias("m"))
    rows = samples.join(F.broadcast(size)).where(F.col(k) < F.col("m"))
    ctx = rows.select(F.col(mode).alias("ctx"), F.col(k).alias("ctx_k"))
    tgt = rows.select(F.col(mode).alias("tgt"), F.col(k).alias("k"), ((F.col(k) + 1) % F.col("m")).alias("ctx_k"))
    return tgt.join(ctx, "ctx_k")


def whole_pairs(samples: DataFrame, mode: str, k: str) -> DataFrame:
    """ctx, tgt, k, ctx_k: each sample k (from 0) of each target mode with sample (k + 1) mod n of every context mode.

    n is the number of samples of that context mode, so every sample is a target, where rotated_pairs
    leaves out what the smallest mode has no number for. A sample is never its own context: a mode of one
    sample isn't paired with itself. Samples without a mode are in no pair. Mode and sample number
    are equality keys, so the pairs are linear in the samples.
    """
    ctx = samples.select(F.col(mode).alias("ctx"), F.col(k).alias("ctx_k"))
    sizes = ctx.groupBy("ctx").agg(F.count("*").alias("n"))
    tgt = samples.select(F.col(mode).alias("tgt"), F.col(k).alias("k")).where("tgt IS NOT NULL")
    dealt = tgt.join(F.broadcast(sizes)).select("ctx", "tgt", "k", ((F.col("k") + 1) % F.col("n")).alias("ctx_k"))
    return dealt.where("ctx <> tgt OR k <> ctx_k").join(ctx, ["ctx", "ctx_k"])


def conditional_bits(pairs: DataFrame, words: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Adds bits and alone: bits of the target sample's words after the context sample, and without it.

    words: mode, k, word, c. Probabilities are (count in context + alpha) / (context tokens + alpha (types + 1)),
    with the number of word types of all samples.
    """
    types = words.agg(F.count_distinct("word").alias("types"))
    totals = words.groupBy("mode", "k").agg(F.sum("c").alias("total"))
    said = pairs.join(words.select(F.col("mode").alias("tgt"), "k", "word", "c"), ["tgt", "k"])
    seen = words.select(F.col("mode").alias("ctx"), F.col("k").alias("ctx_k"), "word", F.col("c").alias("h"))
    total = totals.select(F.col("mode").alias("ctx"), F.col("k").alias("ctx_k"), "total")
    rows = said.join(seen, ["ctx", "ctx_k", "word"], "left").join(total, ["ctx", "ctx_k"]).join(F.broadcast(types))
    h = F.coalesce("h", F.lit(0))
    bits = -F.col("c") * F.log2((h + alpha) / (F.col("total") + alpha * (F.col("types") + 1)))
    return rows.groupBy("ctx", "tgt", "k", "ctx_k").agg(F.sum(bits).alias("bits"), F.sum(F.col("c") * F.log2(F.col("types") + 1.0)).alias("alone"))


def numbered(samples: DataFrame, mode: str, order: str, carried: str, plain: DataFrame | None = None) -> DataFrame:
    """Adds k: the place of each sample in its mode, from 0, by `order`, a number; samples that agree in it are ordered by `carried`.

    Only numbers are ranked, in parts of a mode; samples cross the network once, by mode and number. plain: mode and number of the same
    samples, where other columns are costly to make.
    """
    grouped, counted = (x.withColumn(GROUP, ranks.group_of([mode])) for x in (samples, samples if plain is None else plain))
    starts = ranks.running_sums(counted.groupBy(GROUP, order).agg(F.count("*").alias("_n")), order, ["_n"])
    at = F.struct(GROUP, order).alias("_at")
    equal = Window.partitionBy("_at").orderBy(carried)
    placed = grouped.select(at, *samples.columns).join(starts.select(at, "_n_before"), "_at")
    return placed.select(*samples.columns, (F.col("_n_before") + F.row_number().over(equal) - 1).cast("long").alias("k"))


def _packed(text: str | None) -> tuple[bytes, int]:
    """The words told apart with their counts, compressed, and the number of words."""
    counts = Counter((text or "").encode().split())
    words = sorted(counts)
    c = np.array([counts[w] for w in words], dtype="<u4")
    raw = len(words).to_bytes(4, "little") + c.view(np.uint8).reshape(-1, 4).T.tobytes() + b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True), int(c.sum())


@lru_cache(maxsize=64)
def _unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, dict[bytes, int]]:
    raw = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    c = np.ascontiguousarray(np.frombuffer(raw[4 : 4 + 4 * n], dtype=np.uint8).reshape(4, n).T).view("<u4").reshape(n)
    words = raw[4 + 4 * n :].split()
    return words, c, dict(zip(words, c.tolist(), strict=True))


def whole_bits(samples: DataFrame, mode: str, order: str, text: str, alpha: float = 0.5) -> DataFrame:
    """ctx, tgt, k, ctx_k, bits, alone: conditional_bits of the whole_pairs of texts numbered by `order`, a number, within their mode.

    Words are what stands between runs of ASCII white space. A text travels as its packed word counts: to its number within the
    mode, to the contexts of that number, and as a target once to each number of a context that it has; modes of equal
    remainders share that number. Pairs without words on either side are left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_packed(t) for t in b.column("text").to_pylist()]
            columns = [b.column("_mode"), b.column("_order"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_mode", "_order", "_packed", "_total"])

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gain = []
            for target, context in zip(b.column("_packed").to_pylist(), b.column("_seen").to_pylist(), strict=True):
                words, c, _ = _unpacked(target)
                seen = _unpacked(context)[2]
                h = np.fromiter((seen.get(w, 0) for w in words), dtype=float, count=len(words))
                gain.append(float(c @ np.log2(h + alpha)))
            columns = [b.column(x) for x in ("ctx", "tgt", "k", "ctx_k", "_total", "_context_total")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gain, pa.float64())], names=["ctx", "tgt", "k", "ctx_k", "n", "total", "gain"])

    kinds = dict(samples.dtypes)
    texts = samples.select(F.col(mode).alias("_mode"), F.col(order).alias("_order"), F.col(text).alias("text")).where(F.col(mode).isNotNull())
    packed = texts.mapInArrow(pack, f"_mode {kinds[mode]}, _order {kinds[order]}, _packed binary, _total long")
    rows = numbered(packed, "_mode", "_order", "_packed", texts)
    sizes = texts.groupBy("_mode").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("_mode", "n")).alias("_sizes"))
    types = samples.select(F.lit(0).alias("_all"), F.col(text).alias("text"))
    types = lexical.distinct_ngrams(types, ["_all"], ws_words, (1,))
    ctx = rows.where("_total > 0").select(F.col("k").alias("ctx_k"), F.col("_mode").alias("ctx"), F.col("_packed").alias("_seen"), F.col("_total").alias("_context_total"))
    place = lambda s: (F.col("k") + 1) % s["n"]
    tgt = rows.where("_total > 0").join(F.broadcast(sizes)).select(F.col("_mode").alias("tgt"), "k", "_packed", "_total", "_sizes", F.explode(F.array_distinct(F.transform("_sizes", place))).alias("ctx_k"))
    tgt = tgt.select("tgt", "k", "ctx_k", "_packed", "_total", F.transform(F.filter("_sizes", lambda s: place(s) == F.col("ctx_k")), lambda s: s["_mode"]).alias("_contexts"))
    pairs = tgt.join(ctx, "ctx_k").where(F.array_contains("_contexts", F.col("ctx")) & ((F.col("ctx") != F.col("tgt")) | (F.col("k") != F.col("ctx_k"))))
    pairs = pairs.select("ctx", "tgt", "k", "ctx_k", "_total", "_context_total", "_packed", "_seen")
    found = pairs.mapInArrow(gains, f"ctx {kinds[mode]}, tgt {kinds[mode]}, k long, ctx_k long, n long, total long, gain double")
    bits = F.col("n") * F.log2(F.col("total") + alpha * (F.col("uniq") + 1)) - F.col("gain")
    return found.join(F.broadcast(types.select("uniq"))).select("ctx", "tgt", "k", "ctx_k", bits.alias("bits"), (F.col("n") * F.log2(F.col("uniq") + 1.0)).alias("alone"))


def reduction(bits: DataFrame) -> DataFrame:
    """ctx, tgt, mean, std, sem of what the context saves."""
    saved = F.col("alone") - F.col("bits")
    return bits.groupBy("ctx", "tgt").agg(F.avg(saved).alias("mean"), F.stddev_pop(saved).alias("std"), (F.stddev_pop(saved) / F.sqrt(F.count("*"))).alias("sem"))


def margins(matrix: DataFrame, by: str) -> DataFrame:
    """by, mean, sem, rank: means of rows or columns with the propagated error, largest first."""
    rows = matrix.groupBy(by).agg(F.avg("mean").alias("mean"), (F.sqrt(F.sum(F.col("sem") * F.col("sem"))) / F.count("*")).alias("sem"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), by)))


def _both_ways(matrix: DataFrame) -> DataFrame:
    """ctx, tgt, mean and back, the mean of the other direction, of each unordered pair; the matrix is read once."""
    first, last = F.least("ctx", "tgt").alias("ctx"), F.greatest("ctx", "tgt").alias("tgt")
    way = lambda there: F.max(F.when(F.col("there") == there, F.col("mean")))
    rows = matrix.where("ctx <> tgt").select(first, last, (F.col("ctx") < F.col("tgt")).alias("there"), "mean")
    pairs = rows.groupBy("ctx", "tgt").agg(way(True).alias("mean"), way(False).alias("back"), F.count_distinct("there").alias("ways"))
    return pairs.where("ways = 2").drop("ways")


def asymmetry(matrix: DataFrame) -> DataFrame:
    """ctx, tgt, gap between the two directions of each unordered pair."""
    return _both_ways(matrix).select("ctx", "tgt", (F.col("mean") - F.col("back")).alias("gap"))


def diagonal_means(matrix: DataFrame) -> DataFrame:
    same = F.col("ctx") == F.col("tgt")
    return matrix.agg(F.avg(F.when(same, F.col("mean"))).alias("diagonal"), F.avg(F.when(~same, F.col("mean"))).alias("off_diagonal"), F.avg(F.when(~same, F.when(F.col("mean") > 0, 1.0).otherwise(0.0))).alias("frac_positive"))


def extremes(matrix: DataFrame, n: int) -> DataFrame:
    """The n largest and the n smallest cross pairs (a report: n is its length)."""
    cross = matrix.where("ctx <> tgt").select("ctx", "tgt", "mean")
    top = cross.orderBy(F.desc("mean"), "ctx", "tgt").limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(cross.orderBy("mean", "ctx", "tgt").limit(n).withColumn("side", F.lit("bottom")))


def symmetry_fit(matrix: DataFrame) -> DataFrame:
    """slope, intercept, r2 of one direction against the other over unordered pairs."""
    both = _both_ways(matrix)
    return both.agg(F.regr_slope("back", "mean").alias("slope"), F.regr_intercept("back", "mean").alias("intercept"), F.regr_r2("back", "mean").alias("r2"))


def first_quarter_share(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, share of the summed delta that falls on the first quarter of the tokens; null where the sum is within 0.1 of 0."""
    sizes = tokens.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("delta").alias("total"))
    early = F.when(F.col("t") < F.floor(F.col("n") / 4), F.col("delta")).otherwise(0.0)
    joined = tokens.join(sizes, keys)
    return joined.groupBy(*keys).agg(F.first("n").alias("n"), F.when(F.abs(F.first("total")) > 0.1, F.sum(early) / F.first("total")).alias("share"))
