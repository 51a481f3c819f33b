"""Scorers: how many bits each response costs, alone and after those before it.

All take `responses` (keys..., k, prompt, response), k from 1 in the order of the set, and
give (keys..., k, bits, bytes). The adaptive scorers learn in context: a word that
the prompt or an earlier response has used is cheaper. They are relational: bits depend
on counts only, so the plan aggregates to word counts before it orders anything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvox.functions.text import n_bytes, ws_words

SMALLEST_P = 1e-45
SET = "_set"


def _keys(responses: DataFrame, keys: Sequence[str]) -> list[str]:
    missing = {*keys, "k", "prompt", "response"} - {*responses.columns}
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return list(keys)


def _whole_keys(scorer: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Gives a scorer the keys as one struct, so that its joins match nulls with nulls, as its groups do: a set whose key is null is a set."""

    @wraps(scorer)
    def run(responses: DataFrame, keys: Sequence[str], *args, **kwargs) -> DataFrame:
        keys = _keys(responses, keys)
        packed = responses.select(F.struct(*keys).alias(SET), *[c for c in responses.columns if c not in keys])
        found = scorer(packed, [SET], *args, **kwargs)
        return found.select(f"{SET}.*", *[c for c in found.columns if c != SET])

    return run


def word_counts(responses: DataFrame, keys: Sequence[str], alone: bool = False) -> DataFrame:
    """keys, k, word, c; the prompt's words stand at k = 0. alone: each response is a history of its own."""
    keys = _keys(responses, keys)
    said = responses.select(*keys, "k", F.explode(ws_words(F.col("response"))).alias("word"))
    prompts = responses.where("k = 1").select(*keys, F.lit(0).cast("long").alias("k"), F.explode(ws_words(F.col("prompt"))).alias("word"))
    rows = said.unionByName(prompts)
    return rows.groupBy(*keys, "k", "word").agg(F.count("*").alias("c"))


def _sum_log2(first: Column, count: Column) -> Column:
    """Sum of log2(first + i) for i from 0 to count - 1."""
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.log2(first + i))


def _with_bytes(responses: DataFrame, keys: list[str], bits: DataFrame) -> DataFrame:
    rows = responses.select(*keys, "k", n_bytes(F.col("response")).alias("bytes"))
    return rows.join(bits, [*keys, "k"], "left").select(*keys, "k", F.coalesce("bits", F.lit(0.0)).alias("bits"), "bytes")


def uniform(responses: DataFrame, keys: Sequence[str], vocabulary: int) -> DataFrame:
    """Every word costs log2 of the vocabulary size."""
    words = F.size(ws_words(F.col("response")))
    return responses.select(*_keys(responses, keys), "k", (words * F.log2(F.lit(float(vocabulary)))).alias("bits"), n_bytes(F.col("response")).alias("bytes"))


def _history(responses: DataFrame, keys: list[str], alone: bool) -> DataFrame:
    """keys, k, word, c with h (the word's count before slot k), total and types (tokens before, word types of the set)."""
    counts = word_counts(responses, keys)
    types = counts.groupBy(*keys).agg(F.count_distinct("word").alias("types"))
    per_slot = counts.groupBy(*keys, "k").agg(F.sum("c").alias("n"))
    if alone:
        prompt = counts.where("k = 0").select(*keys, "word", F.col("c").alias("h"))
        total = per_slot.where("k = 0").select(*keys, F.col("n").alias("total"))
        rows = counts.where("k > 0").join(prompt, [*keys, "word"], "left").join(total, keys, "left").join(per_slot.where("k > 0"), [*keys, "k"])
    else:
        before = Window.partitionBy(*keys, "word").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        slots = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        seen = counts.withColumn("h", F.sum("c").over(before)).where("k > 0")
        rows = seen.join(per_slot.withColumn("total", F.sum("n").over(slots)), [*keys, "k"])
    zero = F.lit(0).cast("long")
    return rows.join(types, keys).select(*keys, "k", "word", "c", "n", F.coalesce("h", zero).alias("h"), F.coalesce("total", zero).alias("total"), "types")


@_whole_keys
def prequential(responses: DataFrame, keys: Sequence[str], alpha: float = 0.5, alone: bool = False) -> DataFrame:
    """Words one after the other: p(w) = (count so far + alpha) / (tokens so far + alpha (types + 1)).

    Within a response the sum does not depend on the order of its words, so
    counts suffice. alone: only the prompt comes before each response.
    """
    keys = _keys(responses, keys)
    rows = _history(responses, keys, alone)
    gain = rows.groupBy(*keys, "k").agg(
        F.sum(_sum_log2(F.col("h") + alpha, F.col("c"))).alias("gain"), F.first("n").alias("n"), F.first("total").alias("total"), F.first("types").alias("types")
    )
    bits = gain.select(*keys, "k", (_sum_log2(F.col("total") + alpha * (F.col("types") + 1), F.col("n")) - F.col("gain")).alias("bits"))
    return _with_bytes(responses, keys, bits)


@_whole_keys
def static(responses: DataFrame, keys: Sequence[str], temperatures: Sequence[float] = (1.0,), alpha: float = 0.5) -> DataFrame:
    """Counts as of the start of each response, at several temperatures: p(w) proportional to (count + alpha)^(1/T).

    The normaliser changes only by the words of earlier slots, so it is a running sum; one pass serves all
    temperatures. Adds column temperature.
    """
    if not all(t > 0 for t in temperatures):
        raise ValueError(f"temperatures must be above 0: {list(temperatures)}")
    keys = _keys(responses, keys)
    counts = word_counts(responses, keys)
    types = counts.groupBy(*keys).agg(F.count_distinct("word").alias("types"))
    before = Window.partitionBy(*keys, "word").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    seen = counts.withColumn("h", F.coalesce(F.sum("c").over(before), F.lit(0).cast("long")))
    hot = seen.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    power = lambda x: F.pow(x, 1 / F.col("temperature"))
    slot = hot.groupBy(*keys, "temperature", "k").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * F.log2(F.col("h") + alpha) / F.col("temperature")).alias("gain"),
        F.sum(power(F.col("h") + F.col("c") + alpha) - power(F.col("h") + alpha)).alias("delta"),
    )
    slots = Window.partitionBy(*keys, "temperature").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    run = slot.withColumn("grown", F.coalesce(F.sum("delta").over(slots), F.lit(0.0))).where("k > 0").join(types, keys)
    norm = (F.col("types") + 1) * power(F.lit(alpha)) + F.col("grown")
    bits = run.select(*keys, "temperature", "k", (F.col("n") * F.log2(norm) - F.col("gain")).alias("bits"))
    grid = responses.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    return _with_bytes(grid, [*keys, "temperature"], bits)


@_whole_keys
def ensemble(responses: DataFrame, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Mean of the probabilities of static scorers with these alphas, then the logarithm."""
    keys = _keys(responses, keys)
    rows = _history(responses, keys, alone=False)
    ps = [(F.col("h") + a) / (F.col("total") + a * (F.col("types") + 1)) for a in alphas]
    mean = sum(ps[1:], ps[0]) / len(ps)
    bits = rows.groupBy(*keys, "k").agg(F.sum(-F.col("c") * F.log2(F.greatest(mean, F.lit(SMALLEST_P)))).alias("bits"))
    return _with_bytes(responses, keys, bits)


#: Positions in a bin, in which tokens and spans meet.
BIN = 1_024


def _in_bins(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows once for each bin from their start to their end, both included."""
    bin_of = lambda x: F.floor(x / BIN)
    a, b = F.col(start), F.col(end)
    found = F.when(a.isNotNull() & b.isNotNull(), F.sequence(bin_of(F.least(a, b)), bin_of(F.greatest(a, b))))
    return rows.withColumn("_bin", F.explode(found))


def span_overlap(tokens: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k, first, stop, bits: tokens (t, c_start, c_end, bits) that overlap each span (k, s_start, s_end).

    A token that straddles two spans counts for both. Tokens and spans meet by bins of positions, so a set's work grows with its length and not
    with tokens times spans; what has several bins in common is taken in the one where the later of both starts. The sides are merged: a plan can't
    know how many tokens an explosion makes, and would broadcast them.
    """
    hit = (F.col("c_end") > F.col("s_start")) & (F.col("c_start") < F.col("s_end")) & (F.col("_bin") == F.floor(F.greatest("c_start", "s_start") / BIN))
    left = _in_bins(tokens.select(*keys, "t", "c_start", "c_end", "bits"), "c_start", "c_end")
    right = _in_bins(spans.select(*keys, "k", "s_start", "s_end"), "s_start", "s_end")
    met = left.join(right.hint("merge"), [*keys, "_bin"]).where(hit)
    return met.groupBy(*keys, "k").agg(F.min("t").alias("first"), (F.max("t") + 1).alias("stop"), F.sum("bits").alias("bits"))


def external(tokens: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k, bits, bytes from log-probabilities made elsewhere; a span without tokens costs nothing. spans carry bytes."""
    found = span_overlap(tokens, spans, keys).select(*keys, "k", "bits")
    return spans.join(found, [*keys, "k"], "left").select(*keys, "k", F.coalesce("bits", F.lit(0.0)).alias("bits"), "bytes")


def hash_permutations(responses: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """Each set in `count` orders (column perm), ordered by a hash of perm and place: the same on any engine and any cluster."""
    keys = _keys(responses, keys)
    many = responses.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    order = Window.partitionBy(*keys, "perm").orderBy(F.md5(F.concat_ws(":", "perm", "k").cast("binary")), "k")
    return many.withColumn("idx", F.col("k")).withColumn("k", F.row_number().over(order).cast("long"))


@_whole_keys
def token_bits(responses: DataFrame, keys: Sequence[str], alpha: float = 0.5) -> DataFrame:
    """keys, k, t (from 0), word, bits: what each word costs after everything before it, in order. The sum over a response is `prequential`."""
    keys = _keys(responses, keys)
    said = responses.select(*keys, "k", F.posexplode(ws_words(F.col("response"))).alias("t", "word"))
    asked = responses.where("k = 1").select(*keys, F.lit(0).cast("long").alias("k"), F.posexplode(ws_words(F.col("prompt"))).alias("t", "word"))
    rows = said.unionByName(asked)
    types = rows.groupBy(*keys).agg(F.count_distinct("word").alias("types"))
    order = Window.partitionBy(*keys).orderBy("k", "t")
    same = Window.partitionBy(*keys, "word").orderBy("k", "t")
    p = (F.row_number().over(same) - 1 + alpha) / (F.row_number().over(order) - 1 + alpha * (F.col("types") + 1))
    return rows.join(types, keys).withColumn("bits", -F.log2(p)).where("k > 0").select(*keys, "k", "t", "word", "bits")
