"""Length matching and length audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvox.functions.text import n_bytes, utf8_prefix
from polyvox.operators.ranks import quantiles


def shortest(rows: DataFrame, prompt: str, origin: Sequence[str], order: str) -> DataFrame:
    """prompt, min_bytes, and where the first shortest response comes from."""
    sized = rows.withColumn("_b", n_bytes(F.col("response")))
    pick = F.min(F.struct("_b", order, *origin)).alias("_p")
    return sized.groupBy(prompt).agg(pick).select(prompt, F.col("_p._b").alias("min_bytes"), *[F.col(f"_p.{o}").alias(o) for o in origin])


def length_matched(rows: DataFrame, prompt: str, floor: int) -> DataFrame:
    """Each response cut to its prompt's shortest one, with original_bytes and truncation_bytes; prompts below the floor go."""
    least = rows.groupBy(prompt).agg(F.min(n_bytes(F.col("response"))).alias("truncation_bytes")).where(F.col("truncation_bytes") >= floor)
    joined = rows.join(least, prompt)
    return joined.withColumn("original_bytes", n_bytes(F.col("response"))).withColumn("response", utf8_prefix(F.col("response"), F.col("truncation_bytes").cast("int")))


def exclusive_quantile(rows: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """keys, quantile at position q (n + 1) between neighbours, clamped to the ends."""
    return quantiles(rows, keys, value, {"quantile": q}, exclusive=True)


def length_report(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, min, median, mean, max, p10, p90 (inclusive, linear) and coefficient of variation."""
    v = F.col(value).cast("double")
    at = lambda q: F.percentile(v, F.lit(q))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(v).alias("min"), at(0.5).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("max"), at(0.1).alias("p10"), at(0.9).alias("p90"),
        F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv"),
    )


def monotone_trend(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """keys, rising, falling: whether every step goes up, or down."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_d", step).groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(False)).alias("rising"), F.coalesce(F.bool_and(F.col("_d") < 0), F.lit(False)).alias("falling"))


def skip_rate_guard(rows: DataFrame, skipped: Column, most: float = 0.1) -> DataFrame:
    """rows, or an error as soon as they are read where more than `most` of them are skipped."""
    share = rows.agg(F.avg(F.when(skipped, 1.0).otherwise(0.0)).alias("_s"))
    ok = F.when(F.col("_s") > most, F.raise_error(F.concat(F.lit("skip rate "), F.col("_s").cast("string")))).otherwise(F.lit(True))
    return rows.join(F.broadcast(share)).where(ok).drop("_s")
