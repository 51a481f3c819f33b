"""python -m polyvox INPUT.jsonl OUTPUT: diversity scores of a response log."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from polyvox.operators import curves
from polyvox.plans import scorers
from polyvox.sources import readers, sinks

KEYS = ["scale", "prompt_idx"]


def run(spark: SparkSession, source: str, target: str, permutations: int = 1, alpha: float = 0.5) -> None:
    """Scores of every (scale, prompt) and their means by scale, as one JSON object per scale."""
    log = readers.response_log(spark, source)
    first = log.groupBy(*KEYS).agg(F.min_by("prompt", "response_idx").alias("prompt"))
    slots = F.row_number().over(scorers.Window.partitionBy(*KEYS).orderBy("response_idx")).cast("long")
    sets = log.withColumn("k", slots).drop("prompt").join(first, KEYS).select(*KEYS, "k", F.coalesce("prompt", F.lit("")).alias("prompt"), "response")
    if permutations > 1:
        orders = scorers.hash_permutations(sets, KEYS, permutations)
        curve = curves.mean_curves(scorers.prequential(orders, [*KEYS, "perm"], alpha), KEYS)
    else:
        curve = scorers.prequential(sets, KEYS, alpha)
    scores = curves.diversity(curve, scorers.prequential(sets, KEYS, alpha, alone=True), KEYS)
    values = ["d_c_an", "d_c_e", "d_c_e_rate", "e", "e_rate", "c", "sigma", "a_n_per_byte"]
    sinks.nested_json(scores, "scale", "prompt_idx", values, target)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--permutations", type=int, default=1)
    parser.add_argument("--alpha", type=float, default=0.5)
    given = parser.parse_args()
    run(SparkSession.builder.appName("polyvox").getOrCreate(), given.source, given.target, given.permutations, given.alpha)


if __name__ == "__main__":
    main()
