"""Line dedup with DataFrame functions only.

Lines are normalised and hashed (128 bits in two halves), the documents of each
hash are counted, and a line whose hash is over the threshold is dropped from
all documents but the first. What each document loses comes back as positions,
so its text crosses the network once and its lines never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, strip_blanks


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row (a hash of the text: it tells apart rows that share an id), pos, h1, h2 of each line long enough."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    stripped = lines.select("doc_id", "row", "pos", strip_blanks(F.col("line")).alias("line"))
    keys = stripped.where(F.char_length("line") >= min_chars).select("doc_id", "row", "pos", ascii_lower(F.col("line")).alias("key"))
    return keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_keys(keys: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2 and the smallest doc_id of each hash that at least min_docs documents hold."""
    bounds = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last")]
    if min_docs <= 2:  # two documents at least: the smallest id isn't the largest
        found = keys.groupBy("h1", "h2").agg(*bounds)
        return found.where((F.col("first") < F.col("last")) if min_docs == 2 else F.lit(True)).select("h1", "h2", "first")
    per_doc = keys.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), *bounds).where(F.col("n") >= min_docs).select("h1", "h2", "first")


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Each row of docs as struct `doc`, with n_lines, n_dropped and the kept text.

    Keys of at least min_chars code points that at least min_docs documents
    hold lose all their lines except those in the smallest doc_id. Rows that share
    a doc_id are one document for the count, and each is cut by itself. A row
    without doc_id keeps all its lines and counts for none. A null text is one
    empty line and stays null. Other columns pass through in `doc`, under any
    name. An empty table gives an empty result.
    """
    keys = line_keys(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), min_chars)
    # The join is keyed otherwise than the counts: so both of its sides are dealt out for it alone, and the share of a
    # line that very many documents hold can be split among tasks.
    key = (F.col("h1").bitwiseXOR(F.col("h2")).alias("k"), "h2")
    repeated = repeated_keys(keys, min_docs).select(*key, "first")
    drops = (
        keys.select("doc_id", "row", "pos", *key)
        .join(repeated, ["k", "h2"])
        .where(F.col("doc_id") > F.col("first"))
        .groupBy("doc_id", "row")
        .agg(F.collect_set("pos").alias("drops"))
        .withColumnsRenamed({"doc_id": "drop_id", "row": "drop_row"})
    )
    rows = docs.select(F.struct("*").alias("doc"))
    doc_id, text = F.col("doc.doc_id").cast("long"), F.col("doc.text").cast("string")
    joined = rows.join(drops, (doc_id == F.col("drop_id")) & (F.xxhash64(text) == F.col("drop_row")), "left")

    def without(drops: Column) -> Column:
        return let(
            F.struct(split_lines(text).alias("lines"), drops.alias("drops")),
            lambda s: F.array_join(
                F.transform(
                    F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["drops"]),
                    lambda i: F.get(s["lines"], i),
                ),
                "\n",
            ),
        )

    return joined.select(
        "doc",
        F.size(split_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), text).otherwise(without(F.col("drops"))).alias("kept"),
    )
