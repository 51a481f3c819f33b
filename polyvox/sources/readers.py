"""Readers of the file layouts that response data comes in. All read through Spark, so any store that it knows will do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE_LOG = "prompt string, prompt_idx int, response_idx int, scale double, response string"
GENERATIONS = (
    "prompt_id string, prompt string, stage string, model string, prompt_set string, sample_idx int, response string, "
    "temperature double, top_p double, max_new_tokens int, seed long, finish_reason string, original_bytes int, truncation_bytes int"
)
PROMPTS = "prompt_id string, prompt string, source string, source_split string, orig_index int, dataset_name string"


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped, missing fields null."""
    return spark.read.schema(schema).json(path)


def response_log(spark: SparkSession, path: str) -> DataFrame:
    """scale, prompt_idx, response_idx, prompt, response: one row each, the last of several in a file wins."""
    rows = jsonl(spark, path, RESPONSE_LOG).select("*", F.monotonically_increasing_id().alias("_at"))
    keys = ["scale", "prompt_idx", "response_idx"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct("prompt", "response"), "_at").alias("r")).select(*keys, "r.*")


def ordered_sets(log: DataFrame) -> DataFrame:
    """scale, prompt_idx, prompt, responses in the order of response_idx."""
    rows = log.groupBy("scale", "prompt_idx").agg(F.min_by("prompt", "response_idx").alias("prompt"), F.array_sort(F.collect_list(F.struct("response_idx", "response"))).alias("r"))
    return rows.select("scale", "prompt_idx", "prompt", F.transform("r", lambda x: x["response"]).alias("responses"))


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed UTF-8 CSV; quoted fields may hold line ends; every column a string, empty ones null."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def response_columns(df: DataFrame) -> list[str]:
    """resp_<number> columns in the order of their numbers."""
    found = [(int(m[1]), c) for c in df.columns if (m := re.fullmatch(r"resp_(\d+)", c))]
    return [c for _, c in sorted(found)]


def unpivot_responses(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k (from 1), response; empty cells give no row."""
    columns = response_columns(df)
    cells = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("k"), F.col(c).alias("response")) for i, c in enumerate(columns)])
    return df.select(*keys, F.explode(cells).alias("r")).select(*keys, "r.*").where(F.col("response").isNotNull())


def typed_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """metric_* and label_* columns as doubles; empty or unreadable cells are null."""
    names = [c for c in df.columns if c.startswith(("metric_", "label_"))]
    return df.select(*keys, *[F.col(c).try_cast("double").alias(c) for c in names])


def keyed(df: DataFrame) -> DataFrame:
    """Adds key: sidecar_key where there is one, else sample_id."""
    first = F.nullif(F.col("sidecar_key"), F.lit("")) if "sidecar_key" in df.columns else F.lit(None).cast("string")
    return df.withColumn("key", F.coalesce(first, F.col("sample_id")))


def sidecar(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """key and the fields of each entry of a JSON map file; keys that start with two underscores are metadata and left out."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{entry}>>")).alias("key", "entry"))
    return rows.where(~F.col("key").startswith("__")).select("key", "entry.*")


def by_file_name(spark: SparkSession, path: str, pattern: str, schema: str, name: str, extract: str) -> DataFrame:
    """JSON-line files that match a glob, with what `extract` finds in their names as column `name`."""
    rows = spark.read.schema(schema).option("pathGlobFilter", pattern).json(path)
    return rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), extract, 1))


def completions(spark: SparkSession, path: str) -> DataFrame:
    """id, prompt, k (from 1), response from Parquet rows with a list of completions."""
    rows = spark.read.parquet(path)
    return rows.select("id", "prompt", F.posexplode("completions").alias("k", "response")).withColumn("k", F.col("k").cast("long") + 1)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed and rows wherever they lie (the sample size is the feature)."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).orderBy(key)


def tagged_lines(spark: SparkSession, path: str, heading: str, row: str, names: list[str]) -> DataFrame:
    """Rows of fixed text tables: regex groups of `row` lines as `names`, with the last heading above as section."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("at", "line"), F.col("_metadata.file_name").alias("file"))
    found = F.regexp_extract("line", heading, 1)
    above = F.last(F.when(found != "", found), ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("section", above).where(F.col("line").rlike(row))
    return rows.select("file", "at", "section", *[F.regexp_extract("line", row, i + 1).alias(n) for i, n in enumerate(names)])


def tensor(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """A nested array column as one row per cell, with an index column per level."""
    out = df.withColumn("_v", F.col(column))
    for name in names:
        out = out.select(*[c for c in out.columns if c != "_v"], F.posexplode("_v").alias(name, "_v"))
    return out.withColumnRenamed("_v", "value").drop(column)


def _tex(spark: SparkSession, path: str) -> DataFrame:
    """path, file name and text of TeX files, comments left out."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").text(path)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"(?m)(?<!\\)%.*$", "").alias("tex"))


def _cited(tex: DataFrame) -> DataFrame:
    keys = tex.select("path", "file", F.explode(F.regexp_extract_all("tex", F.lit(r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))).alias("keys"))
    return keys.select("path", "file", F.explode(F.split("keys", ",")).alias("key")).withColumn("key", F.trim("key")).where("key <> ''").distinct()


def cite_keys(spark: SparkSession, path: str) -> DataFrame:
    r"""file and key of every citation command in TeX files, comments left out."""
    return _cited(_tex(spark, path)).select("file", "key")


def included_files(spark: SparkSession, folder: str, main: str) -> DataFrame:
    r"""path and `found` of the TeX files that main, a file name in folder, reaches by \input and \include, itself included.

    Names are relative to the folder of the file that has them, with or without .tex. Each round follows the files that the round before was the
    first to reach, until there is none, so files that include one another end it as well.
    """
    tex = _tex(spark, folder)
    named = tex.select("path", F.explode(F.regexp_extract_all("tex", F.lit(r"\\(?:input|include)\s*\{([^}]*)\}"), F.lit(1))).alias("name"))
    name = F.regexp_replace(F.trim("name"), r"(\.tex)?$", "")
    to = F.concat(F.regexp_replace("path", "[^/]*$", ""), name, F.lit(".tex"))
    to = F.regexp_replace(to, r"/(\./)+", "/")
    for _ in range(8):  # folders up
        to = F.regexp_replace(to, r"/(?!\.\./)[^/]+/\.\./", "/")
    edges = named.where(F.trim("name") != "").select("path", to.alias("to")).distinct()
    newest = reached = tex.where(F.col("path").endswith(f"/{main}")).orderBy(F.length("path")).limit(1).select("path")
    if newest.isEmpty():
        raise FileNotFoundError(f"no {main} in {folder}")
    while not newest.isEmpty():
        newest = edges.join(newest, "path").select(F.col("to").alias("path")).distinct().join(reached, "path", "left_anti")
        newest = spark.createDataFrame(newest.collect(), reached.schema)  # names of files, a round's worth
        reached = reached.unionByName(newest)
    return reached.join(tex.select("path", F.lit(True).alias("found")), "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"))


def reached_cite_keys(spark: SparkSession, folder: str, main: str) -> DataFrame:
    """file and key of every citation in main and all files that it includes, directly or not; a file that isn't there raises when the table is read."""
    files = included_files(spark, folder, main)
    there = files.where(F.col("found") | F.raise_error(F.concat(F.lit("no file "), F.col("path"))).cast("boolean")).select("path")
    return _cited(_tex(spark, folder)).join(there, "path", "right").where("key IS NOT NULL").select("file", "key")


def bib_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a BibTeX file with the number of entries that carry each."""
    text = spark.read.option("wholetext", True).text(path)
    keys = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*@(?!comment|string|preamble)[a-zA-Z]+\s*\{\s*([^,\s]+)"), F.lit(1))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("entries"))


def per_byte_or_stored(bits: Column, n_bytes: Column, stored: Column) -> Column:
    """Bits over bytes slot by slot where both are there, else the stored curve."""
    ratio = F.zip_with(bits, n_bytes, lambda b, n: F.coalesce(F.try_divide(b, n.cast("double")), F.lit(0.0)))
    return F.coalesce(ratio, stored)
