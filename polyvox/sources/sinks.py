"""Sinks: resumable appends, enriched tables, nested documents, dead letters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvox.operators.length import skip_rate_guard
from polyvox.operators.tables import rename_tagged


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that append_new has committed to path."""
    return spark.read.parquet(path).drop("batch")


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Adds the rows whose key no batch at path has yet, and gives back their keys. Read the table by `appended`.

    A batch is written to a folder that readers don't see and becomes part of the table by one rename, so a write that stops half-way leaves nothing
    behind that is read, and running it again writes what is missing. Null keys are keys like others. Of rows of df that share a key, one
    is written. Two writers at once may both add a key. Needs a file system whose renames are whole, as HDFS and local ones are.
    """
    spark = df.sparkSession
    of = lambda rows: F.struct(F.lit(0), *[rows[k] for k in keys])
    fresh = df.dropDuplicates(list(keys))
    try:
        done = appended(spark, path).select(*keys)
        fresh = fresh.join(done, of(fresh) == of(done), "left_anti")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    name = uuid.uuid4().hex
    staged, batch = f"{path}/_staged/{name}", f"{path}/batch={name}"
    fresh.write.parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(hadoop(staged), hadoop(batch)):
        raise OSError(f"could not commit {batch}")
    return spark.read.schema(fresh.schema).parquet(batch).select(*keys)


def split_skips(df: DataFrame, reason: Column, path: str, skips: str, most: float = 0.1) -> None:
    """Rows without a reason go to path, the others with it to skips; more skips than `most` of the rows is an error before either."""
    marked = df.withColumn("reason", reason)
    checked = skip_rate_guard(marked, F.col("reason").isNotNull(), most)
    checked.where("reason is null").drop("reason").write.mode("overwrite").parquet(path)
    checked.where("reason is not null").write.mode("overwrite").parquet(skips)


def enriched_csv(df: DataFrame, scores: DataFrame, key: str, tag: str, columns: Mapping[str, str], path: str, digits: int = 6) -> None:
    """df with its scores as metric_<name>_<tag> columns of fixed decimals; those of an earlier run with this tag are replaced."""
    fixed = scores.select(key, *[F.format_string(f"%.{digits}f", F.col(old)).alias(old) for old in columns])
    fresh = [f"metric_{new}_{tag}" for new in columns.values()]
    out = rename_tagged(df.drop(*fresh).join(fixed, key, "left"), tag, columns)
    out.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def nested_json(scores: DataFrame, scale: str, prompt: str, values: Sequence[str], path: str) -> None:
    """One JSON object per scale: the means of its prompts' values, and each prompt's own."""
    rows = scores.groupBy(scale).agg(
        F.array_sort(F.collect_list(F.struct(prompt, *values))).alias("per_prompt"), F.struct(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in values]).alias("aggregate")
    )
    rows.write.mode("overwrite").json(path)


def full_and_light(df: DataFrame, light: Sequence[str], path: str, light_path: str) -> None:
    """All columns at path, a narrow projection at light_path."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).select(*light).write.mode("overwrite").parquet(light_path)


def latex_rows(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Each row as a line of a LaTeX table: doubles with fixed digits, missing values as dashes."""
    types = dict(df.dtypes)
    cells = [F.when(F.col(c).isNull(), "--").otherwise(F.format_string(f"%.{digits}f", F.col(c)) if types[c] == "double" else F.col(c).cast("string")) for c in columns]
    return df.select(F.concat(F.array_join(F.array(*cells), " & "), F.lit(r" \\")).alias("line"))


def splice(document: str, name: str, block: str) -> str:
    """document with what stands between the markers of `name` replaced; without markers it is an error."""
    start, end = f"<!-- BEGIN {name} -->", f"<!-- END {name} -->"
    head, found, rest = document.partition(start)
    _, closed, tail = rest.partition(end)
    if not found or not closed:
        raise ValueError(f"no markers for {name}")
    return f"{head}{start}\n{block}\n{end}{tail}"


def manifest(fields: Mapping[str, object], write: Callable[[str], object]) -> None:
    """An experiment's description as sorted JSON."""
    write(json.dumps(fields, indent=2, sort_keys=True, ensure_ascii=False))
