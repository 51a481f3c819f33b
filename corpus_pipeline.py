"""A corpus from raw documents to packed sequences, in stages that each read what the one before has written."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvox.llm import jaccard, line_dedup, mixing, packing, quality
from polyvox.llm.common import discard, stored
from polyvox.llm.queries import tokenizer_path

WEIGHTS = mixing.WEIGHTS


def _column(name: str) -> Column:
    """The column of that very name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _file_order(file: str) -> tuple[int, str]:
    """Files in the order in which they were written: part-100000 comes after part-99999."""
    number = re.match(r"part-(\d+)", file)
    return int(number[1]) if number else -1, file


def _documents(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, from struct `doc`, with the text of a column in place of its own where it differs."""
    out = docs.select("doc.*", F.col(text).alias("_new_text")) if text != "text" else docs
    changed = ~F.col("text").eqNullSafe(F.col("_new_text"))
    fields = docs.schema["doc"].dataType.names
    values = {
        "text": F.col("_new_text"),
        "n_chars": F.when(changed, F.char_length("_new_text").cast("long")).otherwise(F.col("n_chars")),
    }
    return out.select(*(values.get(name, _column(name)).alias(name) for name in fields))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the quality rules reject go.

    Rows are judged one by one: repeated rows, and rows with a null or repeated id, alike. A null text has no words, so its row goes.
    n_chars follows the text where that has changed, as in all stages.
    """
    return _documents(quality.quality(docs).where("kept"), "cleaned")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the document stays, if with an empty text.

    A row without an id loses no line and takes none from others; rows of one id count as one document. A null text stays null.
    """
    return _documents(line_dedup.line_dedup(docs), "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies stays, as do rows without an id.

    Rows that share an id stay or go together; rows with an empty or null text are in no group and stay.
    """
    found = jaccard.jaccard_components(docs).select("doc_id", "component_id").distinct()
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*map(_column, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the mix, which is that of the files' names and of the rows within a file.

    Every row comes out once, repeated rows too; a null source is a source of its own.
    """
    mixed = mixing.mix(docs, WEIGHTS)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences, which follow the order of docs, read from files.

    Null texts are empty ones; rows with null or repeated ids are packed as documents of their own.
    """
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    start, starts = 0, []
    for r in sorted(rows.groupBy("file").agg((F.max("row") + 1).alias("n")).collect(), key=lambda r: _file_order(r["file"])):
        starts.append((r["file"], start))
        start += r["n"]
    files = F.broadcast(spark.createDataFrame(starts, "file string, start long"))
    placed = rows.join(files, "file").select("doc_id", "text", (F.col("start") + F.col("row")).alias("position"))
    return packing.pack_in_order(placed, tokenizer_path(), "position")


STAGES = [
    ("quality rules", clean),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: The last stage needs a tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again. An empty table gives an empty result.

    The table of a stage is deleted when the next one's is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage{number}")
            if number:
                discard(before)
    return docs
