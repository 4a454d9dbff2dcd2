"""The corpus pipeline: each stage reads what the one before wrote.

So what the operators of earlier stages stored for themselves goes when a stage begins. In every stage
rows that repeat are treated alike, nulls in columns that it does not read pass through, and columns
beyond those of ``documents`` stay, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from textquarry.llm.tables import Scratch, prepare, table


def _begin(spark: SparkSession, first: bool = False) -> SparkSession:
    if first:
        Scratch.forget()  # what other queries stored is theirs
    else:
        Scratch.release()
    return prepare(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those the models reject go.

    Texts that are null or hold no letter are rejected; of languages that fit equally well the first
    by name is taken. Rows without a lang teach nothing.
    """
    _begin(spark, first=True)
    return language_id.recognised(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those left without a word go.

    A document that held no word before stays, a null text too. n_chars follows the text.
    """
    _begin(spark)
    cut = line_dedup.without_later_copies(docs)
    cut = cut.where("n_removed = 0 OR text <> ''")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
    return cut.withColumn("n_chars", F.coalesce(n_chars, "n_chars")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id.

    Rows that share that id all stay, as do rows without an id and texts without a word or null.
    """
    _begin(spark)
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; empty and null texts hold none."""
    return decontamination.without_leaks(docs, table(_begin(spark), sf_dir, "benchmark"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into windows.

    An empty or null text is its end id alone; pieces of equal length may stand in either's place.
    """
    _begin(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark),
    ("packing", windows),
]
# Models, edit distances and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing each one's result as Parquet in between."""
    docs = table(prepare(spark), sf_dir, "documents")
    scratch = Scratch(spark, "pipeline", lasting=True)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
