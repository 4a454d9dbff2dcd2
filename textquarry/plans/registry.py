"""Registered queries and the SQL that states their expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.prompts import split_template
from textquarry.functions.text import not_blank
from textquarry.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` under the corpus column names; it has no ``type``."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("citation"), F.col("lang").alias("jurisdiction")
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` without system messages, which a chat history never holds."""
    return table(spark, sf_dir, "conversations").where(F.col("role") != "system")


def answer_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read as an answer: sheets of as many answers as there are questions."""
    n = table(spark, sf_dir, "benchmark").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "documents").select(
        F.call_function("div", F.col("doc_id"), n).alias("run_id"),
        (F.col("doc_id") % n + 1).alias("q"),
        F.col("text").alias("answer"),
        F.col("lang").alias("model"),
    )


def non_blank(docs: DataFrame) -> DataFrame:
    return docs.where(not_blank("text"))


# SQL building blocks. Stored texts hold ASCII whitespace only, so these short forms suffice.

SQL_SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {SQL_SPACES})"


def sql_words(expression: str) -> str:
    return rf"list_filter(string_split_regex({expression}, '\s+'), lambda w: w <> '')"


def sql_tokens(expression: str) -> str:
    return rf"regexp_extract_all({expression}, '\s*\S+')"


def sql_render(template: str, **fields: str) -> str:
    pieces = []
    for literal, field in split_template(template):
        if literal:
            pieces.append(sql_text(literal))
        if field is not None:
            pieces.append(f"({fields[field]})")
    return " || ".join(pieces)


SQL_SHEETS = """
    SELECT doc_id // n AS run_id, doc_id % n + 1 AS q, text AS answer, lang AS model
    FROM documents, (SELECT count(*) AS n FROM benchmark)
"""
SQL_QUESTIONS = "SELECT row_number() OVER (ORDER BY item_id) AS q, text AS question FROM benchmark"
