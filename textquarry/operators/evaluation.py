"""Evaluation runs: questions with answers, model comparison, sampled answers, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import cap
from textquarry.operators.ordered import number_rows, whole_quotient
from textquarry.operators.sampling import every_nth

RULE = "=" * 70
THIN_RULE = "-" * 70


def question_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers with their question, matched on ``q``."""
    return answers.join(questions, "q")


def compare_models(base: DataFrame, tuned: DataFrame, keys: Sequence[str] = ("q",)) -> DataFrame:
    """Both models' answers side by side; a question only one answered keeps a null."""
    keys = list(keys)
    left = base.select(*keys, F.col("answer").alias("base_answer"))
    right = tuned.select(*keys, F.col("answer").alias("finetuned_answer"))
    return left.join(right, keys, "full")


def padded(number: Column | str, width: int = 3, fill: str = "0") -> Column:
    """``%03d`` and the like; wider numbers stay whole."""
    number = F.col(number) if isinstance(number, str) else number
    return F.format_string(f"%{fill if fill == '0' else ''}{width}d", number)


def sampled_answers(
    results: DataFrame, keys: Sequence[str] = (), nth: int = 5, limit: int = 600
) -> DataFrame:
    """``(keys, pos, line)``: every ``nth`` result in ``q`` order, its answer capped."""
    numbered = number_rows(results, "q", "_row", keys)
    kept = every_nth(numbered, "_row", nth)
    line = F.concat(
        F.lit("Q"), padded("q"), F.lit(": "), "question", F.lit("\nA: "), cap("answer", limit)
    )
    place = whole_quotient(F.col("_row") - 1, nth) + 1
    return kept.select(*keys, place.alias("pos"), line.alias("line"))


def closed_book_blocks() -> Column:
    """Report block of a closed-book result."""
    return F.concat(
        F.lit("Q"), padded("q"), F.lit(". "), "question", F.lit(f"\n{THIN_RULE}\n"), "answer",
        F.lit("\n"),
    )


def open_book_blocks() -> Column:
    """Report block of an open-book result."""
    return F.concat(
        F.lit("Row "), padded("row"), F.lit(". "), "question",
        F.lit("\n[Context: "), F.col("context_length").cast("string"), F.lit(" words]\n"),
        F.lit(f"{THIN_RULE}\n"), "answer", F.lit("\n"),
    )


def closed_book_header(
    label: Column | str, answered: Column, total: Column, title: str = "BATCH TEST RESULTS"
) -> Column:
    """Head of a closed-book report."""
    return F.concat(
        F.lit(f"{title}\nModel: "), label, F.lit("\nQuestions answered: "), answered,
        F.lit("/"), total, F.lit(f"\n{RULE}\n"),
    )


def open_book_header(
    label: Column | str,
    answered: Column,
    total: Column,
    source: str = "",
    title: str = "RAG EVALUATION RESULTS",
) -> Column:
    """Head of an open-book report, with the input's name."""
    return F.concat(
        F.lit(f"{title}\nModel  : "), label, F.lit(f"\nInput  : {source}\nRows answered: "),
        answered, F.lit("/"), total, F.lit(f"\n{RULE}\n"),
    )


def closed_book_report(
    results: DataFrame,
    total: DataFrame,
    label: Column | str,
    keys: Sequence[str] = (),
    title: str = "BATCH TEST RESULTS",
) -> DataFrame:
    """``(keys, pos, text)``: header at 0, then one block per result at its ``q``.

    ``total`` is a one-row table with the number of questions. Lines stay rows, so a report of any
    length is sorted and written by many tasks.
    """
    header = closed_book_header(label, F.col("answered"), F.col("total"), title)
    return _report(results, total, header, closed_book_blocks(), "q", keys)


def round_report(results: DataFrame, keys: Sequence[str] = ("run_id", "round")) -> DataFrame:
    """``(keys, pos, text)``: variant for tuning rounds, whose title carries no counts.

    ``results`` holds ``(keys, q, question, answer)``, the last key being the round.
    """
    header = F.concat(
        F.lit("ROUND "), F.col(keys[-1]).cast("string"),
        F.lit(f" — BENCHMARK ANSWERS\n{RULE}\n"),
    )
    head = results.select(*keys).distinct().select(
        *keys, F.lit(0).cast("bigint").alias("pos"), header.alias("text")
    )
    return head.unionByName(
        results.select(*keys, F.col("q").alias("pos"), closed_book_blocks().alias("text"))
    )


def open_book_report(
    results: DataFrame,
    total: DataFrame,
    label: Column | str,
    source: str,
    keys: Sequence[str] = (),
    title: str = "RAG EVALUATION RESULTS",
) -> DataFrame:
    """As ``closed_book_report`` with the input's name and each context's length."""
    header = open_book_header(label, F.col("answered"), F.col("total"), source, title)
    return _report(results, total, header, open_book_blocks(), "row", keys)


def _report(
    results: DataFrame,
    total: DataFrame,
    header: Column,
    block: Column,
    position: str,
    keys: Sequence[str],
) -> DataFrame:
    counts = results.groupBy(*keys).agg(F.count("*").cast("string").alias("answered"))
    counts = counts.withColumn("total", total.scalar().cast("string"))
    head = counts.select(*keys, F.lit(0).cast("bigint").alias("pos"), header.alias("text"))
    body = results.select(*keys, F.col(position).alias("pos"), block.alias("text"))
    return head.unionByName(body)
