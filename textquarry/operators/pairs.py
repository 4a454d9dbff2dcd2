"""From model responses to question-answer rows, and resuming without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.parsing import exploded_pairs, salvage_error, with_pairs


def responses(ledger: DataFrame) -> DataFrame:
    """Ledger rows with salvaged error bodies read as responses."""
    return ledger.withColumn(
        "response", F.coalesce(F.col("response"), salvage_error("error_body"))
    )


def parsed_documents(docs: DataFrame, ledger: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each asked document with ``response``, ``pairs`` and ``strategy``.

    ``docs`` and ``ledger`` hold a document once. The response is null when every try failed.
    """
    answered = responses(ledger).select(key, "response")
    return with_pairs(docs.join(answered, key, "left"))


def enriched_pairs(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per pair with its document's metadata; ``source`` is the citation."""
    metadata = (F.col("citation").alias("source"), "jurisdiction", "type")
    rows = exploded_pairs(parsed, key, *metadata)
    return rows.select(key, "pair_no", "pair.*", "source", "jurisdiction", "type")


def run_counters() -> list[Column]:
    """Aggregates over parsed documents, for ``agg`` or ``observe``."""
    no_response = F.col("response").isNull()
    return [
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("total_pairs"),
        F.count_if(no_response).alias("no_response"),
        F.count_if(~no_response & (F.size("pairs") == 0)).alias("unparsed"),
        F.count_if(F.size("pairs") == 0).alias("errors"),
    ]


def unanswered(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with no row in ``done``.

    Keys are made distinct before the join, so a key that fills much of ``done`` is folded where
    it is read, and the join reuses that shuffle.
    """
    return docs.join(done.select(key).distinct(), key, "left_anti")


def merge_results(old: DataFrame, new: DataFrame, key: str = "q") -> DataFrame:
    """Union of both runs with one row per key; a repeated key takes the new row."""
    return new.unionByName(unanswered(old, new, key))


def progress(
    done: Column | str, total: Column | str, skipped: Column | str, minutes: Column | str
) -> list[Column]:
    """Documents per minute and minutes left; zero when nothing is known yet."""
    done, total, skipped, minutes = [
        F.col(c) if isinstance(c, str) else c for c in (done, total, skipped, minutes)
    ]
    rate = F.when(minutes > 0, (done - skipped) / minutes).otherwise(F.lit(0.0))
    left = F.when(rate > 0, (total - done) / rate).otherwise(F.lit(0.0))
    return [rate.alias("docs_per_minute"), left.alias("minutes_left")]
