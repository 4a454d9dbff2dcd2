"""Streaming jobs run to the end over files written from the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import templates
from textquarry.functions.text import word_count
from textquarry.plans.preparation import CHUNK_WORDS, SHORTEST, sql_truncated
from textquarry.plans.registry import corpus, query, sql_render, sql_words, table
from textquarry.session import staging_path
from textquarry.streaming import jobs


def measure(prompt: str) -> str:
    """Stands for a model: one pair that tells the prompt's length."""
    pair = {"question": "How long is the prompt?", "answer": f"{len(prompt)} characters"}
    return json.dumps([pair])


@query(
    "t_stream_generation",
    f"""SELECT doc_id, 'How long is the prompt?' AS question,
               length({sql_render(templates.QA_GENERATION, n="'3'",
                                  text=sql_truncated("text", CHUNK_WORDS))}) || ' characters'
                   AS answer,
               source, lang AS jurisdiction, 'Unknown' AS type
        FROM documents WHERE len({sql_words("text")}) >= {SHORTEST}""",
)
def stream_generation(spark, sf_dir) -> DataFrame:
    """Documents that arrive as files, asked about and parsed inside the stream."""
    source, output, ledger, check = (
        staging_path(spark, name) for name in ("arrivals", "pairs", "ledger", "checkpoint")
    )
    corpus(spark, sf_dir).write.json(source)
    jobs.stream_generation(
        spark, source, measure, output, ledger, check, commits=2, max_words=CHUNK_WORDS
    ).awaitTermination()
    schema = "doc_id bigint, question string, answer string, source string, jurisdiction string, type string"
    return spark.read.schema(schema).json(f"{output}/batch=*")


RULE, THIN = "=" * 70, "-" * 70


@query(
    "k_streamed_report",
    f"""SELECT 0 AS pos, 'RAG EVALUATION RESULTS' || chr(10) || 'Model  : base' || chr(10)
               || 'Input  : documents' || chr(10) || 'Rows answered: ' || count(*) || '/'
               || count(*) || chr(10) || '{RULE}' || chr(10) AS text FROM documents
        UNION ALL
        SELECT doc_id + 1, printf('Row %03d. ', doc_id + 1) || 'What is in it?' || chr(10)
               || '[Context: ' || len({sql_words("text")}) || ' words]' || chr(10) || '{THIN}'
               || chr(10) || text || chr(10) FROM documents""",
)
def streamed_report(spark, sf_dir) -> DataFrame:
    """Open-book results that arrive as files, saved by batch into a report that is then closed."""
    source, output, check = (staging_path(spark, n) for n in ("arrivals", "results", "checkpoint"))
    docs = table(spark, sf_dir, "documents")
    results = docs.select(
        (F.col("doc_id") + 1).alias("row"),
        F.lit("What is in it?").alias("question"),
        word_count("text").cast("bigint").alias("context_length"),
        F.col("text").alias("answer"),
    )
    results.write.json(source)
    jobs.stream_results(spark, source, output, check, jobs.OPEN_BOOK).awaitTermination()
    total = docs.count()
    jobs.close_report(spark, output, total, "base", jobs.OPEN_BOOK, source="documents")
    return jobs.streamed_report(spark, output, jobs.OPEN_BOOK)
