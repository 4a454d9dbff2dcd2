"""Streaming forms of the save-as-you-go steps.

Each job handles the files that are new since its checkpoint and stops; starting it again is the
resume. The checkpoint folder must be shared by all executors, as the output folder is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry import schemas
from textquarry.functions.parsing import with_pairs
from textquarry.operators import completion, evaluation
from textquarry.operators.pairs import (
    enriched_pairs,
    parsed_documents,
    responses,
    run_counters,
    unanswered,
)
from textquarry.operators.prepare import qa_prompts, with_defaults
from textquarry.session import hadoop, stage

DOCUMENT = f"doc_id bigint, {schemas.CORPUS}"
ANSWERED = f"{DOCUMENT}, response string, error_body string"
COUNTERS = (
    "documents bigint, total_pairs bigint, no_response bigint, unparsed bigint, errors bigint"
)


def _new_files(
    spark: SparkSession, path: str, schema: str, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)


def _append(rows: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("json")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _each_batch(
    rows: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` came to its end."""
    marker, fs = hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def _commit(rows: DataFrame, path: str, form: str = "json") -> None:
    """Write a folder as a whole: what an earlier, broken try left there goes."""
    marked = rows.write.mode("overwrite").option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true"
    )
    marked.format(form).save(path)


def stream_prompts(
    spark: SparkSession, documents: str, output: str, checkpoint: str, **options
) -> StreamingQuery:
    """Documents as they arrive to generation prompts."""
    prompts = qa_prompts(_new_files(spark, documents, DOCUMENT), **options)
    return _append(prompts.select("doc_id", "prompt"), output, checkpoint)


def stream_pairs(
    spark: SparkSession, answered: str, output: str, checkpoint: str
) -> StreamingQuery:
    """Documents with their response to question-answer rows, each written exactly once."""
    documents = with_defaults(responses(_new_files(spark, answered, ANSWERED)))
    pairs = enriched_pairs(with_pairs(documents))
    return _append(pairs.drop("pair_no"), output, checkpoint)


def stream_generation(
    spark: SparkSession,
    documents: str,
    completer: Callable[[str], str],
    output: str,
    ledger: str,
    checkpoint: str,
    max_words: int = 800,
    pairs_per_doc: int = 3,
    commits: int = 8,
    max_files: int | None = None,
    **options,
) -> StreamingQuery:
    """Documents as they arrive to answered and parsed question-answer rows.

    A micro-batch first asks the model: its answers go to ``ledger/batch=<id>`` in ``commits``
    commits. Then it writes the pairs to ``output/batch=<id>`` and the run's counters to
    ``ledger_counters/batch=<id>``, both from the ledger. A batch that was stopped is replayed with
    the same id and documents and finds its finished commits, so no answered call is repeated beyond
    the commit it was in, no pair is lost, and none is written twice. ``max_files`` bounds a batch,
    ``options`` go to ``completion.complete``. A document asked about in an earlier batch, in another
    file, is not asked again, unless its every try failed; ``retry_failed`` asks those alone.
    """
    ledger = ledger.rstrip("/")

    def save(batch: DataFrame, batch_id: int) -> None:
        earlier = answered_documents(spark, ledger).where(F.col("batch") < batch_id)
        fresh = unanswered(batch.dropDuplicates(["doc_id"]), earlier)
        asked = stage(qa_prompts(fresh, max_words, pairs_per_doc), "asked")
        _ask_and_save(asked, completer, output, ledger, batch_id, commits, options)

    source = _new_files(spark, documents, DOCUMENT, max_files)
    return _each_batch(source, save, checkpoint)


def _ask_and_save(
    asked: DataFrame,
    completer: Callable[[str], str],
    output: str,
    ledger: str,
    batch: int,
    commits: int,
    options: dict,
) -> dict[str, int]:
    """Fill what is missing of a batch's ledger, then write its pairs and counters from there."""
    spark, own = asked.sparkSession, f"{ledger}/batch={batch}"
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(commits))
    for commit in range(commits):
        path = f"{own}/commit={commit}"
        if not _committed(spark, path):
            answers = completion.complete(asked.where(slot == commit), completer, **options)
            _commit(answers, path, "parquet")
    answers = spark.read.schema(schemas.COMPLETION).parquet(f"{own}/commit=*")
    counters = Observation()
    parsed = parsed_documents(asked.drop("prompt"), answers).observe(counters, *run_counters())
    _commit(enriched_pairs(parsed).drop("pair_no"), f"{output.rstrip('/')}/batch={batch}")
    counted = spark.createDataFrame([counters.get], COUNTERS)
    _commit(counted, f"{ledger}_counters/batch={batch}")
    return counters.get


def _ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """Every row of the ledger with its batch, from finished commits only."""
    pattern, fs = hadoop(spark, f"{ledger.rstrip('/')}/batch=*/commit=*/_SUCCESS")
    paths = [s.getPath().getParent().toString() for s in fs.globStatus(pattern) or []]
    schema = f"{schemas.COMPLETION}, batch bigint"
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schemas.COMPLETION).parquet(*paths)
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(-?\d+)/commit=", 1)
    return rows.select("*", batch.cast("bigint").alias("batch"))


def answered_documents(spark: SparkSession, ledger: str) -> DataFrame:
    """``(doc_id, response, error_body, batch)`` of the documents that have an answer so far."""
    return _ledger_rows(spark, ledger).where("response IS NOT NULL OR error_body IS NOT NULL")


def retry_failed(
    spark: SparkSession,
    documents: DataFrame,
    completer: Callable[[str], str],
    output: str,
    ledger: str,
    max_words: int = 800,
    pairs_per_doc: int = 3,
    **options,
) -> int:
    """Ask again for the documents of the ledger that have no answer yet; returns their number.

    ``documents`` holds them among others. Answers and pairs become a batch of their own, counted
    down from -1, so that the numbers of the stream's batches stay free.
    """
    ledger = ledger.rstrip("/")
    rows = _ledger_rows(spark, ledger)
    missing = unanswered(rows.select("doc_id").distinct(), answered_documents(spark, ledger))
    chosen = documents.join(missing, "doc_id", "left_semi")
    asked = stage(qa_prompts(chosen, max_words, pairs_per_doc), "asked")
    pattern, fs = hadoop(spark, f"{ledger}/batch=-*")
    batch = -1 - len(fs.globStatus(pattern) or [])
    return _ask_and_save(asked, completer, output, ledger, batch, 1, options)["documents"]


def generation_counters(spark: SparkSession, ledger: str) -> DataFrame:
    """One row: the counters of all batches of ``stream_generation`` and ``retry_failed``."""
    batches = spark.read.schema(COUNTERS).json(f"{ledger.rstrip('/')}_counters/batch=*")
    return batches.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in batches.columns]
    )


@dataclass(frozen=True)
class Book:
    """What distinguishes the two kinds of evaluation: rows, their number, blocks and report."""

    schema: str
    position: str
    block: Callable[[], Column]
    header: Callable[..., Column]


CLOSED_BOOK = Book(
    schemas.CLOSED_RESULT, "q", evaluation.closed_book_blocks, evaluation.closed_book_header
)
OPEN_BOOK = Book(
    schemas.OPEN_RESULT, "row", evaluation.open_book_blocks, evaluation.open_book_header
)


def stream_results(
    spark: SparkSession,
    results: str,
    output: str,
    checkpoint: str,
    book: Book = CLOSED_BOOK,
    max_files: int | None = None,
) -> StreamingQuery:
    """Evaluation results saved batch by batch, as JSON lines and as report blocks.

    A batch overwrites its own folder, so one that is replayed after a failure leaves no repeats.
    ``close_report`` adds the header once all are in.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        _commit(kept, f"{output}/results/batch={batch_id}")
        blocks = kept.select(book.position, book.block().alias("text")).orderBy(book.position)
        _commit(blocks.select("text"), f"{output}/report/batch={batch_id}", "text")
        kept.unpersist()

    return _each_batch(_new_files(spark, results, book.schema, max_files), save, checkpoint)


def close_report(
    spark: SparkSession,
    output: str,
    total: int,
    label: str,
    book: Book = CLOSED_BOOK,
    **options,
) -> int:
    """Write the header of a streamed report to ``output/header``; returns the results it counts.

    It can be closed again after more batches. ``options`` go to the header: its title, or the name
    of the input of an open-book evaluation.
    """
    saved = spark.read.schema(book.schema).json(f"{output}/results/batch=*")
    answered = saved.select(book.position).distinct().count()
    header = book.header(
        F.lit(label), F.lit(str(answered)), F.lit(str(total)), **options
    )
    _commit(spark.range(0, 1, 1, 1).select(header.alias("text")), f"{output}/header", "text")
    return answered


def streamed_report(spark: SparkSession, output: str, book: Book = CLOSED_BOOK) -> DataFrame:
    """``(pos, text)``: the closed report in order, from the header and the saved results.

    Of results that came twice, the one of the later batch counts.
    """
    head = spark.read.text(f"{output}/header", wholetext=True)
    saved = spark.read.schema(book.schema).json(f"{output}/results/batch=*")
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("bigint")
    newest = saved.select("*", batch.alias("_batch")).groupBy(book.position).agg(
        F.max_by(F.struct(*[c for c in saved.columns if c != book.position]), "_batch").alias("r")
    )
    rows = newest.select(book.position, "r.*")
    body = rows.select(F.col(book.position).alias("pos"), book.block().alias("text"))
    # The text writer closed the header with one more line end.
    text = F.regexp_replace("value", r"\n\z", "").alias("text")
    return head.select(F.lit(0).cast("bigint").alias("pos"), text).unionByName(body)
