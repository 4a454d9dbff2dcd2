"""Whole jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textquarry import schemas
from textquarry.functions import prompts
from textquarry.functions.text import clean, not_blank, strip, word_count
from textquarry.functions.tokens import EOS, encode_document
from textquarry.operators import completion, pairs, prepare, rounds
from textquarry.operators.packing import pack_sequences
from textquarry.operators.sampling import seeded_sample
from textquarry.session import hadoop, stage
from textquarry.sources.corpus import (
    latest_snapshot_path,
    preferred_source,
    scan_corpus,
    scan_directory,
    with_doc_ids,
)
from textquarry.sources.sinks import write_pairs
from textquarry.sources.tiers import BOUNDS, PACKED_LENGTH, TIERS


def generate_pairs(
    docs: DataFrame,
    completer: Callable[[str], str],
    output: str,
    ledger: str,
    count: int = 5_000,
    seed: int = 42,
    resume: bool = False,
    max_words: int = 800,
    pairs_per_doc: int = 3,
    commits: int = 8,
    **options,
) -> dict[str, int]:
    """Sample documents, ask for pairs, write the parsed pairs; returns the run's counters.

    Answers go to the ``ledger`` table in ``commits`` commits, so a lost job repeats the calls of one
    of them at most. Pairs are parsed from the ledger: each run writes one folder ``batch=<n>`` of
    ``output`` and then notes its documents beside the ledger. Resuming asks for the documents that
    have no answer yet, those whose every try failed among them, and parses all answers not noted;
    a run stopped in between is written over, so no pair is lost or doubled.
    """
    spark = docs.sparkSession
    noted = f"{ledger.rstrip('/')}_parsed"
    if not resume:
        for path in (ledger, noted, output):
            hadoop_path, fs = hadoop(spark, path)
            fs.delete(hadoop_path, True)
    asked = prepare.qa_prompts(seeded_sample(docs, count, seed), max_words, pairs_per_doc)
    asked = stage(pairs.unanswered(asked, _answered(spark, ledger)), "asked")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(commits))
    for commit in range(commits):
        part = asked.where(slot == commit)
        completion.complete(part, completer, **options).write.mode("append").parquet(ledger)

    seen = _table(spark, noted, "doc_id bigint, batch bigint")
    batch = (seen.agg(F.max("batch")).first()[0] or 0) + 1
    answers = pairs.unanswered(_answered(spark, ledger), seen)
    new = answers.select("doc_id").union(asked.select("doc_id")).distinct()
    documents = prepare.with_defaults(docs).join(new, "doc_id", "left_semi")
    counters = Observation("pair generation")
    parsed = pairs.parsed_documents(documents, answers).observe(counters, *pairs.run_counters())
    write_pairs(pairs.enriched_pairs(parsed), f"{output.rstrip('/')}/batch={batch}", False)
    done = answers.select("doc_id", F.lit(batch).cast("bigint").alias("batch"))
    done.write.mode("append").parquet(noted)
    return counters.get


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, empty while nothing has been written there."""
    hadoop_path, fs = hadoop(spark, path)
    if not fs.exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _answered(spark: SparkSession, ledger: str) -> DataFrame:
    """Ledger rows that hold an answer, one per document."""
    rows = _table(spark, ledger, schemas.COMPLETION)
    return rows.where("response IS NOT NULL OR error_body IS NOT NULL").dropDuplicates(["doc_id"])


def _ask(asked: DataFrame, completer: Callable[[str], str], key: str, options: dict) -> DataFrame:
    """Rows with the answer they got; a row whose every try failed is left for the next run."""
    ledger = completion.completion_ledger(asked, completer, key=key, **options)
    answers = pairs.responses(ledger).select(key, F.col("response").alias("answer"))
    return asked.drop("prompt").join(answers.where(F.col("answer").isNotNull()), key)


def closed_book_evaluation(
    questions: DataFrame,
    completer: Callable[[str], str],
    start: int = 1,
    earlier: DataFrame | None = None,
    prompt: Callable[[str], Column] = prompts.closed_book,
    **options,
) -> DataFrame:
    """``(q, question, answer)`` for numbered questions from ``start`` on, merged with ``earlier``."""
    asked = prepare.start_row(questions.select("q", "question"), start, "q")
    results = _ask(asked.withColumn("prompt", prompt("question")), completer, "q", options)
    return pairs.merge_results(earlier, results) if earlier is not None else results


def open_book_evaluation(
    rows: DataFrame,
    completer: Callable[[str], str],
    start: int = 1,
    earlier: DataFrame | None = None,
    **options,
) -> DataFrame:
    """``(row, question, context_length, answer)`` for rows with ``question`` and ``context``."""
    asked = prepare.start_row(rows, start).select(
        "row",
        clean("question").alias("question"),
        word_count("context").cast("bigint").alias("context_length"),
        prompts.open_book("question", "context").alias("prompt"),
    )
    results = _ask(asked, completer, "row", options)
    return pairs.merge_results(earlier, results, "row") if earlier is not None else results


def review_rounds(
    losses: DataFrame,
    proposals: DataFrame,
    results: DataFrame,
    budget: int,
    bounds: rounds.Bounds = BOUNDS,
) -> DataFrame:
    """Review prompt of every round, its answers shortened as far as ``budget`` needs.

    The round under review needs a proposal row too, for its settings; its response may be null.
    """
    outcome = rounds.with_round_history(rounds.with_outcome(losses, proposals, bounds))
    reviews = rounds.round_reviews(losses, outcome, results, bounds)
    return rounds.fit_budget(reviews, rounds.ROUND, budget)


def pretraining_set(
    docs: DataFrame,
    tier: str = "8gb",
    length: int | None = None,
    eos: str = EOS,
    longer_than: int = 10,
    **options,
) -> DataFrame:
    """Cleaned texts packed into sequences of the tier's length, in ``doc_id`` order.

    Another ``length`` replaces the tier's; ``options`` go to ``pack_sequences``.
    """
    kept = prepare.clean_eos(docs, eos, longer_than)
    # Packing closes each document with the end token itself.
    texts = prepare.without_eos(kept, eos)
    options.setdefault("encode", partial(encode_document, eos=eos))
    return pack_sequences(texts, length or PACKED_LENGTH[tier], **options)


def raw_corpus(
    spark: SparkSession, directory: str | None = None, versions: str | None = None
) -> DataFrame:
    """Texts of a raw corpus: the JSONL and TXT files of ``directory``, else the newest snapshot.

    ``versions`` holds a folder per snapshot, named by its number, each with ``corpus.jsonl``. The
    folders are listed and only the newest one that holds such a file is read.
    """
    if directory is not None:
        return scan_directory(spark, directory)
    newest = latest_snapshot_path(spark, versions) if versions is not None else None
    if newest is None:
        raise FileNotFoundError(f"no snapshot with a corpus.jsonl in {versions}")
    return scan_corpus(spark, newest).select("text")


def raw_corpus_set(
    spark: SparkSession,
    directory: str | None = None,
    versions: str | None = None,
    tier: str = "8gb",
    **options,
) -> tuple[DataFrame, Observation]:
    """The raw corpus cleaned and packed, and what was loaded and kept.

    Texts are numbered in reading order and stored once, after cleaning, with the number of them
    counted on the way; ``options`` go to ``pretraining_set``. The observation holds ``loaded`` and
    ``cleaned`` rows.
    """
    counts = Observation()
    longer_than, eos = options.get("longer_than", 10), options.get("eos", EOS)
    kept = not_blank("text") & (F.length(strip("text")) + len(eos) > longer_than)
    texts = raw_corpus(spark, directory, versions)
    seen = texts.select("text", F.coalesce(kept, F.lit(False)).alias("kept")).observe(
        counts, F.count("*").alias("loaded"), F.count_if("kept").alias("cleaned")
    )
    docs = with_doc_ids(seen.where("kept").select("text"))
    return pretraining_set(docs, tier, **options), counts


def fine_tuning_set(
    spark: SparkSession, pairs_path: str, corpus_path: str, tier: str, eos: str = EOS
) -> DataFrame:
    """Training texts from the pair file when it exists, else from the corpus."""
    kind, rows = preferred_source(spark, pairs_path, corpus_path)
    if kind == "pairs":
        return prepare.training_pairs(rows, eos).select("text")
    limit = TIERS[tier]["token_truncation_length"]
    return prepare.training_documents(rows, limit, eos).select("text")
