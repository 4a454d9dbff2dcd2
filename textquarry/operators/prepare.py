"""Cleaning, filtering and formatting of corpus documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import prompts, tokens
from textquarry.functions.text import clean, has_words, not_blank, strip, truncate_words
from textquarry.operators.ordered import number_rows, rows_at, whole_quotient
from textquarry.sources.tiers import TIERS

METADATA = ("citation", "jurisdiction", "type")
UNKNOWN = dict.fromkeys(METADATA, "Unknown")
TRAINING_UNKNOWN = {name: f"Unknown {name.capitalize()}" for name in METADATA}


def min_words(docs: DataFrame, n: int = 50, text: str = "text") -> DataFrame:
    return docs.where(has_words(text, n))


def with_defaults(docs: DataFrame, defaults: dict[str, str] = UNKNOWN) -> DataFrame:
    """Fill missing metadata; a column the input lacks becomes the default throughout."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in docs.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return docs.withColumns(filled)


def qa_prompts(
    docs: DataFrame, max_words: int = 800, pairs_per_doc: int = 3, shortest: int = 50
) -> DataFrame:
    """Long-enough documents with their generation prompt."""
    ready = with_defaults(min_words(docs, shortest)).withColumn("text", clean("text"))
    chunk = truncate_words("text", max_words)
    return ready.withColumn("prompt", prompts.qa_generation(chunk, pairs_per_doc))


def clean_eos(docs: DataFrame, eos: str = tokens.EOS, longer_than: int = 10) -> DataFrame:
    """Stripped non-blank texts with the end-of-text token.

    The length test counts that token too, so a long one keeps every text.
    """
    closed = docs.where(not_blank("text")).withColumn("text", F.concat(strip("text"), F.lit(eos)))
    return closed.where(F.length("text") > longer_than)


def without_eos(docs: DataFrame, eos: str = tokens.EOS) -> DataFrame:
    """Undo the last step of ``clean_eos``."""
    return docs.withColumn("text", F.left("text", F.length("text") - len(eos)))


def training_pairs(pairs: DataFrame, eos: str = tokens.EOS) -> DataFrame:
    """Add the training text of question-answer pairs."""
    return pairs.withColumn("text", prompts.training_qa("question", "answer", eos))


def training_documents(
    docs: DataFrame,
    max_tokens: int | Column,
    eos: str = tokens.EOS,
    defaults: dict[str, str] = TRAINING_UNKNOWN,
    tokenizer=tokens.truncate,
) -> DataFrame:
    """Replace ``text`` by the document-completion text cut to ``max_tokens``.

    ``tokenizer(text, n, eos)`` closes the text, cuts and decodes; pass another to plug one in.
    """
    ready = with_defaults(docs, defaults)
    full = prompts.training_document("citation", "jurisdiction", "type", "text")
    return ready.withColumn("text", tokenizer(full, max_tokens, eos))


def with_tiers(
    docs: DataFrame,
    tiers: Sequence[str] = tuple(TIERS),
    columns: Sequence[str] = ("max_seq_length", "token_truncation_length", "max_steps"),
    overrides: dict[str, float] | None = None,
) -> DataFrame:
    """One copy of each row per chosen tier, with the tier's settings.

    Exploding a literal array keeps this a narrow projection. An override that is not None
    replaces the value of every tier.
    """
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    rows = [
        F.struct(
            F.lit(tier).alias("tier"),
            *[F.lit(given.get(name, TIERS[tier][name])).alias(name) for name in columns],
        )
        for tier in tiers
    ]
    return docs.withColumn("_tier", F.explode(F.array(*rows))).select(*docs.columns, "_tier.*")


def training_documents_by_tier(
    docs: DataFrame,
    tiers: Sequence[str] = tuple(TIERS),
    eos: str = tokens.EOS,
    defaults: dict[str, str] = TRAINING_UNKNOWN,
    overrides: dict[str, float] | None = None,
    tokenizer=tokens,
) -> DataFrame:
    """``training_documents`` for several tiers, each text encoded once for the longest.

    ``tokenizer`` has ``encode_head`` and ``decode``: the built-in tokens, or ``tokenizers.Ids``, whose
    texts are cut as ids and decoded after the cut.
    """
    longest = max(TIERS[tier]["token_truncation_length"] for tier in tiers)
    full = prompts.training_document("citation", "jurisdiction", "type", "text")
    ready = with_defaults(docs, defaults)
    encoded = ready.withColumn("text", tokenizer.encode_head(full, longest, eos))
    tiered = with_tiers(encoded, tiers, overrides=overrides)
    head = F.slice("text", F.lit(1), F.col("token_truncation_length"))
    return tiered.withColumn("text", tokenizer.decode(head))


def stage_counts(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """``(stage, n)``: what reaches each stage, all counted in one pass.

    A stage is a condition, whose rows are counted, or a number per row, which is summed.
    """
    kinds = dict(df.select(*[value.alias(name) for name, value in stages.items()]).dtypes)
    totals = df.agg(
        *[
            (F.count_if(value) if kinds[name] == "boolean" else F.coalesce(F.sum(value), F.lit(0)))
            .cast("bigint")
            .alias(name)
            for name, value in stages.items()
        ]
    )
    rows = [F.struct(F.lit(name).alias("stage"), F.col(f"`{name}`").alias("n")) for name in stages]
    return totals.select(F.inline(F.array(*rows)))


def start_row(df: DataFrame, start: int, row: str = "row") -> DataFrame:
    return df.where(F.col(row) >= start)


def from_start_row(df: DataFrame, start: int, order: str, row: str = "row") -> DataFrame:
    """Number the rows from 1 in ``order`` and keep those from ``start`` on."""
    return rows_at(df, order, row, lambda place: place >= start)


def skip_answered_estimate(
    sample: DataFrame, existing_pairs: int | Column, pairs_per_doc: int, order: str
) -> DataFrame:
    """Drop the first ``existing_pairs div pairs_per_doc`` documents of the sample.

    An estimate: documents that gave fewer pairs are counted short. Prefer ``unanswered``.
    """
    existing = F.lit(existing_pairs) if isinstance(existing_pairs, int) else existing_pairs
    numbered = number_rows(sample.select(order), order, "row")
    skipped = numbered.where(F.col("row") <= whole_quotient(existing, pairs_per_doc))
    # Only the order column is numbered; the documents are filtered where they are.
    last = skipped.agg(F.max(order)).scalar()
    return sample.where(last.isNull() | (F.col(order) > last))


def concatenate(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
