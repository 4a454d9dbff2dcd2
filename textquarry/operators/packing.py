"""Pack documents into sequences of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import tokens
from textquarry.functions.text import let
from textquarry.operators.ordered import prefix_sum, whole_quotient
from textquarry.session import stage


def pack_sequences(
    docs: DataFrame,
    length: int,
    order: str = "doc_id",
    text: str = "text",
    encode: Callable[[Column], Column] = tokens.encode_document,
    drop_remainder: bool = False,
    docs_per_block: int = 1_000,
    stage_tokens: bool = False,
) -> DataFrame:
    """``(chunk_id, n_tokens, tokens)``: all tokens in ``order``, cut every ``length`` tokens.

    ``encode`` returns a document's tokens with the end-of-text token last. Documents are cut at
    chunk borders and only whole slices move, so rows grow by one per border. Texts are shuffled
    by block of documents, chunks inside a block are closed there, and just the slices of chunks
    that cross a block border are shuffled again. ``stage_tokens`` writes the tokens once first,
    for an ``encode`` that is dear to repeat.
    """
    body = docs.select(order, F.col(text).alias("body"))
    if stage_tokens:
        body = stage(body.withColumn("body", encode(F.col("body"))), "tokens")
        encode = _as_is
    # The text crosses the shuffle, not its tokens: it is far smaller and is encoded behind it.
    placed = prefix_sum(
        body,
        order,
        F.size(encode(F.col("body"))),
        "start",
        block=docs_per_block,
        keep_block=True,
        costly=True,
    ).where("_value > 0")
    start, size = F.col("start"), F.col("_value")

    def cut(tokens_: Column, chunk: Column) -> Column:
        at = F.greatest(chunk * length, start)
        end = F.least((chunk + 1) * length, start + size)
        piece = F.slice(tokens_, (at - start + 1).cast("int"), (end - at).cast("int"))
        return F.struct(chunk.alias("chunk_id"), at.alias("at"), piece.alias("tokens"))

    def crosses(chunk: Column) -> Column:
        before_block = chunk * length < F.col("_block_start")
        return before_block | ((chunk + 1) * length > F.col("_block_end"))

    def joined_chunks(wanted: Callable[[Column], Column]) -> DataFrame:
        touched = F.sequence(
            whole_quotient(start, length), whole_quotient(start + size - 1, length)
        )
        kept = placed.withColumn("chunks", F.filter(touched, wanted)).where(F.size("chunks") > 0)
        # One encoding per document, whatever number of chunks it touches.
        cuts = let(
            encode(F.col("body")),
            lambda tokens_: F.transform("chunks", lambda chunk: cut(tokens_, chunk)),
        )
        slices = kept.select("_block", F.explode_outer(cuts).alias("s")).select("_block", "s.*")
        return _join_slices(slices, "_block", "chunk_id").drop("_block")

    inside = joined_chunks(lambda chunk: ~crosses(chunk))
    across = _join_slices(joined_chunks(crosses), "chunk_id")
    chunks = inside.select("chunk_id", "tokens").unionByName(across.select("chunk_id", "tokens"))
    sized_chunks = chunks.select("chunk_id", F.size("tokens").alias("n_tokens"), "tokens")
    return sized_chunks.where(F.col("n_tokens") == length) if drop_remainder else sized_chunks


def _as_is(tokens_: Column) -> Column:
    return tokens_


def _join_slices(slices: DataFrame, *keys: str) -> DataFrame:
    """Concatenate the slices of each chunk; a group holds at most one chunk's tokens."""
    items = F.array_sort(F.collect_list(F.struct("at", "tokens")))
    return slices.groupBy(*keys).agg(
        F.min("at").alias("at"), F.flatten(F.transform(items, lambda i: i["tokens"])).alias("tokens")
    )


def pack_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, tokens, full chunks and the size of the last one."""
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.sum("n_tokens").alias("tokens"),
        F.max_by("n_tokens", "chunk_id").cast("bigint").alias("last_chunk_tokens"),
    )
