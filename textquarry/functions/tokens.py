"""Built-in lossless tokenizer: a word together with the whitespace before it.

A different tokenizer plugs in as any ``Column -> Column`` function that returns an array, for
example an Arrow ``pandas_udf`` returning ``array<int>``, with its own end-of-text token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import TOKEN_BOUNDARY, col

EOS = "</s>"


def encode(text: Column | str, limit: int = -1) -> Column:
    """Tokens whose concatenation is ``text``; with ``limit``, the last holds the unsplit rest."""
    return F.array_remove(F.split(F.coalesce(col(text), F.lit("")), TOKEN_BOUNDARY, limit), "")


def decode(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def encode_document(text: Column | str, eos: str = EOS) -> Column:
    """Tokens of ``text`` closed by the end-of-text token."""
    return F.concat(encode(text), F.array(F.lit(eos)))


def encode_head(text: Column | str, n: int | Column, eos: str = EOS) -> Column:
    """First ``n`` tokens of the closed text, then perhaps more; long text is split no further."""
    limit = n + 1 if isinstance(n, int) else n + F.lit(1)
    return F.concat(encode(text, limit), F.array(F.lit(eos)))


def truncate(text: Column | str, n: int | Column, eos: str = EOS) -> Column:
    """Encode with the end-of-text token, keep ``n`` tokens, decode. Long text loses the token."""
    return decode(F.slice(encode_head(text, n, eos), 1, n))
