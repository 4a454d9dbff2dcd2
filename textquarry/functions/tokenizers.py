"""Token ids of a byte-level tokenizer as Arrow functions.

Texts become ``array<int>`` ids in batches on the executors, are cut and packed as ids by built-in
expressions, and are decoded after the cut. The vocabulary is a file of the ``tokenizers`` library that
every executor can read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import col
from textquarry.functions.tokens import EOS

_ROWS = 256


@functools.cache
def _library(vocabulary: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    library.encode_special_tokens = True  # in a text, their strings are ordinary text
    return library


@functools.cache
def _encoder(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
    )


@dataclass(frozen=True)
class Ids:
    """A vocabulary, the id that closes a text and the string that stands for it.

    ``ranks`` is a file of the same vocabulary for the ``tiktoken`` library, whose encoder is several
    times faster. It gives up on very long white space; such texts are encoded without it.

    It takes the place of the built-in tokens wherever a job has a ``tokenizer`` or an ``encode``.
    """

    vocabulary: str
    end_id: int
    eos: str = EOS
    ranks: str | None = None

    def _batches(self, values: pa.Array, convert: Callable[[pa.Array], list], kind) -> pa.Array:
        parts = [
            pa.array(convert(values.slice(at, _ROWS)), kind)
            for at in range(0, len(values), _ROWS)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    def _ranked(self, text: str) -> np.ndarray:
        try:
            found = _encoder(self.ranks).encode_to_numpy(text, disallowed_special=())
        except ValueError:
            found = _library(self.vocabulary).encode(text, add_special_tokens=False).ids
        return np.array(found, np.int32)

    def encode(self, text: Column | str) -> Column:
        """``array<int>`` ids of a whole text without special tokens; null counts as empty."""

        def ids(values: pa.Array) -> pa.Array:
            def convert(rows: pa.Array) -> list:
                texts = [t or "" for t in rows.to_pylist()]
                if self.ranks:
                    return [self._ranked(t) for t in texts]
                library = _library(self.vocabulary)
                found = library.encode_batch(texts, add_special_tokens=False)
                return [e.ids for e in found]

            return self._batches(values, convert, pa.list_(pa.int32()))

        return F.arrow_udf(ids, "array<int>")(col(text))

    def encode_document(self, text: Column | str) -> Column:
        """Ids of a text closed by the end id, as ``pack_sequences`` takes them."""
        return F.concat(self.encode(text), F.array(F.lit(self.end_id)))

    def encode_head(self, text: Column | str, n: int | Column, eos: str = EOS) -> Column:
        """The first ``n`` ids of the closed text."""
        return F.slice(self.encode_document(text), F.lit(1), F.lit(n) if isinstance(n, int) else n)

    def decode(self, ids: Column | str) -> Column:
        """The text of ids, ``eos`` for the end id; a character cut in two is replaced."""

        def texts(values: pa.Array) -> pa.Array:
            def convert(some: pa.Array) -> list:
                library, end = _library(self.vocabulary), self.end_id
                # Ids become Python's numbers by the row; one by one they cost more than the rest.
                sizes = pc.list_value_length(some).fill_null(0).to_numpy(zero_copy_only=False)
                rows = np.split(some.flatten().to_numpy(), np.cumsum(sizes)[:-1])
                heads = [row[row != end].tolist() for row in rows]
                found = library.decode_batch(heads, skip_special_tokens=False)
                closed = [len(row) > 0 and row[-1] == end for row in rows]
                return [t + self.eos * bool(c) for t, c in zip(found, closed, strict=True)]

            return self._batches(values, convert, pa.string())

        return F.arrow_udf(texts, "string")(col(ids))

    def truncate(self, text: Column | str, n: int | Column, eos: str = EOS) -> Column:
        """Encode with the end id, keep ``n`` ids, decode. Long text loses the end id."""
        return self.decode(self.encode_head(text, n))
