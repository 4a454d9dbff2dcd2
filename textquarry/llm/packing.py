"""Packing of token pieces into windows by best-fit decreasing.

Piece lengths are whole numbers up to the window, so the fit is computed on counts: the driver sees
at most one count per length, whatever the corpus holds. Pieces of equal length are interchangeable;
each gets its number among its length by a two-level count, and the plan turns numbers into places.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.tables import Scratch, query, table

WINDOW = 1024
END_ID = 0
END_OF_TEXT = ("<|endoftext|>", 50256)  # the vocabulary's only special token
_MAX_NUMBER = 44  # bits for a piece's number among those of its length


@functools.cache
def encoder(vocabulary: str):
    """Encoder of a byte-level BPE vocabulary stored as ranks, with its one special token."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks,
        special_tokens=dict([END_OF_TEXT]),
    )


@functools.cache
def _whole_vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, ranks: str, vocabulary: str) -> np.ndarray:
    """Ids of a whole text without the end id.

    The encoder of the ranks is the faster one but gives up on very long white space; the library
    that reads the whole vocabulary then gives the ids, which are the same.
    """
    try:
        return encoder(ranks).encode_to_numpy(text, allowed_special="all", disallowed_special=())
    except ValueError:
        found = _whole_vocabulary(vocabulary).encode(text, add_special_tokens=False)
        return np.array(found.ids, np.uint32)


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    ranks: str | None = None,
    vocabulary: str | None = None,
    keep_ids: bool = True,
) -> DataFrame:
    """Cut every document's ids, closed by the end id, into full windows and a remainder.

    Returns doc_id, start, length, ids (array, null unless ``keep_ids``), ids_crc32, doc_tokens,
    and part and rank: the piece is the rank-th of its length in that partition. A null text counts
    as empty and gives the end id alone. Rows that repeat give their pieces again. ``ranks`` and
    ``vocabulary`` are files of one byte-level vocabulary, for the libraries tiktoken and tokenizers.
    """
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, start long, length long, ids array<int>, ids_crc32 long, "
        "doc_tokens long, part long, rank long"
    )

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out = []
                for doc, text in zip(some["doc_id"], some["text"].to_pylist(), strict=True):
                    ids = token_ids(text or "", ranks, vocabulary)
                    ids = np.append(ids, END_ID).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        size = len(piece)
                        out.append(
                            (
                                doc.as_py(),
                                start,
                                size,
                                piece.astype(np.int32) if keep_ids else None,
                                zlib.crc32(piece.tobytes()),
                                len(ids),
                                part,
                                seen[size],
                            )
                        )
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=names,
                )

    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "part", "rank"]
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    long = pa.int64()
    from pyspark.sql.pandas.types import to_arrow_type

    types = [
        to_arrow_type(chosen.schema["doc_id"].dataType),
        long, long, pa.list_(pa.int32()), long, long, long, long,
    ]
    return chosen.mapInArrow(cut, schema)


class OpenWindows:
    """Runs of windows with equal room, found by room through a segment tree of their numbers."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs.setdefault(room, []).append((first, count))
            self._change(room, 1)

    def take(self, size: int) -> tuple[int, int, int] | None:
        """Remove and return (room, first, count) of the tightest run that holds ``size``."""
        node = self.leaves + size
        while not self.tree[node]:
            while node & 1:  # a right child: everything right of it lies further up
                node >>= 1
            if not node:
                return None
            node |= 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        first, count = self.runs[room].pop()
        self._change(room, -1)
        return room, first, count


def best_fit_decreasing(counts: dict[int, int], window: int) -> np.ndarray:
    """Places for ``counts[size]`` pieces of each size, longest first, tightest window first.

    Rows (size, number, base, per_window, offset): from that number on, pieces of the size go to
    windows base, base + 1, ... with per_window pieces each, from that offset on.
    """
    open_windows, windows, rows = OpenWindows(window), 0, []
    for size in sorted(counts, reverse=True):
        number, left = 0, counts[size]
        while left:
            run = open_windows.take(size)
            if run is None:
                run = window, windows, -(-left // (window // size))
                windows += run[2]
            room, first, count = run
            per = room // size
            full = min(count, left // per)
            if full:
                rows.append((size, number, first, per, window - room))
                open_windows.put(room - per * size, first, full)
                number, left = number + full * per, left - full * per
            if full < count and left:  # the last window of this size is not filled with it
                rows.append((size, number, first + full, left, window - room))
                open_windows.put(room - left * size, first + full, 1)
                full, left = full + 1, 0
            open_windows.put(room, first + full, count - full)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to a stored table of ``token_pieces``.

    The rows and other columns stay as they are, but for part and rank, which go. Every window is
    gapless from 0. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    sizes = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_decreasing(sizes, window))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = counts.select(
        "length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    numbered = pieces.join(before, ["length", "part"]).select(
        *[c for c in pieces.columns if c not in ("part", "rank")],
        (F.col("before") + F.col("rank")).alias("number"),
    )

    def place(batches):
        size, number, base, per, offset = plan.value.T
        keys = (size << _MAX_NUMBER) + number
        for batch in batches:
            own, k = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = np.searchsorted(keys, (own << _MAX_NUMBER) + k, side="right") - 1
            k = k - number[row]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.drop_columns("number").columns,
                    pa.array(base[row] + k // per[row]),
                    pa.array(offset[row] + k % per[row] * own),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kept = numbered.drop("number").schema
    return numbered.mapInArrow(
        place, kept.add("sequence_id", "long").add("offset", "long")
    )


def packed(docs: DataFrame, keep_ids: bool = False, **options) -> DataFrame:
    """Encode, cut and pack ``docs``; see ``token_pieces`` and ``pack_pieces``.

    Per piece: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), doc_tokens, sequence_id, offset, and the ids themselves with ``keep_ids``.
    """
    pieces = token_pieces(docs, keep_ids=keep_ids, **options)
    stored = pieces if keep_ids else pieces.drop("ids")
    stored = Scratch(docs.sparkSession, "packing").write(stored, "pieces")
    return pack_pieces(stored, options.get("window", WINDOW))


@query("op7_packing")
def op7(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
