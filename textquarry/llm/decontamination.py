"""Benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment.

Texts are compared as the bytes of their letters and digits, A-Z in lower case. A passage of m bytes
may differ by ``edits = m * max_error`` edits. Such an occurrence shares at least
m - q + 1 - q * edits q-grams with the item (the q-gram lemma), on diagonals that drift by at most
``edits``. Bands overlap by half, so that one of them holds all of these diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.arrow_text import Chunk, chunks
from textquarry.llm.tables import query, table

Q = 8  # one machine word
MAX_ERROR = 0.1
MIN_LENGTH = 24  # shorter items allow no edits, and below Q they must be whole words
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

_KEPT = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128:
        _KEPT[_c] = ord(chr(_c).lower())
    elif _c >= 128:
        _KEPT[_c] = _c


def normalised(data: np.ndarray) -> np.ndarray:
    mapped = _KEPT[data]
    return mapped[mapped != 0]


def grams(data: np.ndarray) -> np.ndarray:
    """Every run of Q bytes as one number."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data.tobytes(), 0, (1,))


class Index:
    """Sorted q-grams of a block of benchmark items. Sent to every task: its size is bounded."""

    def __init__(self, items: list[tuple], max_error: float = MAX_ERROR):
        kept = []
        for item_id, text in items:
            letters = normalised(np.frombuffer((text or "").encode(), np.uint8))
            if len(letters):
                kept.append((item_id, letters))
        self.ids = [i for i, _ in kept]
        self.letters = [x for _, x in kept]
        length = np.array([len(x) for x in self.letters], np.int64)
        # More edits than this would leave no q-gram that must be shared.
        self.edits = np.minimum((length * max_error).astype(np.int64), (length - Q) // Q)
        self.edits[length < MIN_LENGTH] = 0
        self.short_item = np.flatnonzero(length < Q)
        packed = [int.from_bytes(self.letters[i].tobytes(), "little") for i in self.short_item]
        self.short = np.array(packed, np.uint64)
        order = np.argsort(self.short, kind="stable")
        self.short, self.short_item = self.short[order], self.short_item[order]
        self.short_lengths = np.unique(length[length < Q]).tolist()
        self.least = length - Q + 1 - Q * self.edits
        found = [grams(x) for x in self.letters]
        gram = np.concatenate([np.zeros(0, "u8"), *found])
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in found]])
        order = np.argsort(gram, kind="stable")
        self.item, self.at = item[order].astype(np.int64), at[order].astype(np.int64)
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.gram)] = True

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * _MIX) >> np.uint64(64 - _FILTER_BITS)

    def shared(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, position in the item) of every q-gram found in the index."""
        if not len(self.gram):
            return (np.zeros(0, np.int64),) * 3
        near = np.flatnonzero(self.filter[self._slot(gram)])
        row = np.searchsorted(self.gram, gram[near])
        row[row == len(self.gram)] = 0
        same = self.gram[row] == gram[near]
        near, row = near[same], row[same]
        times = self.last[row] - self.first[row]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[row], times) + step
        return np.repeat(near, times), self.item[entry], self.at[entry]


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Fewest edits that turn ``item`` into a part of ``text`` on diagonals low..high.

    Returns (edits, start, end) of the leftmost such part. Cells outside the text cost as if
    nothing there matched.
    """
    diagonals = np.arange(low, high + 1)
    unit = np.int64(1) << 32  # a cell is edits * unit + start
    steps = np.arange(len(diagonals)) * unit
    cell = np.clip(diagonals, 0, len(text)).astype(np.int64)
    cell += (diagonals < 0) * (-diagonals) * unit
    padded = np.concatenate([text, np.zeros(1, text.dtype)])  # 0 is in no item
    far = np.int64(1) << 60
    for i, letter in enumerate(item):
        column = i + diagonals
        inside = (column >= 0) & (column < len(text))
        other = padded[np.where(inside, column, len(text))]
        best = cell + (other != letter) * unit
        best[:-1] = np.minimum(best[:-1], cell[1:] + unit)
        cell = np.minimum.accumulate(best - steps) + steps
        cell[column + 1 > len(text)] = far
    k = int(np.argmin(cell))
    return int(cell[k] >> 32), int(cell[k] & (unit - 1)), int(len(item) + diagonals[k])


def _whole_words(index: Index, letters, source, starts, ends) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, start, end) of items below Q bytes that begin and end with words of the text."""
    edge = np.ones(len(letters) + 1, bool)
    edge[1:-1] = source[1:] != source[:-1] + 1
    edge[starts] = edge[ends] = True
    first = np.flatnonzero(edge[:-1])
    text = np.searchsorted(ends, first, side="right")
    gram = grams(np.concatenate([letters, np.zeros(Q, np.uint8)]))
    for n in index.short_lengths:
        fits = first + n <= ends[text]
        fits[fits] = edge[first[fits] + n]
        value = gram[first[fits]] & np.uint64((1 << 8 * n) - 1)
        low = np.searchsorted(index.short, value)
        high = np.searchsorted(index.short, value, side="right")
        for k in np.flatnonzero(high > low):
            t, at = int(text[fits][k]), int(first[fits][k])
            for i in index.short_item[low[k] : high[k]]:
                yield t, int(i), at - int(starts[t]), at - int(starts[t]) + n


def leaks(chunk: Chunk, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every occurrence; byte positions in the raw text."""
    mapped = _KEPT[chunk.data]
    source = np.flatnonzero(mapped)
    letters = mapped[source]
    ends = np.searchsorted(source, chunk.ends)
    starts = np.concatenate([[0], ends[:-1]])
    at, item, item_at = index.shared(grams(letters))
    text = np.searchsorted(ends, at, side="right")
    inside = at + Q <= ends[np.minimum(text, len(ends) - 1)]
    at, item, item_at, text = at[inside], item[inside], item_at[inside], text[inside]
    offset = len(letters) + int(item_at.max(initial=0))  # no diagonal is negative
    diagonal = at - starts[text] - item_at + offset
    width = index.edits[item] + 1
    band = diagonal // width
    # Pairs that share anything get small numbers: texts times items may pass 32 bits.
    pairs, number = np.unique(text * np.int64(len(index.ids) or 1) + item, return_inverse=True)
    key = number.astype(np.int64) << np.int64(32)
    # Bands overlap by half: a hit counts for its own and the one before, numbered from 1 and 0 on.
    keys, counts = np.unique(np.concatenate([key + band, key + band + 1]), return_counts=True)
    pair = pairs[keys >> np.int64(32)]
    enough = counts >= index.least[pair % (len(index.ids) or 1)]
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k, own_pair in zip(keys[enough], pair[enough], strict=True):
        t, i = divmod(int(own_pair), len(index.ids))
        e = int(index.edits[i])
        low = (int(k & 0xFFFFFFFF) - 1) * (e + 1) - offset - e
        high = low + 2 * (e + 1) + 2 * e
        own = letters[starts[t] : ends[t]]
        left = max(0, low)
        part = own[left : high + len(index.letters[i]) + e]
        same = part.tobytes().find(index.letters[i].tobytes())
        if same >= 0:
            edits, a, b = 0, same, same + len(index.letters[i])
        else:
            edits, a, b = align(index.letters[i], part, low - left, high - left)
        if edits <= e:
            found.setdefault((t, i), []).append((edits, a + left, b + left))
    for t, i, a, b in _whole_words(index, letters, source, starts, ends):
        found.setdefault((t, i), []).append((0, a, b))
    for (t, i), places in found.items():
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(places):
            if all(b <= x or a >= y for x, y in taken):  # the better of overlapping ones stays
                taken.append((a, b))
                begin = chunk.starts[t]
                first, last = source[starts[t] + a], source[starts[t] + b - 1]
                yield t + chunk.first, i, int(first - begin), int(last - begin + 1), edits


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_error: float) -> Iterator[Index]:
    """Indexes of the benchmark in blocks of about BLOCK_CHARS, whatever its size."""
    items = benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // BLOCK_CHARS + 1
    for block in range(n):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block) if n > 1 else items
        yield Index([(r.id, r.text) for r in own.orderBy("id", "text").collect()], max_error)


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_error: float = MAX_ERROR,
) -> DataFrame:
    """One row per occurrence of a benchmark item in a text, in any number of edits up to its budget.

    Columns doc_id, item_id, start, length (code points of the raw text) and edits. Null and empty
    texts hold nothing. Rows that repeat are reported again. Items with fewer than MIN_LENGTH
    letters and digits allow no edits; those with fewer than Q must also begin and end where words of
    the text do. Items without any are left out. Other columns play no part.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_field, item_field = docs.schema["doc_id"], benchmark.schema[item_id_col]
    schema = (
        f"doc_id {id_field.dataType.simpleString()}, item_id {item_field.dataType.simpleString()}, "
        "start long, length long, edits long"
    )
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item_field.dataType)

    def scan(index):
        def run(batches):
            for batch in batches:
                for chunk in chunks(batch["text"]):
                    rows = list(leaks(chunk, index.value))
                    if not rows:
                        continue
                    spans = []
                    for t, _, a, b, _ in rows:
                        raw = batch["text"][t].as_py().encode()
                        start = len(raw[:a].decode(errors="ignore"))
                        spans.append((start, len(raw[:b].decode(errors="ignore")) - start))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["doc_id"].take(pa.array([r[0] for r in rows])),
                            pa.array([index.value.ids[r[1]] for r in rows], item_type),
                            pa.array([s for s, _ in spans], pa.int64()),
                            pa.array([n for _, n in spans], pa.int64()),
                            pa.array([r[4] for r in rows], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "start", "length", "edits"],
                    )

        return docs.mapInArrow(run, schema)

    out = None
    for index in _blocks(benchmark, item_id_col, item_text_col, max_error):
        part = scan(docs.sparkSession.sparkContext.broadcast(index))
        out = part if out is None else out.union(part)
    return out


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_error: float = MAX_ERROR,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage, with all their columns."""

    def keep(index):
        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for chunk in chunks(batch[text_col]):
                    for t, *_ in leaks(chunk, index.value):
                        clean[t] = False
                yield batch.filter(pa.array(clean))

        return run

    for index in _blocks(benchmark, item_id_col, item_text_col, max_error):
        docs = docs.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


@query("op5_decontamination")
def op5(spark, sf_dir):
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
