"""Ranked lexical search with pair-bound MaxScore over segments of documents.

Items come in blocks of bounded size. For a block, every task turns its documents into segments:
inverted lists of the block's terms over a few thousand documents. Once the counts of the whole
table are known, a segment also gets the maximum impact of every term and, for pairs of terms that
items hold together, the intersection list and the maximum of both impacts on one document. A search
reads a segment item by item and skips terms and documents that the bounds rule out: a pair's joint
maximum is below the sum of its terms' own maxima wherever those lie on different documents.
No list crosses a segment, so a very frequent term is spread as the documents are.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.tables import Scratch, query, table

K = 20
TERM = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SEGMENT_DOCS = 4096
SEGMENT_POSTINGS = 500_000
BLOCK_CHARS = 250_000
PAIRED = 6  # the most frequent terms of an item whose pairs get lists
SALTS = 64
_PIECE = 1 << 20


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, A-Z in lower case, some at a time."""
    text, at = text.lower(), 0  # of bytes, lower() changes A-Z only
    while at < len(text):
        to = at + _PIECE
        if to < len(text):  # no term is cut: go on to where one ends
            to = end.end() if (end := TERM.match(text, to)) else to
        yield TERM.findall(text, at, to)
        at = to


@dataclass(frozen=True)
class Item:
    """An item's id, its terms by number in the block, and how often it holds each."""

    id: int | None
    terms: np.ndarray
    times: np.ndarray


@dataclass(frozen=True)
class Statistics:
    """Of all documents: how many hold a term, their terms with repeats, and the weight of terms."""

    docs: int
    total: int
    weight: np.ndarray

    @classmethod
    def of(cls, docs: int, total: int, df: np.ndarray) -> Statistics:
        weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()]
        return cls(docs, total, np.array(weight, np.int64))

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Impact of each term on a document of ``n`` terms that holds it ``tf`` times."""
        if 25 * int(n.max(initial=0)) * self.docs < 1 << 63:
            m = 75 + 25 * n * self.docs // self.total
        else:
            m = np.array([75 + 25 * x * self.docs // self.total for x in n.tolist()], np.int64)
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))


SEGMENT = (
    "n_docs long, n_terms long, docs array<long>, lengths array<long>, terms array<int>, "
    "ends array<int>, positions array<int>, counts array<int>"
)
INDEX = (
    "docs array<long>, terms array<int>, ends array<int>, positions array<int>, "
    "impacts array<long>, peaks array<long>, firsts array<int>, seconds array<int>, "
    "joint array<long>, shared binary"
)


class _Builder:
    """Collects documents until they make a segment."""

    def __init__(self, numbers: dict[bytes, int], most: int = SEGMENT_DOCS):
        self.numbers, self.most = numbers, most
        self.start()

    def start(self) -> None:
        self.n_docs = self.n_terms = 0
        self.docs, self.lengths = [], []
        self.position, self.term, self.count = [], [], []

    def add(self, doc: int | None, text: bytes) -> None:
        known, n, held = self.numbers, 0, Counter()
        for piece in terms_of(text):
            n += len(piece)
            held.update(filter(known.__contains__, piece))
        self.n_docs += n > 0
        self.n_terms += n
        if held:
            self.position += [len(self.docs)] * len(held)
            self.term += [known[t] for t in held]
            self.count += held.values()
            self.docs.append(doc)
            self.lengths.append(n)

    def full(self) -> bool:
        return len(self.docs) >= self.most or len(self.term) >= SEGMENT_POSTINGS

    def segment(self) -> list:
        term = np.array(self.term, np.int64)
        order = np.argsort(term, kind="stable")  # positions stay ascending in a list
        used, ends = np.unique(term, return_counts=True)
        row = [self.n_docs, self.n_terms, self.docs, self.lengths, used, np.cumsum(ends),
               np.array(self.position, np.int64)[order], np.array(self.count, np.int64)[order]]
        self.start()
        return row


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(text))


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def segments(docs: DataFrame, numbers: dict[bytes, int], most: int = SEGMENT_DOCS) -> DataFrame:
    """Inverted lists of the numbered terms: one row for each few thousand documents.

    ``docs`` has the columns doc and text. A segment lists the documents that hold such a term;
    n_docs and n_terms count all.
    """
    schema, shared = _schema(SEGMENT), docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        builder = _Builder(shared.value, most)
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            for doc, text in zip(batch["doc"].to_pylist(), texts, strict=True):
                builder.add(doc, text.as_py() or b"")
                if builder.full():
                    yield _batch([builder.segment()], schema)
        yield _batch([builder.segment()], schema)

    return docs.mapInArrow(run, SEGMENT)


def _statistics(stored: DataFrame, n_terms: int) -> Statistics:
    total = stored.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    sizes = F.transform(
        "ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0))
    )
    held = stored.select(F.explode(F.arrays_zip("terms", sizes.alias("size"))).alias("t"))
    held = held.select(F.col("t")["terms"].alias("term"), F.col("t")["size"].alias("size"))
    df = np.zeros(n_terms, np.int64)
    for r in held.groupBy("term").agg(F.sum("size").alias("df")).collect():  # the block's terms
        df[r.term] = r.df
    return Statistics.of(total[0] or 0, total[1] or 0, df), df


def paired_terms(items: list[Item], df: np.ndarray) -> np.ndarray:
    """Pairs (lower, higher) of the PAIRED most frequent terms of each item, ascending."""
    pairs = set()
    for item in items:
        often = sorted(item.terms.tolist(), key=lambda t: (-df[t], t))[:PAIRED]
        pairs.update(itertools.combinations(sorted(t for t in often if df[t]), 2))
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


@dataclass
class Segment:
    """A segment with its bounds; lists are slices of ``positions`` and ``impacts``."""

    docs: list[int | None]
    lists: dict[int, slice]
    positions: np.ndarray
    impacts: np.ndarray
    peaks: dict[int, int]
    joint: dict[tuple[int, int], int]
    shared: dict[tuple[int, int], np.ndarray]


def pair_lists(
    n_docs: int, lists: dict[int, slice], positions: np.ndarray, impacts: np.ndarray, pairs: np.ndarray
) -> tuple[list[tuple[int, int]], list[int], list[np.ndarray]]:
    """Of the pairs that meet on a document: the pair, the largest sum of both impacts, the documents.

    Documents are bits, so a list costs an eighth of a byte for each document of the segment.
    """
    met, joint, shared = [], [], []
    held = np.full(n_docs, -1, np.int64)
    for first, group in itertools.groupby(pairs.tolist(), key=lambda p: p[0]):
        if first not in lists:
            continue
        own = positions[lists[first]]
        held[own] = impacts[lists[first]]
        for _, second in group:
            if second not in lists:
                continue
            there = positions[lists[second]]
            both = held[there] >= 0
            if both.any():
                sums = (held[there] + impacts[lists[second]])[both]
                bits = np.zeros(n_docs, bool)
                bits[there[both]] = True
                met.append((first, second))
                joint.append(int(sums.max()))
                shared.append(np.packbits(bits))
        held[own] = -1
    return met, joint, shared


def _slices(terms: np.ndarray, ends: np.ndarray) -> dict[int, slice]:
    starts = [0, *ends[:-1].tolist()]
    return {t: slice(a, b) for t, a, b in zip(terms.tolist(), starts, ends.tolist(), strict=True)}


def _numbers(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return batch[name][row].values.to_numpy(zero_copy_only=False).astype(np.int64)


def with_bounds(stored: DataFrame, statistics: Statistics, pairs: np.ndarray) -> DataFrame:
    """Segments with impacts, their maximum per term, and the lists and maxima of pairs."""
    schema = _schema(INDEX)
    shared_values = stored.sparkSession.sparkContext.broadcast((statistics, pairs))

    def run(batches):
        of_all, wanted = shared_values.value
        for batch in batches:
            for row in range(batch.num_rows):
                terms, ends, positions, tf, n = (
                    _numbers(batch, row, c)
                    for c in ("terms", "ends", "positions", "counts", "lengths")
                )
                if not len(terms):
                    continue
                term = np.repeat(terms, np.diff(ends, prepend=0))
                impacts = of_all.impacts(term, tf, n[positions])
                peaks = np.maximum.reduceat(impacts, np.concatenate([[0], ends[:-1]]))
                met, joint, shared = pair_lists(
                    len(n), _slices(terms, ends), positions, impacts, wanted
                )
                yield _batch(
                    [[batch["docs"][row].as_py(), terms, ends, positions, impacts, peaks,
                      [a for a, _ in met], [b for _, b in met], joint,
                      b"".join(s.tobytes() for s in shared)]],
                    schema,
                )

    columns = ["docs", "lengths", "terms", "ends", "positions", "counts"]
    return stored.select(*columns).mapInArrow(run, INDEX)


def _read(batch: pa.RecordBatch, row: int) -> Segment:
    docs = batch["docs"][row].as_py()
    terms, peaks = _numbers(batch, row, "terms"), _numbers(batch, row, "peaks")
    pairs = list(zip(_numbers(batch, row, "firsts").tolist(),
                     _numbers(batch, row, "seconds").tolist(), strict=True))
    bits = np.frombuffer(batch["shared"][row].as_py(), np.uint8).reshape(len(pairs), -1)
    return Segment(
        docs,
        _slices(terms, _numbers(batch, row, "ends")),
        _numbers(batch, row, "positions"),
        _numbers(batch, row, "impacts"),
        dict(zip(terms.tolist(), peaks.tolist(), strict=True)),
        dict(zip(pairs, _numbers(batch, row, "joint").tolist(), strict=True)),
        dict(zip(pairs, bits, strict=True)),
    )


@dataclass(frozen=True)
class _Pair:
    """Two places in an item's order of terms, and what their pair can add to a document's score."""

    low: int
    high: int
    saving: int
    joint: int  # on a document with both terms
    single: int  # on one with either
    shared: np.ndarray | None


def bound_pairs(segment: Segment, terms: list[int], times: list[int], bounds: list[int]) -> list[_Pair]:
    """Disjoint pairs of an item's terms, those that lower its bound most first.

    A term held several times counts its maximum each time; the pair's joint maximum replaces as
    many of both as there are of the rarer.
    """
    found = []
    for (a, i), (b, j) in itertools.combinations(sorted(zip(terms, range(len(terms)), strict=True)), 2):
        if (joint := segment.joint.get((a, b))) is not None:
            both = min(times[i], times[j])
            joint = joint * both + sum(
                (times[x] - both) * segment.peaks[terms[x]] for x in (i, j)
            )
            single = max(bounds[i], bounds[j])
            saving = bounds[i] + bounds[j] - max(joint, single)
            if saving > 0:
                found.append(
                    _Pair(min(i, j), max(i, j), saving, joint, single, segment.shared[a, b])
                )
    found.sort(key=lambda p: (-p.saving, p.low, p.high))
    taken, out = set(), []
    for p in found:
        if p.low not in taken and p.high not in taken:
            taken |= {p.low, p.high}
            out.append(p)
    return out


def search_segment(
    segment: Segment, item: Item, least: int, use_pairs: bool = True
) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents with a score of ``least`` or more: positions, scores, and how many were scored.

    Terms are ordered by their bound. As many of the lowest as stay below ``least`` together cannot
    make a result by themselves: documents are taken from the lists of the others alone, and leave
    as soon as what is still to come cannot lift them.
    """
    held = [(segment.peaks[t] * n, t, n)
            for t, n in zip(item.terms.tolist(), item.times.tolist(), strict=True)
            if t in segment.lists]
    held.sort()
    bounds, terms, times = ([h[i] for h in held] for i in range(3))
    pairs = bound_pairs(segment, terms, times, bounds) if use_pairs else []
    saved = {p.high: p.saving for p in pairs}
    before = [0]  # what the terms before a place can add up to
    for i, bound in enumerate(bounds):
        before.append(before[-1] + bound - saved.get(i, 0))
    optional = max(i for i in range(len(before)) if before[i] < least)
    score = np.zeros(len(segment.docs), np.int64)
    for i in range(optional, len(terms)):
        own = segment.lists[terms[i]]
        score[segment.positions[own]] += segment.impacts[own] * times[i]
    some = np.flatnonzero(score)
    scored = len(some)
    rest = np.full(len(some), before[optional], np.int64)
    for p in pairs:  # a document outside the pair's list has one of the terms at most
        if p.high < optional and p.joint > p.single:
            there = p.shared[some >> 3] >> (7 - (some & 7)).astype(np.uint8) & 1
            rest[there == 0] -= p.joint - p.single
    some = some[score[some] + rest >= least]
    for i in range(optional - 1, -1, -1):
        if not len(some):
            break
        own = segment.lists[terms[i]]
        at = segment.positions[own]
        if 8 * len(some) < len(at):
            place = np.minimum(np.searchsorted(at, some), len(at) - 1)
            hit = at[place] == some
            score[some[hit]] += segment.impacts[own][place[hit]] * times[i]
        else:
            score[at] += segment.impacts[own] * times[i]
        some = some[score[some] + before[i] >= least]
    return some, score[some], scored


class _Best:
    """The ``k`` best documents of an item so far, as (-score, id is null, id)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A lower score cannot come in; an equal one can, by a smaller id."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, docs: list, positions: np.ndarray, scores: np.ndarray) -> None:
        if len(positions) > self.k:
            least = np.partition(scores, -self.k)[-self.k]
            positions, scores = positions[scores >= least], scores[scores >= least]
        new = [(-s, docs[p] is None, docs[p] or 0)
               for p, s in zip(positions.tolist(), scores.tolist(), strict=True)]
        self.rows = sorted(self.rows + new)[: self.k]


def _search(index: DataFrame, items: list[Item], block: int, k: int, id_type: str) -> DataFrame:
    """(item, item_id, doc_id, score, salt): the ``k`` best of every item in each task."""
    out = f"item long, item_id {id_type}, doc_id long, score long, salt int"
    schema, shared = _schema(out), index.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        wanted = shared.value
        best = [_Best(k) for _ in wanted]
        for batch in batches:
            for row in range(batch.num_rows):
                segment = _read(batch, row)
                for item, own in zip(wanted, best, strict=True):
                    positions, scores, _ = search_segment(segment, item, own.least)
                    own.add(segment.docs, positions, scores)
        salt = TaskContext.get().partitionId() % SALTS
        rows = [
            [(block << 32) + i, item.id, None if missing else doc, -score, salt]
            for i, (item, own) in enumerate(zip(wanted, best, strict=True))
            for score, missing, doc in own.rows
        ]
        yield _batch(rows, schema)

    return index.mapInArrow(run, out)


def _blocks(items: DataFrame) -> Iterator[tuple[dict[bytes, int], list[Item]]]:
    """Term numbers and items of the distinct (id, text), in blocks of about BLOCK_CHARS."""
    items = items.distinct()
    n = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    for block in range(n):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block) if n > 1 else items
        numbers: dict[bytes, int] = {}
        found = []
        for r in own.collect():
            held: Counter[bytes] = Counter()
            for piece in terms_of((r.text or "").encode()):
                held.update(piece)
            terms = [numbers.setdefault(t, len(numbers)) for t in held]
            if terms:
                found.append(Item(r.id, np.array(terms), np.array(list(held.values()))))
        yield numbers, found


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    segment_docs: int = SEGMENT_DOCS,
) -> DataFrame:
    """Per item the ``k`` documents of the highest score above 0: item_id, rank from 1, doc_id, score.

    Exact: bounds only skip what cannot be among them. Terms are runs of letters, digits and
    non-ASCII characters of whole texts, with A-Z in lower case; null and empty texts have none and
    count as no document. Document ids are whole numbers; equal scores go by ascending id, null last.
    Rows of ``docs`` that repeat count, and are returned, each time. Items that repeat with the same
    text count once; one id with several texts is ranked once for each. Other columns play no part.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_id_col].dataType.simpleString()
    docs = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    items = items.select(items[item_id_col].alias("id"), items[item_text_col].alias("text"))
    scratch = Scratch(spark, "search")

    def found() -> Iterator[DataFrame]:
        for block, (numbers, own) in enumerate(_blocks(items)):
            stored = scratch.write(segments(docs, numbers, segment_docs), f"segments-{block}")
            statistics, df = _statistics(stored, len(numbers))
            index = with_bounds(stored, statistics, paired_terms(own, df))
            index = scratch.write(index, f"index-{block}")
            scratch.drop(stored)
            yield _search(index, own, block, k, id_type)
            scratch.drop(index)

    stored = scratch.write_each(found(), "found")

    def best(df: DataFrame, *keys: str) -> DataFrame:
        place = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    # Salted by task first: what meets for one item is at most k rows for each salt.
    some = best(stored, "item", "salt").drop("rank", "salt")
    return best(some, "item").select("item_id", "rank", "doc_id", "score")


def _sql_terms(column: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"regexp_extract_all({column}, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')"
    return f"unnest(list_transform({found}, lambda t: translate(t, '{upper}', '{lower}')))"


ORACLE = f"""
    WITH d AS (SELECT doc_id, {_sql_terms("text")} AS term FROM documents),
    p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
    q AS (
        SELECT item_id, term, count(*) AS times
        FROM (SELECT item_id, {_sql_terms("text")} AS term FROM benchmark) GROUP BY ALL),
    w AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM p GROUP BY term), whole),
    s AS (
        SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf)
               // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN p USING (term) JOIN lengths USING (doc_id), whole
        GROUP BY item_id, doc_id)
    SELECT * FROM (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
                             AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0)
    WHERE rank <= {K}
"""


@query("op12_ranked_search", ORACLE)
def op12(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
