"""Nearest neighbours by cosine: int8 product tiles with error bounds, survivors exact, heaps.

Queries come in blocks of bounded size, each sent to all tasks and held against every vector. A
tile's int8 products bound each cosine from both sides; a pair whose upper bound is below what its
query has already is dropped, and the rest are computed in double precision. Each task keeps one
heap per query, so what is shuffled grows with queries times tasks, not with pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.tables import Scratch, query, table

K = 5
BLOCK_BYTES = 16 << 20  # of a block of queries, in double precision
TILE = 1024  # rows of each side of a tile
SALTS = 64
_SLACK = 1e-9  # far above what rounding adds to a bound
_EXACT_WIDTH = 1024  # 127 * 127 times this stays a whole number in float32
_PAIRS = 1 << 16


@dataclass
class Vectors:
    """Distinct vectors with the ids that have them, and their int8 forms.

    ``scaled`` are the vectors times a power of two, which leaves every cosine as it is.
    """

    ids: list[list[int]]
    scaled: np.ndarray
    norm: np.ndarray
    code: np.ndarray
    step: np.ndarray
    size: np.ndarray
    loss: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray, keep: int | None = None) -> Vectors:
        """Equal rows become one, with its ``keep`` lowest distinct ids (all, if None)."""
        _, power = np.frexp(np.abs(rows).max(axis=1, initial=0.0))
        rows = np.ldexp(rows, -power[:, None]) + 0.0  # no negative zero
        as_bytes = np.ascontiguousarray(rows).view(np.dtype((np.void, max(1, rows.strides[0]))))
        _, first, of = np.unique(as_bytes.ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, of))
        groups = np.split(ids[order], np.cumsum(np.bincount(of, minlength=len(first)))[:-1])
        rows = rows[first]
        norm = np.sqrt(dots(rows, rows))
        unit = rows / norm[:, None]
        step = np.abs(unit).max(axis=1) / 127
        code = np.rint(unit / step[:, None])
        near = code * step[:, None]
        return cls(
            [np.unique(g)[:keep].tolist() for g in groups],
            rows, norm, code.astype(np.float32), step,
            np.sqrt((near * near).sum(axis=1)),
            np.sqrt(((unit - near) ** 2).sum(axis=1)),
        )

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, at: int) -> Vectors:
        to = slice(at, at + TILE)
        return Vectors(self.ids[to], self.scaled[to], self.norm[to], self.code[to], self.step[to],
                       self.size[to], self.loss[to])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of paired rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def cosine_bounds(a: Vectors, b: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of every row of ``a`` with every row of ``b``.

    With unit vectors x, y and their int8 forms x', y': x.y - x'.y' = (x - x').y' + x.(y - y'), of
    which the first part is at most |x - x'| |y'| and the second at most |y - y'|.
    """
    product = np.zeros((len(a), len(b)))
    for k in range(0, a.code.shape[1], _EXACT_WIDTH):
        to = slice(k, k + _EXACT_WIDTH)
        product += a.code[:, to] @ b.code[:, to].T
    product *= a.step[:, None] * b.step
    error = a.loss[:, None] * b.size + b.loss + _SLACK
    return product - error, product + error


class Nearest:
    """The ``k`` nearest ids of each query, in heaps whose root is the one to go next."""

    def __init__(self, ids: list[int], k: int):
        self.ids, self.k = ids, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def put(self, row: int, score: float, id_: int) -> None:
        heap, entry = self.heaps[row], (score, -id_)
        if id_ == self.ids[row] or (len(heap) == self.k and entry <= heap[0]):
            return
        same = next((i for i, e in enumerate(heap) if e[1] == -id_), None)
        if same is not None:  # an id with several vectors: its nearest counts
            heap[same] = max(heap[same], entry)
            heapq.heapify(heap)
        elif len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[row] = heap[0][0]


def search_tile(own: Nearest, first: int, a: Vectors, b: Vectors) -> int:
    """Put the pairs of two parts that may be near into the heaps; returns how many were computed.

    ``a`` are the queries from the row ``first`` on, one id each. If no id of ``b`` repeats, the
    (k + 1)-th largest lower bound of a query in the tile counts as well: one of them may be its own.
    """
    lower, upper = cosine_bounds(a, b)
    least = own.least[first : first + len(a)]
    listed = sum(len(i) for i in b.ids)
    if len(b) > own.k and len({i for ids in b.ids for i in ids}) == listed:
        least = np.maximum(least, np.partition(lower, -own.k - 1, axis=1)[:, -own.k - 1])
    rows, others = np.nonzero(upper >= least[:, None])
    for at in range(0, len(rows), _PAIRS):
        r, o = rows[at : at + _PAIRS], others[at : at + _PAIRS]
        score = dots(a.scaled[r], b.scaled[o]) / (a.norm[r] * b.norm[o])
        near = np.flatnonzero(score >= own.least[first + r])
        for row, other, s in zip(r[near].tolist(), o[near].tolist(), score[near].tolist(), strict=True):
            for id_ in b.ids[other]:
                own.put(first + row, s, id_)
    return len(rows)


def usable(vector: str) -> Column:
    """Whether a vector is there, has no null or non-finite component, and is not all zeros."""
    infinity = F.lit(float("inf"))
    return (
        F.col(vector).isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < infinity))
        & F.exists(vector, lambda x: x != 0)
    )


def _rows(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _query_blocks(queries: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the distinct queries in blocks of about BLOCK_BYTES."""
    queries = queries.distinct()
    n = queries.count() * 8 * width // BLOCK_BYTES + 1
    for block in range(n):
        own = queries.where(F.pmod(F.xxhash64("id", "vector"), F.lit(n)) == block) if n > 1 else queries
        rows = own.collect()
        vectors = np.zeros((len(rows), width))
        for row, r in zip(vectors, rows, strict=True):
            row[: len(r.vector)] = r.vector
        yield np.array([r.id for r in rows], np.int64), vectors


def _block_matches(vectors: DataFrame, ids: np.ndarray, rows: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, salt): the ``k`` nearest of each query among each task's vectors."""
    width = rows.shape[1]
    step = max(TILE, BLOCK_BYTES // (8 * width))

    def run(batches):
        own = Nearest(shared_ids.value.tolist(), k)
        # Queries stay one row each; equal ones differ in the id they must not find.
        query_parts = [
            (at, _each(shared_ids.value[at : at + TILE], shared_rows.value[at : at + TILE]))
            for at in range(0, len(own.ids), TILE)
        ]
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                others = Vectors.of(
                    some["id"].to_numpy(zero_copy_only=False), _rows(some["vector"], width), k + 1
                )
                for to in range(0, len(others), TILE):
                    part = others.part(to)
                    for at, mine in query_parts:
                        search_tile(own, at, mine, part)
        found = [(q, -e[1], e[0]) for q, heap in zip(own.ids, own.heaps, strict=True) for e in heap]
        salt = TaskContext.get().partitionId() % SALTS
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64()),
             pa.array([salt] * len(found), pa.int32())],
            names=["query_id", "vec_id", "score", "salt"],
        )

    context = vectors.sparkSession.sparkContext
    shared_ids, shared_rows = context.broadcast(ids), context.broadcast(rows)
    return vectors.mapInArrow(run, "query_id long, vec_id long, score double, salt int")


def _each(ids: np.ndarray, rows: np.ndarray) -> Vectors:
    """Vectors of one row per id, in the given order."""
    found = Vectors.of(np.arange(len(ids)), rows)
    place = np.empty(len(ids), np.int64)
    for at, owners in enumerate(found.ids):
        place[owners] = at
    return Vectors(
        [[i] for i in ids.tolist()], found.scaled[place], found.norm[place], found.code[place],
        found.step[place], found.size[place], found.loss[place],
    )


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per query its ``k`` nearest vectors by cosine: query_id, rank from 1, vec_id, score.

    Exact: every pair is bounded or computed. Ids are whole numbers; a vector of the query's own id
    is never an answer, equal scores go by ascending id, and fewer rows come when there are fewer
    candidates. Null and zero vectors, those with null or non-finite components and rows without an
    id take no part. Rows that repeat count once; of several vectors with one id, or several queries
    with one id, the nearest pair counts. Shorter vectors end in zeros. Empty tables give no rows.
    """

    def chosen(df: DataFrame) -> DataFrame:
        df = df.select(
            df[id_col].cast("long").alias("id"),
            F.transform(df[vector_col], lambda x: x.cast("double")).alias("vector"),
        )
        return df.where(F.col("id").isNotNull() & usable("vector"))

    spark, vectors, queries = vectors.sparkSession, chosen(vectors), chosen(queries)
    width = vectors.select("vector").union(queries.select("vector"))
    width = width.agg(F.max(F.size("vector"))).first()[0] or 1
    scratch = Scratch(spark, "nearest")
    blocks = _query_blocks(queries, width)
    found = scratch.write_each((_block_matches(vectors, i, v, k) for i, v in blocks), "matches")

    def best(df: DataFrame, *keys: str) -> DataFrame:
        place = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    # Salted by task first: what meets for one query is at most k rows for each salt.
    found = found.repartition("query_id", "salt").groupBy("query_id", "salt", "vec_id")
    some = best(found.agg(F.max("score").alias("score")), "query_id", "salt").drop("rank")
    once = some.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(once.repartition("query_id"), "query_id").select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (
        SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)
            / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))) AS score
        FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
    SELECT * FROM (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                              AS INTEGER) AS rank, vec_id, score FROM p)
    WHERE rank <= {K}
"""


@query("op13_nearest_neighbours", ORACLE)
def op13(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
