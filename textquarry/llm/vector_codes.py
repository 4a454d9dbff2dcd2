"""Product codes of vectors over whole numbers, with exact limb-split matrix products.

Components become integers, vectors are cut into equal parts, and each part is coded by the first of
the nearest entries of its codebook. Distances come from float64 matrix products: integers are split
into limbs so short that no product of two limbs summed over a part passes 2 ** 53, and the products
are put together again in int64. Only sums per entry reach the driver, never vectors but the first
``entries``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.tables import Scratch, free_name, query, table

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
_EXACT_BITS = 53
_LIMB_BITS = 40  # of the sums that tasks hand on
_LONG_MAX = (1 << 63) - 1
_TILE_BYTES = 16 << 20


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """``a`` (int64) as float64 limbs of ``bits`` bits, lowest first; the last carries the sign."""
    out = []
    while a.size and (a.min() < -(1 << bits) or a.max() > 1 << bits):
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of two int64 matrices, exact wherever they fit in int64."""
    bits = (_EXACT_BITS - (a.shape[1] - 1).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:  # beyond, nothing is left modulo 2 ** 64
                out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def _size(a: np.ndarray) -> int:
    return int(max(abs(a.min()), abs(a.max()))) if a.size else 0


def first_nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of every row, and its squared distance.

    Both hold integers, int64 or Python's. Entries too far away for int64 are left out when they
    cannot be nearest; if they could be, Python's integers decide.
    """
    width, size = rows.shape[1], _size(rows)
    sizes = [_size(e) for e in entries]
    near = np.array([width * (size + s) ** 2 < 1 << 63 for s in sizes], bool)
    if near.any() and size <= _LONG_MAX:
        reach = width * (size + max(s for s, n in zip(sizes, near, strict=True) if n)) ** 2
        far = [s for s, n in zip(sizes, near, strict=True) if not n]
        if not far or (min(far) > size and reach < (min(far) - size) ** 2):
            own, kept = rows.astype(np.int64), entries[near].astype(np.int64)
            distance = exact_products(own, kept) * -2 + (kept * kept).sum(axis=1)
            at = distance.argmin(axis=1)  # the first of equal ones
            least = distance[np.arange(len(own)), at] + (own * own).sum(axis=1)
            return np.flatnonzero(near)[at], least
    gaps = rows.astype(object)[:, None, :] - entries.astype(object)[None]
    distance = (gaps * gaps).sum(axis=2)
    at = np.array([min(range(len(d)), key=d.__getitem__) for d in distance], np.int64)
    return at, distance[np.arange(len(rows)), at]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers: int64, or Python's integers if some are very large."""
    if _size(x) < 2.0**52 / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale) for v in x.ravel()]
    return np.array(whole, object).reshape(x.shape)


def usable(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    infinity = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x) < infinity)
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of float64; shorter ones end in zeros."""
    out = np.zeros((len(column), width))
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _tiles(column: pa.Array, width: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """Integer rows of a batch, some at a time; rows with very large numbers come on their own."""
    step = max(1, _TILE_BYTES // (8 * max(width, ENTRIES)))
    for at in range(0, len(column), step):
        yield at, integers(matrix(column.slice(at, step), width), scale)


def _parts(rows: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    size = rows.shape[1] // parts
    for part in range(parts):
        yield part, rows[:, part * size : (part + 1) * size]


def _sums(df: DataFrame, vector: str, books: list[np.ndarray], scale: int) -> DataFrame:
    """(slot, limb, value): per task, sums of the vectors nearest to each entry, and their number.

    Slot ((part * entries + entry) * (size + 1) + position) is a component's, the last position of
    an entry its count. Sums are cut into limbs, so that no size of input can overflow them.
    """
    parts, (entries, size) = len(books), books[0].shape
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        total = np.zeros((parts, entries, size + 1), object)
        for batch in batches:
            for _, rows in _tiles(batch[0], parts * size, scale):
                for part, own in _parts(rows, parts):
                    at, _ = first_nearest(own, shared.value[part])
                    order = np.argsort(at, kind="stable")
                    used, first = np.unique(at[order], return_index=True)
                    total[part, used, :size] += np.add.reduceat(own[order], first)
                    total[part, used, size] += np.diff([*first, len(at)])
        slot, limb, value = [], [], []
        for s, v in enumerate(total.ravel().tolist()):
            for k in range(v.bit_length() // _LIMB_BITS + 1 if v else 0):
                last = k == v.bit_length() // _LIMB_BITS
                slot.append(s)
                limb.append(k)
                rest = v >> (k * _LIMB_BITS)
                value.append(rest if last else rest & ((1 << _LIMB_BITS) - 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (slot, limb, value)], names=["slot", "limb", "value"]
        )

    rows = df.select(vector).mapInArrow(run, "slot long, limb long, value long")
    return rows.groupBy("slot", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("v"))


def codebooks(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> list[np.ndarray]:
    """One integer codebook (entries, size) for each part position, fitted on all usable rows.

    It starts as the vectors of the lowest ids (fewer entries if there are fewer rows; of rows with
    one id the lesser vector comes first, rows without an id start none) and moves to the floored
    means of what is nearest. The longest vector sets the width, rounded up to whole parts; shorter
    vectors end in zeros. Empty when no row can start an entry.
    """
    if entries > 256:
        raise ValueError("an index must fit in one byte")
    df = df.where(usable(vector_col)).select(
        df[id_col].alias("id"), df[vector_col].alias("vector")
    )
    longest = df.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(1, -(-longest // parts))
    first = df.where("id IS NOT NULL").orderBy("id", "vector").limit(entries)
    first = [r.vector for r in first.select("vector").collect()]
    if not first:
        return []
    seeds = np.zeros((len(first), parts * size))
    for row, vector in zip(seeds, first, strict=True):
        row[: len(vector)] = vector
    books = [own for _, own in _parts(integers(seeds, scale), parts)]
    for _ in range(rounds):
        sums: dict[int, int] = {}
        for r in _sums(df, "vector", books, scale).collect():  # one row per number of the books
            sums[r.slot] = sums.get(r.slot, 0) + (int(r.v) << (r.limb * _LIMB_BITS))
        for part, book in enumerate(books):
            rows = book.tolist()
            for entry in range(len(rows)):
                slot = (part * len(rows) + entry) * (size + 1)
                if n := sums.get(slot + size, 0):
                    rows[entry] = [sums.get(slot + i, 0) // n for i in range(size)]
            fits = all(abs(v) <= _LONG_MAX for row in rows for v in row)
            books[part] = np.array(rows, np.int64 if fits else object)
    return books


def encode(
    df: DataFrame,
    books: list[np.ndarray],
    vector_col: str,
    code_col: str = "code",
    error_col: str = "error",
    scale: int = SCALE,
) -> DataFrame:
    """The rows with a usable vector, with ``code_col`` (binary, one byte a part) and ``error_col``.

    The error is the sum of the parts' squared distances, at most 2 ** 63 - 1. The vector goes; the
    other columns stay, but for earlier ones of the two names. Vectors longer than the codebooks
    count up to their width only. Without codebooks there are no rows.
    """
    kept = [c for c in df.columns if c.lower() not in
            {n.lower() for n in (vector_col, code_col, error_col)}]
    vector = free_name(df.select(*kept), "vector")
    rows = df.where(usable(vector_col)).select(*kept, df[vector_col].alias(vector))
    schema = rows.drop(vector).schema.add(code_col, "binary").add(error_col, "long")
    if not books:
        return df.sparkSession.createDataFrame([], schema)
    parts, size = len(books), books[0].shape[1]
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            codes = np.zeros((batch.num_rows, parts), np.uint8)
            error = np.zeros(batch.num_rows, object)
            for at, whole in _tiles(batch[vector], parts * size, scale):
                for part, own in _parts(whole, parts):
                    nearest, distance = first_nearest(own, shared.value[part])
                    codes[at : at + len(own), part] = nearest
                    error[at : at + len(own)] += distance
            code = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(parts), len(codes), [None, pa.py_buffer(codes.tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(vector).columns, code,
                 pa.array([min(e, _LONG_MAX) for e in error.tolist()], pa.int64())],
                names=[*batch.schema.names[:-1], code_col, error_col],
            )

    return rows.mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    numbers = (str(v) for book in books for row in book.tolist() for v in row)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per usable row: id, code as hex, error, label_error and the digest of the codebooks.

    label_error sums the errors of all rows with an equal label (null is one label), at most
    2 ** 63 - 1. Rows that repeat count, and are returned, each time. Null vectors and those with
    null or non-finite components take no part; an empty table gives an empty result.
    """
    df = df.select(
        df[id_col].alias("vec_id"), df[vector_col].alias("vector"), df[label_col].alias("label")
    )
    books = codebooks(df, "vec_id", "vector")
    scratch = Scratch(df.sparkSession, "codes")
    coded = scratch.write(encode(df, books, "vector"), "rows")
    sums = coded.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG_MAX).cast("decimal(38,0)"))
        .cast("long")
        .alias("label_error")
    )
    sums = scratch.write(sums, "labels")  # of known size: broadcast when small, else joined
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


def _oracle() -> str:
    def assigned(book: str, out: str) -> str:
        return f"""{out} AS (
            SELECT vec_id, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, c.v),
                       lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.entry)) AS best
            FROM p JOIN {book} c ON p.part = c.part GROUP BY vec_id, p.part)"""

    def moved(book: str, near: str, out: str) -> str:
        return f"""{out} AS (
            SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM {book} c LEFT JOIN (
                SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                    SELECT p.part, a.best.e AS entry, i, CAST(sum(p.v[i]) AS BIGINT) AS s,
                           count(*) AS n
                    FROM {near} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part,
                         (SELECT unnest(range(1, (SELECT any_value(len(v)) FROM p) + 1)) AS i)
                    GROUP BY ALL) GROUP BY part, entry) m
            ON c.part = m.part AND c.entry = m.entry)"""

    return f"""WITH k AS (
            SELECT vec_id, label, list_transform(embedding,
                       lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding,
                lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1:
                                          (part + 1) * len(v) // {PARTS}] AS v
            FROM k, (SELECT unnest(range({PARTS})) AS part)),
        b0 AS (
            SELECT part, entry, v FROM p JOIN (
                SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry
                FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})) USING (vec_id)),
        {assigned("b0", "a0")}, {moved("b0", "a0", "b1")},
        {assigned("b1", "a1")}, {moved("b1", "a1", "b2")},
        {assigned("b2", "a2")},
        r AS (
            SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code,
                   CAST(sum(best.d) AS BIGINT) AS error
            FROM a2 GROUP BY vec_id)
        SELECT vec_id, code, error,
               CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry))
                FROM b2) AS codebooks_sha256
        FROM r JOIN k USING (vec_id)"""


@query("op11_vector_codes", _oracle())
def op11(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))
