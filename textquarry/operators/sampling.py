"""Exact-size seeded sample and systematic sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators.ordered import rows_at

# Hex digits of the hash told apart per counting pass: 4,096 bins each.
DIGITS = 3
# Rows of one bin that are ranked without counting once more.
RANKED = 100_000


def _draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``n`` rows without replacement (all when fewer), the same for any partitioning.

    The sample is the ``n`` lowest hashes of the unique ``key``. Passes over the key column, run when
    the plan is made, count bins of the hash until the one where rank ``n`` falls is small, and only
    that bin is ranked, so no task meets the candidates of every other task. Documents are then kept
    by comparing their hash with a constant: texts are neither sorted nor shuffled.
    """
    if n <= 0:
        return df.where(F.lit(False))
    ticket = F.struct(_draw(seed, key).alias("h"), F.col(key).alias("k"))
    near = df.where(F.col(key).isNotNull()).select(ticket.alias("ticket"))
    prefix, before = "", 0
    while True:
        bins = near.groupBy(F.left("ticket.h", F.lit(len(prefix) + DIGITS)).alias("bin"))
        found = None
        for bin_, rows in sorted(bins.count().collect()):  # 4,096 rows at most
            if before + rows >= n:
                found = bin_, rows
                break
            before += rows
        if found is None:  # fewer than n in all
            return df
        prefix, rows = found
        near = near.where(F.startswith("ticket.h", F.lit(prefix)))
        if rows <= RANKED or len(prefix) + DIGITS > 32:
            break
    last = near.orderBy("ticket").limit(n - before).agg(F.max("ticket").alias("t")).first()["t"]
    bound = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).alias("k"))
    return df.where(ticket <= bound)


def every_nth(df: DataFrame, position: str, n: int = 5) -> DataFrame:
    """Every ``n``-th row starting with the first; ``position`` counts from 1."""
    return df.where((F.col(position) - 1) % n == 0)


def nth_rows(df: DataFrame, order: str, position: str = "row", n: int = 5) -> DataFrame:
    """Number the rows from 1 in ``order`` and keep every ``n``-th, starting with the first."""
    return rows_at(df, order, position, lambda place: (place - 1) % n == 0)
