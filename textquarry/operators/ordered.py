"""Order-dependent work on groups of any size.

A window over a whole group puts that group in one task. Here the rows, sorted by group and order,
are cut into blocks of about equal numbers of rows. Small groups share a block and are done there. Of a
group that crosses a border only the blocks' totals meet in one window, never the rows, so one hot
group still spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.functions.text import let

BLOCK = 10_000
# Rows that the borders of blocks are taken from; there are no more blocks than that.
SAMPLE = 4_096


def whole_quotient(value: Column, divisor: int) -> Column:
    """Integer division, exact for every bigint."""
    return F.call_function("div", value, F.lit(divisor)).cast("bigint")


def _borders(df: DataFrame, place: Column, block: int) -> tuple[Column, int]:
    """First places of all blocks but the first, ascending and about ``block`` rows apart, as a
    constant array, and how many they are.

    They come from the SAMPLE rows of the lowest hashes, which are a fair sample of any table, however
    its places are spread; the highest of these hashes also tells how many rows there are. They are
    fetched at once: one job over the group and order columns.
    """
    sample = df.select(F.xxhash64(place).alias("hash"), place.alias("place"))
    sample = sample.orderBy("hash").limit(SAMPLE)
    taken = F.count("*").cast("double")
    share = (F.max("hash").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    rows = F.when(taken < SAMPLE, taken).otherwise(taken / share)
    every = F.greatest(F.lit(1), F.ceil(taken * block / F.greatest(rows, F.lit(1.0))))
    places = sample.agg(F.array_sort(F.collect_list("place")).alias("places"), every.alias("every"))
    kept = F.filter("places", lambda _, i: (i > 0) & (i % F.col("every") == 0)).alias("first")
    first = places.select(kept)
    text, n = first.select(F.to_json("first"), F.size("first")).first()
    return F.from_json(F.lit(text), first.schema["first"].dataType), n


def _found(place: Column, keys: Sequence[str], first: Column, n: int) -> Column:
    """``struct<block, crosses>``: how many of ``n`` borders are at or before ``place``, and whether
    the group goes on beyond its block.

    A block begins with its border's row, so a group that goes on in the next block is its border's.
    """
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    at = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(first, at + step - 1) <= place, at + step).otherwise(at),
    )

    def crosses(border: Column) -> Column:
        same = [border[k] == F.col(k) for k in keys]
        return F.coalesce(reduce(Column.__and__, same, border.isNotNull()), F.lit(False))

    def told(at: Column) -> Column:
        beside = F.array(F.get(first, at), F.get(first, at - 1))
        return F.struct(at.cast("bigint").alias("block"), F.exists(beside, crosses).alias("crosses"))

    return let(at, told)


def prefix_sum(
    df: DataFrame,
    order: str,
    value: Column | int,
    out: str,
    keys: Sequence[str] = (),
    block: int = BLOCK,
    keep_block: bool = False,
    costly: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one inside its group.

    ``order`` is an integer column, or any that sorts, unique and not null inside a group; ``keys``
    are not null. Rows are shuffled once, by group and block. Blocks hold about ``block`` rows
    whatever the values of ``order`` and the sizes of groups, more when there are over SAMPLE blocks.
    With ``keep_block`` the rows also tell their ``_value``, their ``_block`` and its sums,
    ``_block_start`` before it and ``_block_end`` after it.

    Block totals are summed where the rows are read, from the columns they need. A ``costly`` value
    is computed behind the shuffle instead, where the work is even and the input is read once.
    """
    keys = list(keys)
    value = F.lit(value) if isinstance(value, int) else value
    place = F.struct(*keys, order)
    first, n = _borders(df, place, block)
    if n:
        blocked = df.select("*", _found(place, keys, first, n).alias("_found"))
        blocked = blocked.select(
            *df.columns, F.col("_found.block").alias("_block"), F.col("_found.crosses").alias("_crosses")
        )
    else:
        blocked = df.select("*", F.lit(0).cast("bigint").alias("_block"))
    if costly:
        blocked = blocked.repartition(*keys, "_block")
    rows = blocked.select("*", value.cast("bigint").alias("_value"))

    def before(*within: str, order_by: str, value: str) -> Column:
        frame = W.partitionBy(*within).orderBy(order_by)
        frame = frame.rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(frame), F.lit(0))

    if n:
        totals = rows.where("_crosses").groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
        # One group at most crosses a border, so there are two totals at most for each of SAMPLE borders.
        earlier = before(*keys, order_by="_block", value="_total").alias("_block_start")
        starts = totals.select(*keys, "_block", earlier)
        placed = rows.join(F.broadcast(starts), [*keys, "_block"], "left")
        start = F.coalesce("_block_start", F.lit(0))
    else:
        placed, start = rows, F.lit(0).cast("bigint")
    before_row = before(*keys, "_block", order_by=order, value="_value")
    whole_block = F.sum("_value").over(W.partitionBy(*keys, "_block"))
    block_columns = [
        "_value", "_block", start.alias("_block_start"), (start + whole_block).alias("_block_end")
    ]
    return placed.select(
        *[c for c in df.columns if c != out],
        (start + before_row).alias(out),
        *(block_columns if keep_block else []),
    )


def number_rows(
    df: DataFrame, order: str, out: str, keys: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Add ``out``: the row's place in its group, from 1, without gaps."""
    numbered = prefix_sum(df, order, 1, out, keys, block)
    return numbered.withColumn(out, F.col(out) + 1)


def rows_at(
    df: DataFrame, order: str, out: str, wanted: Callable[[Column], Column], block: int = BLOCK
) -> DataFrame:
    """The rows whose place ``out``, from 1 in ``order``, is ``wanted``.

    Only the order column is numbered; the rows are then found by it, so what is not wanted does not
    move, and nothing wide does while the wanted places are few enough to be sent to every task.
    """
    places = number_rows(df.select(order), order, out, block=block).where(wanted(F.col(out)))
    return df.join(places, order)


def with_lookback(
    df: DataFrame,
    position: str,
    reach: int,
    columns: dict[str, Column],
    keys: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Add aggregate ``columns`` over the ``reach`` rows before each row of its group.

    ``position`` counts a group's rows without gaps. Each row is lent to every block within its
    reach, so a window never needs a whole group. Rows grow by ``reach / block``.
    """
    place = F.col(position)
    own = whole_quotient(place, block)
    blocks = F.sequence(own, whole_quotient(place + reach, block))
    copies = F.transform(
        blocks, lambda b: F.struct(b.alias("block"), (b == own).alias("home"))
    )
    rows = df.withColumn("_copy", F.explode(copies))
    frame = (
        W.partitionBy(*keys, F.col("_copy.block")).orderBy(position).rowsBetween(-reach, -1)
    )
    return (
        rows.select("*", *[c.over(frame).alias(name) for name, c in columns.items()])
        .where("_copy.home")
        .drop("_copy")
    )


def ordered_list(value: Column, position: str = "pos") -> Column:
    """Aggregate: ``value`` of a bounded group in ``position`` order."""
    items = F.collect_list(F.struct(F.col(position).alias("at"), value.alias("value")))
    return F.transform(F.array_sort(items), lambda item: item["value"])
