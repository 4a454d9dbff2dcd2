"""Chat logs without snapshots: only conversations that no longer one starts with are rendered.

Turns are dealt by ranges of their order, so one conversation may fill many partitions. Running
values (position, prefix hashes, offset) are taken inside a partition and completed by what the
conversation holds in earlier partitions; at most one conversation crosses into each partition, so
these carried values are at most one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.tables import Scratch, query, table

HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MIDDLE), text, F.lit(TAIL))


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    both = F.lit(True)
    for name in names:
        both &= left[name].eqNullSafe(right[name])
    return both


def maximal_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn of every maximal conversation; its pieces by pos are the rendered whole.

    Columns conv_id, pos (from 1), role, start (code points before it), piece, trained (an answer),
    copies (logged conversations equal to this one). A conversation whose turns, in order, begin a
    longer one is left out; of equal ones the smallest conv_id stays. Two turns are equal when role
    and text are.

    A null text is empty and a null role is ``user``. Turns that share a number, null first, follow
    by role and a hash of their text, so repeated rows are repeated turns. Turns without a conv_id
    are one conversation. An empty table gives an empty result; other columns play no part.
    """
    scratch = Scratch(turns.sparkSession, "chats")
    role = F.coalesce(turns[role_col], F.lit("user")).alias("role")
    text = F.coalesce(turns[text_col], F.lit("")).alias("text")
    order = ["turn", "role", "h1", "h2"]
    ordered = scratch.write(
        turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), role, text)
        .select(
            "*",
            F.xxhash64("role", "text").alias("h1"),
            F.xxhash64(F.lit(1), "text", "role").alias("h2"),
            F.length(rendered(F.col("role"), F.col("text"))).cast("long").alias("chars"),
        )
        .repartitionByRange("conv_id", *order)
        .select(
            "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")
        ),
        "ordered",
    )
    block = ["part", "conv_id"]
    inside = Window.partitionBy(*block).orderBy(*order, "row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    later = Window.partitionBy("conv_id").orderBy("part").rowsBetween(
        1, Window.unboundedFollowing
    )

    def carried(totals: DataFrame, step: str, **sums: Column) -> DataFrame:
        parts = totals.select(*block, *[c.alias(n) for n, c in sums.items()])
        return scratch.write(parts.where(F.col("crosses")), step)

    def complete(rows: DataFrame, extra: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(extra), _same(rows, extra, *block), "left").drop(
            *[extra[c] for c in block], extra["crosses"]
        )

    counts = ordered.groupBy(*block).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    extra = carried(
        counts,
        "counts",
        before=F.coalesce(F.sum("n").over(earlier), F.lit(0)),
        chars_before=F.coalesce(F.sum("chars").over(earlier), F.lit(0)),
        goes_on=F.count("*").over(later) > 0,
        crosses=F.count("*").over(Window.partitionBy("conv_id")) > 1,
    )
    local = ordered.drop("text").select(
        "*",
        F.row_number().over(inside).alias("at"),
        F.sum("chars").over(so_far).alias("until"),
        F.lead("row").over(inside).isNull().alias("ends"),
    )
    pos = F.coalesce(F.col("before"), F.lit(0)) + F.col("at")
    placed = scratch.write(
        complete(local, extra).select(
            "row",
            *block,
            *order,
            pos.alias("pos"),
            (F.coalesce(F.col("chars_before"), F.lit(0)) + F.col("until") - F.col("chars")).alias(
                "start"
            ),
            (F.col("ends") & ~F.coalesce(F.col("goes_on"), F.lit(False))).alias("last"),
            # A turn counts with its place, so the exclusive or of all turns knows their order.
            F.xxhash64(pos, "h1").alias("x1"),
            F.xxhash64(F.lit(2), pos, "h2").alias("x2"),
        ),
        "placed",
    )
    totals = placed.groupBy(*block).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    extra = carried(
        totals,
        "hashes",
        y1=F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)),
        y2=F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)),
        crosses=F.count("*").over(Window.partitionBy("conv_id")) > 1,
    )
    local = placed.select(
        *block,
        "pos",
        "last",
        F.bit_xor("x1").over(so_far).alias("x1"),
        F.bit_xor("x2").over(so_far).alias("x2"),
    )
    prefixes = scratch.write(
        complete(local, extra).select(
            "conv_id",
            "pos",
            "last",
            F.coalesce(F.col("y1"), F.lit(0)).bitwiseXOR(F.col("x1")).alias("x1"),
            F.coalesce(F.col("y2"), F.lit(0)).bitwiseXOR(F.col("x2")).alias("x2"),
        ),
        "prefixes",
    )
    whole = ["pos", "x1", "x2"]
    logged = prefixes.where("last").groupBy(*whole)
    logged = logged.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = prefixes.where("NOT last").select(*whole).distinct()
    maximal = logged.join(begun, whole, "left_anti").select("conv_id", "copies")
    kept = placed.select("conv_id", "row", "pos", "start")
    kept = kept.join(maximal, _same(kept, maximal, "conv_id")).drop(maximal["conv_id"])
    return (
        ordered.select("row", "role", "text")
        .join(kept, "row")
        .select(
            "conv_id",
            F.col("pos").cast("long").alias("pos"),
            "role",
            "start",
            rendered(F.col("role"), F.col("text")).alias("piece"),
            (F.col("role") == TRAINED_ROLE).alias("trained"),
            "copies",
        )
    )


ORACLE = f"""
    WITH t AS (
        SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
               count(*) OVER (PARTITION BY conv_id) AS n
        FROM conversations
    ), p AS (
        SELECT *, '{HEAD}' || role || '{MIDDLE}' || text || '{TAIL}' AS piece,
               string_agg(role || chr(1) || text, chr(2)) OVER (
                   PARTITION BY conv_id ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
        FROM t
    ), w AS (
        SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies
        FROM p WHERE pos = n GROUP BY prefix
    ), k AS (
        SELECT conv_id, copies FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n)
    )
    SELECT conv_id, pos, role, piece, role = '{TRAINED_ROLE}' AS trained, copies,
           CAST(coalesce(sum(length(piece)) OVER (
               PARTITION BY conv_id ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM p JOIN k USING (conv_id)
"""


@query("op8_chat_format", ORACLE)
def op8(spark, sf_dir):
    return maximal_conversations(table(spark, sf_dir, "conversations"))
