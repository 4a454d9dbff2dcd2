"""Exact copies by a heavy-hitter split of text digests.

A mergeable frequent-items sketch (Misra-Gries counters, Spark's ``approx_top_k`` family) names the
digests that hold a large share of the rows. Their winners are computed exactly and broadcast, so
their rows are settled where they are and never meet in one task. All other digests go through an
ordinary shuffle, in which no group is larger than the sketch's error bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.tables import Scratch, query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tracked: int = 4096,
    spread: int = 64,
) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the largest id stays, a null id ranking lowest; of rows that repeat that id,
    exactly one stays. Every row is reported. An empty table gives an empty result. Other columns
    of ``docs`` play no part, whatever their names.

    tracked: counters of the sketch, a power of two. Digests with more than 1/tracked of the rows
    are heavy, so at most ``tracked`` rows are broadcast. spread: sketches merged side by side
    before the last merge.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-copies")
    text = F.coalesce(docs[text_col], F.lit(""))
    digests = scratch.write(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            docs[id_col].alias("doc_id"),
            F.unhex(F.sha2(F.translate(text, UPPER, LOWER), 256)).alias("digest"),
        ).withColumn("key", F.xxhash64("digest")),
        "digests",
    )
    sketches = digests.groupBy((F.spark_partition_id() % spread).alias("slot")).agg(
        F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("sketch"), F.count("*").alias("n")
    )
    frequent = (
        sketches.groupBy((F.col("slot") % 1).alias("all"))  # a key, so that no empty task takes part
        .agg(F.expr("approx_top_k_combine(sketch)").alias("sketch"), F.sum("n").alias("n"))
        .select("n", F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("top"))
        .where((F.col("top.count") > 1) & (F.col("top.count") * tracked > F.col("n")))
        .select(F.col("top.item").alias("key"))
    )
    winners = scratch.write(
        digests.join(F.broadcast(frequent), "key", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size")),
        "winners",
    )
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "*",
        F.max(F.struct("doc_id", "row")).over(group).alias("winner"),
        F.count("*").over(group).alias("group_size"),
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = f"""
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op6_exact_dedup", ORACLE)
def op6(spark, sf_dir):
    return exact_copies(table(spark, sf_dir, "documents"))
