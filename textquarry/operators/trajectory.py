"""Layer-to-layer displacement of hidden states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.vectors import l2_distance
from textquarry.operators.ordered import number_rows, with_lookback


def displacements(
    states: DataFrame, sequence: str = "seq_id", token: str = "token", layer: str = "layer",
    vector: str = "vec",
) -> DataFrame:
    """``(sequence, token, transition, step)``: L2 distance from each layer to the next."""
    keys = [sequence, token]
    numbered = number_rows(states, layer, "_place", keys).withColumn("_place", F.col("_place") - 1)
    lagged = with_lookback(numbered, "_place", 1, {"_before": F.first(vector)}, keys)
    return lagged.where(F.col("_place") > 0).select(
        *keys,
        F.col("_place").alias("transition"),
        l2_distance(F.col(vector), F.col("_before")).alias("step"),
    )


def mean_displacement(
    states: DataFrame, sequence: str = "seq_id", token: str = "token", layer: str = "layer",
    vector: str = "vec",
) -> DataFrame:
    """``(sequence, trajectory)``: mean over transitions of the mean over tokens.

    A sequence with one layer has no transition and gets 0.
    """
    steps = displacements(states, sequence, token, layer, vector)
    transitions = steps.groupBy(sequence, "transition").agg(F.avg("step").alias("step"))
    means = transitions.groupBy(sequence).agg(F.avg("step").alias("trajectory"))
    every = states.select(sequence).distinct().join(means, sequence, "left")
    return every.select(sequence, F.coalesce("trajectory", F.lit(0.0)).alias("trajectory"))


def total_loss(
    losses: DataFrame, trajectories: DataFrame, sequence: str = "seq_id", alpha: float = 0.01
) -> DataFrame:
    """Add ``trajectory`` and ``total_loss`` to ``(sequence, loss)``."""
    joined = losses.join(trajectories, sequence, "left").withColumn(
        "trajectory", F.coalesce("trajectory", F.lit(0.0))
    )
    return joined.withColumn("total_loss", F.col("loss") + F.lit(alpha) * F.col("trajectory"))
