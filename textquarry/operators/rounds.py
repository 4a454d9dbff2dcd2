"""Bookkeeping of tuning rounds: loss curves, history, review prompts, records, best round.

A round is identified by ``run_id`` and ``round``. Losses come as ``(run_id, round, step, loss)``
with ``step`` an integer unique in its round. All rounds of all runs are processed at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import templates
from textquarry.functions.parsing import extract_object
from textquarry.functions.prompts import split_template
from textquarry.functions.text import fixed_decimals, truncate_answer_lines, truncated_lengths
from textquarry.operators.evaluation import sampled_answers
from textquarry.operators.ordered import (
    number_rows,
    ordered_list,
    with_lookback,
)
from textquarry.operators.patches import (
    Bounds,
    apply_patch,
    bounds_table,
    number_text,
    tunable,
)
from textquarry.session import stage
from textquarry.sources.tiers import BOUNDS

ROUND = ["run_id", "round"]
SAMPLE_STEP = 5


def first_last_loss(losses: DataFrame) -> DataFrame:
    """``(run_id, round, start_loss, end_loss, n_losses)``; rounds without a loss have no row."""
    return losses.groupBy(*ROUND).agg(
        F.min_by("loss", "step").alias("start_loss"),
        F.max_by("loss", "step").alias("end_loss"),
        F.count("*").alias("n_losses"),
    )


def loss_lines(losses: DataFrame) -> DataFrame:
    """``(run_id, round, pos, line)`` in step order."""
    numbered = number_rows(losses, "step", "pos", ROUND)
    line = F.concat(
        F.lit("  step "), F.format_string("%4d", "step"), F.lit(": loss="), fixed_decimals("loss")
    )
    return numbered.select(*ROUND, "pos", line.alias("line"))


def loss_summary(losses: DataFrame) -> DataFrame:
    """``(run_id, round, pos, text)``: the loss curve, a row per line."""
    return loss_lines(losses).withColumnRenamed("line", "text")


def best_round(rounds: DataFrame) -> DataFrame:
    """The round with the lowest last loss in each run, the earlier one among equals."""
    best = F.min_by(F.struct("round", "end_loss"), F.struct("end_loss", "round"))
    return rounds.groupBy("run_id").agg(best.alias("b")).select("run_id", "b.*")


def with_outcome(losses: DataFrame, proposals: DataFrame, bounds: Bounds = BOUNDS) -> DataFrame:
    """One row per round with losses: first and last loss, patch, changes and next settings.

    ``proposals`` holds ``(run_id, round, config, response)``, where ``config`` is the settings map
    the answer in ``response`` was asked about. No round depends on the row of another one.
    """
    rounds = first_last_loss(losses).join(proposals, ROUND, "left")
    no_settings = F.create_map().cast("map<string,double>")
    patched = rounds.withColumns(
        {
            "config": F.coalesce("config", no_settings),
            "response": F.coalesce("response", F.lit("")),
            "patch": extract_object("response"),
        }
    )
    return apply_patch(patched, bounds=bounds)


def with_round_history(rounds: DataFrame, reach: int = 3) -> DataFrame:
    """Add ``history``: a line for each of up to ``reach`` earlier rounds of the run."""
    changes = F.concat(
        F.lit("["),
        F.array_join(
            F.transform("changes", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "
        ),
        F.lit("]"),
    )
    line = F.concat(
        F.lit("\n  Round "), F.col("round").cast("string"),
        F.lit(": changes="), changes,
        F.lit(", start_loss="), fixed_decimals("start_loss"),
        F.lit(", end_loss="), fixed_decimals("end_loss"),
    )
    placed = number_rows(rounds, "round", "_place", ["run_id"])
    placed = placed.withColumn("_place", F.col("_place") - 1).withColumn("_line", line)
    reached = with_lookback(
        placed, "_place", reach, {"_lines": F.collect_list("_line")}, ["run_id"]
    )
    history = F.when(F.size("_lines") > 0, F.array_join("_lines", "")).otherwise(
        F.lit(templates.NO_ROUNDS)
    )
    return reached.select(*rounds.columns, history.alias("history"))


def settings_json(config: Column | str, bounds: Bounds = BOUNDS) -> Column:
    """Tunable settings as indented JSON, in bounds order."""
    config = F.col(config) if isinstance(config, str) else config
    known = F.filter(bounds_table(bounds), lambda b: F.map_contains_key(config, b["key"]))
    entries = F.transform(
        known,
        lambda b: F.concat(
            F.lit('  "'),
            b["key"],
            F.lit('": '),
            number_text(F.try_element_at(config, b["key"]), b["whole"]),
        ),
    )
    return F.when(F.size(known) == 0, "{}").otherwise(
        F.concat(F.lit("{\n"), F.array_join(entries, ",\n"), F.lit("\n}"))
    )


def round_reviews(
    losses: DataFrame,
    rounds: DataFrame,
    results: DataFrame,
    bounds: Bounds = BOUNDS,
) -> DataFrame:
    """``(run_id, round, pos, text)``: the review prompt of every round.

    ``rounds`` comes from ``with_round_history``, ``results`` holds ``(run_id, round, q, question,
    answer)``. The prompt is laid out as numbered pieces which, joined in order, are the whole: a
    round with a huge curve or answer sheet never meets in one task. The rounds and the sampled
    answers are stored once, when the plan is made.
    """
    before, after_round, after_config, after_losses, after_history, after_answers = [
        F.lit(literal) for literal, _ in split_template(templates.ROUND_REVIEW)
    ]
    # Each is read twice below: once for the pieces, once for how many there are.
    rounds = stage(rounds.select(*ROUND, "config", "history", "n_losses"), "rounds")
    answers = stage(sampled_answers(results, ROUND, SAMPLE_STEP), "sampled")
    n_answers = answers.groupBy(*ROUND).agg(F.count("*").alias("n_answers"))
    frame = rounds.join(n_answers, ROUND, "left").withColumn(
        "n_answers", F.coalesce("n_answers", F.lit(0))
    )

    def piece(position: Column, text: Column) -> list[Column]:
        return [*[F.col(k) for k in ROUND], position.cast("bigint").alias("pos"), text.alias("text")]

    def after_first(separator: str, line: str) -> Column:
        return F.when(F.col("pos") > 1, F.concat(F.lit(separator), line)).otherwise(F.col(line))

    head = F.concat(
        before, F.col("round").cast("string"), after_round, settings_json("config", bounds),
        after_config,
    )
    heading = F.when(F.col("n_answers") > 0, F.lit(templates.ANSWERS_HEADING))
    middle = F.concat(
        after_losses, "history", after_history, F.coalesce(heading, F.lit(""))
    )
    own = F.array(
        F.struct(F.lit(1).cast("bigint").alias("pos"), head.alias("text")),
        F.struct((F.col("n_losses") + 2).alias("pos"), middle.alias("text")),
        F.struct((F.col("n_losses") + F.col("n_answers") + 3).alias("pos"), after_answers.alias("text")),
    )
    framed = frame.select(*ROUND, F.inline(own))
    curve = loss_lines(losses).select(*piece(F.col("pos") + 1, after_first("\n", "line")))
    sampled = answers.join(rounds.select(*ROUND, "n_losses"), ROUND).select(
        *piece(F.col("n_losses") + 2 + F.col("pos"), after_first("\n\n", "line"))
    )
    return framed.unionByName(curve).unionByName(sampled)


def fit_budget(
    prompts: DataFrame,
    keys: Sequence[str],
    budget: int,
    text: str = "text",
    limits: Sequence[int] = (500, 200, 100),
) -> DataFrame:
    """Shorten answer lines just enough for the whole prompt to fit ``budget`` characters.

    Adds ``answer_limit`` (null for the full text) and ``fits``; when even the last limit is too
    long ``text`` is null and ``fits`` false. Works on prompts in pieces: lengths are summed over
    them, and answer lines never cross a border of pieces.
    """
    tries: list[int | None] = [None, *limits]

    def version(limit: int | None) -> Column:
        return F.col(text) if limit is None else truncate_answer_lines(text, limit)

    counted = prompts.select(*keys, truncated_lengths(text, tries).alias("_lengths"))
    lengths = counted.groupBy(*keys).agg(
        *[F.sum(F.get("_lengths", F.lit(i))).alias(f"_len{i}") for i in range(len(tries))]
    )
    choice = F.coalesce(
        *[F.when(F.col(f"_len{i}") <= budget, F.lit(i)) for i in range(len(tries))]
    )
    chosen = lengths.select(*keys, choice.alias("_choice"))

    def pick(values: list[Column]) -> Column:
        out = F.when(F.col("_choice") == 0, values[0])
        for i, value in enumerate(values[1:], start=1):
            out = out.when(F.col("_choice") == i, value)
        return out

    others = [c for c in prompts.columns if c != text]
    return prompts.join(chosen, list(keys)).select(
        *others,
        pick([F.lit(limit).cast("int") for limit in tries]).alias("answer_limit"),
        F.col("_choice").isNotNull().alias("fits"),
        pick([version(limit) for limit in tries]).alias(text),
    )


def round_records(
    losses: DataFrame,
    rounds: DataFrame,
    output_dir: str,
    bounds: Bounds = BOUNDS,
    timestamp: Column | None = None,
) -> DataFrame:
    """Nested record of every round, as written to the experiment log: one row each.

    A record holds its round's whole loss log, which is as long as the round had logged steps.
    ``timestamp`` is when the round was recorded, now by default.
    """
    recorded = F.current_timestamp() if timestamp is None else timestamp
    logs = losses.groupBy(*ROUND).agg(
        ordered_list(F.struct("step", "loss"), "step").alias("loss_log")
    )
    name = F.concat(F.lit(f"{output_dir}/round_"), F.format_string("%02d", "round"))
    return logs.join(rounds, ROUND).select(
        *ROUND,
        F.date_format(recorded, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        tunable("config", bounds).alias("config"),
        "loss_log",
        "start_loss",
        "end_loss",
        F.col("response").alias("lm_response"),
        "patch",
        "changes",
        F.concat(name, F.lit("_adapter")).alias("adapter_dir"),
        F.concat(name, F.lit("_answers.txt")).alias("eval_answers"),
    )
