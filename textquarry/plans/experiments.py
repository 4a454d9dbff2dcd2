"""Reports, chat windows, tuning rounds, packing and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import templates, tokens
from textquarry.functions.parsing import extract_object
from textquarry.functions.prompts import split_template
from textquarry.functions.text import strip, word_count
from textquarry.operators import chat, evaluation, packing, patches, rounds, trajectory
from textquarry.operators.ordered import whole_quotient
from textquarry.plans.registry import (
    SQL_QUESTIONS,
    SQL_SHEETS,
    answer_sheets,
    corpus,
    dialogue,
    non_blank,
    query,
    sql_render,
    sql_strip,
    sql_text,
    sql_tokens,
    sql_words,
    table,
)
from textquarry.session import staging_path
from textquarry.sources import sinks
from textquarry.sources.evalsets import numbered_questions
from textquarry.sources.tiers import BOUNDS, TIERS

# -- events read as loss logs: one run per user, one round per event type, event_id as step

EVENT_ROUNDS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
SQL_ROUND = "CAST(CASE event_type " + " ".join(
    f"WHEN '{name}' THEN {n}" for name, n in EVENT_ROUNDS.items()
) + " END AS BIGINT)"
SQL_LOSSES = f"""
    SELECT user_id AS run_id, {SQL_ROUND} AS round, event_id AS step, value AS loss FROM events
"""

# The base settings of every run; ``k`` is what the events propose to change.
SETTINGS = {name: float(TIERS["8gb"][name]) for name in BOUNDS} | {"k": 50.0, "seed": 3407.0}
K_BOUNDS = {"k": (10, 90, True)} | BOUNDS


def _round() -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, n in EVENT_ROUNDS.items():
        out = out.when(F.col("event_type") == name, F.lit(n))
    return out.cast("bigint")


def loss_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        _round().alias("round"),
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
    )


def _settings() -> Column:
    entries = [part for name, value in SETTINGS.items() for part in (F.lit(name), F.lit(value))]
    return F.create_map(*entries)


def _proposals(spark, sf_dir) -> DataFrame:
    """Each round's answer: the object of its last event, in prose."""
    events = table(spark, sf_dir, "events").withColumn("round", _round())
    last = events.groupBy(F.col("user_id").alias("run_id"), "round").agg(
        F.max_by("props", "event_id").alias("props")
    )
    return last.select(
        "run_id",
        "round",
        _settings().alias("config"),
        F.concat(F.lit("Try this:\n"), "props").alias("response"),
    )


def _outcome(spark, sf_dir) -> DataFrame:
    return rounds.with_outcome(loss_table(spark, sf_dir), _proposals(spark, sf_dir), K_BOUNDS)


SQL_OUTCOME = f"""
    SELECT *, CASE WHEN k <> 50 THEN '  k: 50 → ' || k END AS change FROM (
        SELECT user_id AS run_id, {SQL_ROUND} AS round, min_by(value, event_id) AS start_loss,
               max_by(value, event_id) AS end_loss, count(*) AS n_losses,
               max_by(props, event_id) AS props,
               greatest(10, least(90, CAST(json_extract_string(max_by(props, event_id), '$.k')
                                           AS BIGINT))) AS k
        FROM events GROUP BY ALL)
"""
SQL_LOSS_LINE = "printf('  step %4d: loss=%.4f', step, loss)"


@query(
    "a_first_last_loss",
    f"""WITH l AS ({SQL_LOSSES})
        SELECT run_id, round, min_by(loss, step) AS start_loss, max_by(loss, step) AS end_loss,
               count(*) AS n_losses
        FROM l GROUP BY run_id, round""",
)
def first_last(spark, sf_dir) -> DataFrame:
    return rounds.first_last_loss(loss_table(spark, sf_dir))


@query(
    "a_loss_summary",
    f"""WITH l AS ({SQL_LOSSES}),
        n AS (SELECT *, row_number() OVER (PARTITION BY run_id, round ORDER BY step) AS pos FROM l)
        SELECT run_id, round, pos, {SQL_LOSS_LINE} AS text FROM n""",
)
def loss_summary(spark, sf_dir) -> DataFrame:
    return rounds.loss_summary(loss_table(spark, sf_dir))


@query(
    "a_best_round",
    f"""WITH l AS ({SQL_LOSSES}),
        r AS (SELECT run_id, round, max_by(loss, step) AS end_loss FROM l GROUP BY run_id, round)
        SELECT run_id, round, end_loss FROM r
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY end_loss, round) = 1""",
)
def best(spark, sf_dir) -> DataFrame:
    return rounds.best_round(rounds.first_last_loss(loss_table(spark, sf_dir)))


SQL_HISTORY = f"""
    SELECT *, coalesce(nullif(array_to_string(list(
        chr(10) || '  Round ' || round || ': changes=['
        || coalesce('''' || change || '''', '') || '], start_loss=' || printf('%.4f', start_loss)
        || ', end_loss=' || printf('%.4f', end_loss))
        OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ''),
        ''), {sql_text(templates.NO_ROUNDS)}) AS history
    FROM ({SQL_OUTCOME})
"""


@query("w_round_history", f"SELECT run_id, round, history FROM ({SQL_HISTORY})")
def round_history(spark, sf_dir) -> DataFrame:
    history = rounds.with_round_history(_outcome(spark, sf_dir))
    return history.select("run_id", "round", "history")


SQL_RECORDS = f"""WITH l AS ({SQL_LOSSES}),
        c AS (SELECT run_id, round, string_agg(step || '=' || loss, ' ' ORDER BY step) AS loss_log
              FROM l GROUP BY run_id, round)
        SELECT run_id, round, '2026-01-02T03:04:05' AS timestamp, {len(K_BOUNDS)} AS n_settings, 50.0::DOUBLE AS k, loss_log,
               start_loss, end_loss, 'Try this:' || chr(10) || props AS lm_response,
               json_extract_string(props, '$.k') AS patch_k,
               coalesce(change, '') AS changes,
               printf('out/round_%02d_adapter', round) AS adapter_dir,
               printf('out/round_%02d_answers.txt', round) AS eval_answers
        FROM ({SQL_OUTCOME}) JOIN c USING (run_id, round)"""


def _records(spark, sf_dir) -> DataFrame:
    return rounds.round_records(
        loss_table(spark, sf_dir), _outcome(spark, sf_dir), "out", K_BOUNDS,
        F.to_timestamp(F.lit("2026-01-02 03:04:05")),
    )


def _shown(records: DataFrame) -> DataFrame:
    """Records with their nested fields shown as text."""
    entry = lambda e: F.concat(e["step"].cast("string"), F.lit("="), e["loss"].cast("string"))
    return records.select(
        "run_id",
        "round",
        "timestamp",
        F.size("config").alias("n_settings"),
        F.try_element_at("config", F.lit("k")).alias("k"),
        F.array_join(F.transform("loss_log", entry), " ").alias("loss_log"),
        "start_loss",
        "end_loss",
        "lm_response",
        F.try_element_at("patch", F.lit("k")).cast("string").alias("patch_k"),
        F.array_join("changes", "|").alias("changes"),
        "adapter_dir",
        "eval_answers",
    )


@query("a_round_records", SQL_RECORDS)
def round_records(spark, sf_dir) -> DataFrame:
    return _shown(_records(spark, sf_dir))


@query("k_round_log", SQL_RECORDS)
def round_log(spark, sf_dir) -> DataFrame:
    """The log written as ordered JSON arrays and read back."""
    path, records = staging_path(spark, "rounds"), _records(spark, sf_dir)
    sinks.write_round_log(records, path, files=None)
    return _shown(spark.read.schema(records.schema).option("mode", "FAILFAST").json(path))


SQL_CONFIG = "{\n" + ",\n".join(
    f'  "{name}": {SETTINGS[name] if not whole else int(SETTINGS[name])}'
    for name, (_, _, whole) in K_BOUNDS.items()
) + "\n}"

# One sheet of answers per round: the documents whose number is the run and whose next is its round.
SQL_ROUND_SHEETS = f"""
    SELECT run_id // 5 AS run_id, run_id % 5 + 1 AS round, q, question, answer
    FROM ({SQL_SHEETS}) JOIN ({SQL_QUESTIONS}) USING (q)
"""


def _round_sheets(spark, sf_dir) -> DataFrame:
    questions = numbered_questions(table(spark, sf_dir, "benchmark"))
    sheets = evaluation.question_answers(questions, answer_sheets(spark, sf_dir))
    return sheets.withColumn("round", F.col("run_id") % 5 + 1).withColumn(
        "run_id", whole_quotient(F.col("run_id"), 5)
    )


SQL_SAMPLED = f"""
    SELECT run_id, round, (q - 1) // 5 + 1 AS pos,
           printf('Q%03d: ', q) || question || chr(10) || 'A: ' || left(answer, 600)
           || CASE WHEN length(answer) > 600 THEN '…' ELSE '' END AS text
    FROM ({SQL_ROUND_SHEETS}) WHERE (q - 1) % 5 = 0
"""
REVIEW = [sql_text(literal) for literal, _ in split_template(templates.ROUND_REVIEW)]


@query(
    "c_round_review",
    f"""WITH l AS ({SQL_LOSSES}),
        c AS (SELECT run_id, round, row_number() OVER w AS pos, {SQL_LOSS_LINE} AS text
              FROM l WINDOW w AS (PARTITION BY run_id, round ORDER BY step)),
        a AS ({SQL_SAMPLED}),
        h AS (SELECT run_id, round, history, count(DISTINCT c.pos) AS n, count(DISTINCT a.pos) AS m
              FROM ({SQL_HISTORY}) JOIN c USING (run_id, round) LEFT JOIN a USING (run_id, round)
              GROUP BY ALL)
        SELECT run_id, round, 1 AS pos, {REVIEW[0]} || round || {REVIEW[1]}
               || {sql_text(SQL_CONFIG)} || {REVIEW[2]} AS text FROM h
        UNION ALL
        SELECT run_id, round, pos + 1, CASE WHEN pos > 1 THEN chr(10) ELSE '' END || text FROM c
        UNION ALL
        SELECT run_id, round, n + 2, {REVIEW[3]} || history || {REVIEW[4]}
               || CASE WHEN m > 0 THEN {sql_text(templates.ANSWERS_HEADING)} ELSE '' END FROM h
        UNION ALL
        SELECT run_id, round, n + 2 + pos,
               CASE WHEN pos > 1 THEN chr(10) || chr(10) ELSE '' END || text
        FROM a JOIN h USING (run_id, round)
        UNION ALL
        SELECT run_id, round, n + m + 3, {REVIEW[5]} FROM h""",
)
def round_review(spark, sf_dir) -> DataFrame:
    history = rounds.with_round_history(_outcome(spark, sf_dir))
    return rounds.round_reviews(
        loss_table(spark, sf_dir), history, _round_sheets(spark, sf_dir), K_BOUNDS
    )


@query(
    "m_clamp_patch",
    """WITH p AS (
           SELECT event_id, 'k' AS key, 50.0 AS current,
                  greatest(10, least(90, CAST(json_extract_string(props, '$.k') AS DOUBLE))) AS v,
                  CAST(CAST(v AS BIGINT) AS VARCHAR) AS shown, v AS kept
           FROM events
           UNION ALL
           SELECT event_id, 'r', 16.0, greatest(4, least(64, value)) AS v,
                  CASE WHEN value <= 4 THEN '4' WHEN value >= 64 THEN '64'
                       ELSE CAST(value AS VARCHAR) END, trunc(v)
           FROM events)
       SELECT event_id, key, current::DOUBLE AS current,
              CASE WHEN v <> current THEN kept ELSE current END::DOUBLE AS stored,
              CASE WHEN v <> current THEN '  ' || key || ': ' || CAST(current AS BIGINT) || ' → '
                   || shown ELSE '' END AS change
       FROM p
       UNION ALL  -- a text is no number: the proposal changes nothing
       SELECT event_id, 'warmup_steps', 50.0::DOUBLE, 50.0::DOUBLE, '' FROM events""",
)
def clamp_patch(spark, sf_dir) -> DataFrame:
    """Each event proposes its ``k``, its value as ``r``, a key that is not tunable and a text."""
    response = F.concat(
        F.rtrim("props", F.lit("}")), F.lit(', "r": '), F.col("value").cast("string"),
        F.lit(', "optim": 3, "warmup_steps": "7"}'),
    )
    asked = table(spark, sf_dir, "events").select(
        "event_id", _settings().alias("config"), extract_object(response).alias("patch")
    )
    changes = patches.patch_rows(asked, ["event_id"], bounds=K_BOUNDS)
    return changes.fillna("", ["change"])


# -- answer sheets and reports


@query(
    "a_sample_answers",
    SQL_SAMPLED,
)
def sample_answers(spark, sf_dir) -> DataFrame:
    lines = evaluation.sampled_answers(_round_sheets(spark, sf_dir), rounds.ROUND)
    return lines.withColumnRenamed("line", "text")


RULE, THIN = "=" * 70, "-" * 70


@query(
    "k_closed_report",
    f"""WITH r AS (SELECT run_id, q, question, answer
                   FROM ({SQL_SHEETS}) JOIN ({SQL_QUESTIONS}) USING (q))
        SELECT run_id, 0 AS pos, 'BATCH TEST RESULTS' || chr(10) || 'Model: sheet ' || run_id
               || chr(10) || 'Questions answered: ' || count(*) || '/'
               || (SELECT count(*) FROM benchmark) || chr(10) || '{RULE}' || chr(10) AS text
        FROM r GROUP BY run_id
        UNION ALL
        SELECT run_id, q, printf('Q%03d. ', q) || question || chr(10) || '{THIN}' || chr(10)
               || answer || chr(10)
        FROM r""",
)
def closed_report(spark, sf_dir) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    results = evaluation.question_answers(
        numbered_questions(benchmark), answer_sheets(spark, sf_dir)
    )
    label = F.concat(F.lit("sheet "), F.col("run_id").cast("string"))
    total = benchmark.agg(F.count("*"))
    return evaluation.closed_book_report(results, total, label, ["run_id"])


@query(
    "k_round_report",
    f"""SELECT run_id, round, 0 AS pos, 'ROUND ' || round || ' — BENCHMARK ANSWERS' || chr(10)
               || '{RULE}' || chr(10) AS text
        FROM ({SQL_ROUND_SHEETS}) GROUP BY run_id, round
        UNION ALL
        SELECT run_id, round, q, printf('Q%03d. ', q) || question || chr(10) || '{THIN}' || chr(10)
               || answer || chr(10)
        FROM ({SQL_ROUND_SHEETS})""",
)
def round_report(spark, sf_dir) -> DataFrame:
    return evaluation.round_report(_round_sheets(spark, sf_dir), rounds.ROUND)


@query(
    "k_open_report",
    f"""WITH r AS (SELECT doc_id + 1 AS row, lang, 'What is in it?' AS question,
                          len({sql_words("text")}) AS context_length, text AS answer
                   FROM documents)
        SELECT lang, 0 AS pos, 'RAG EVALUATION RESULTS' || chr(10) || 'Model  : ' || lang
               || chr(10) || 'Input  : documents' || chr(10) || 'Rows answered: ' || count(*)
               || '/' || (SELECT count(*) FROM documents) || chr(10) || '{RULE}' || chr(10) AS text
        FROM r GROUP BY lang
        UNION ALL
        SELECT lang, row, printf('Row %03d. ', row) || question || chr(10) || '[Context: '
               || context_length || ' words]' || chr(10) || '{THIN}' || chr(10) || answer || chr(10)
        FROM r""",
)
def open_report(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    results = docs.select(
        "lang",
        (F.col("doc_id") + 1).alias("row"),
        F.lit("What is in it?").alias("question"),
        word_count("text").alias("context_length"),
        F.col("text").alias("answer"),
    )
    total = docs.agg(F.count("*"))
    return evaluation.open_book_report(results, total, F.col("lang"), "documents", ["lang"])


# -- chat

SQL_CHAT = """
    SELECT *, coalesce(array_to_string(list(
        chr(10) || upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text) OVER w, ''), '')
        AS history, count(*) OVER w AS n_history
    FROM conversations WHERE role <> 'system'
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
"""


@query("w_chat_history", f"SELECT conv_id, turn, history, n_history FROM ({SQL_CHAT})")
def chat_history(spark, sf_dir) -> DataFrame:
    history = chat.with_history(dialogue(spark, sf_dir))
    n_history = F.col("n_history").cast("bigint")
    return history.select("conv_id", "turn", "history", n_history.alias("n_history"))


@query(
    "w_chat_prompt",
    f"""SELECT conv_id, turn, {sql_render(
            templates.CHAT,
            system=sql_text(templates.CHAT_SYSTEM),
            history=f"CASE WHEN history = '' THEN '{templates.NO_HISTORY}' ELSE history END",
            question="text",
        )} AS prompt
        FROM ({SQL_CHAT}) WHERE role = 'user' AND {sql_strip("text")} <> ''""",
)
def chat_prompt(spark, sf_dir) -> DataFrame:
    return chat.chat_prompts(dialogue(spark, sf_dir)).select("conv_id", "turn", "prompt")


# -- packing and vectors

LENGTH = 512
SQL_PACKED = f"""
    SELECT (row_number() OVER (ORDER BY doc_id, i) - 1) // {LENGTH} AS chunk_id, doc_id, i, token
    FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i
          FROM (SELECT doc_id, list_append({sql_tokens(sql_strip("text"))}, '{tokens.EOS}') AS tokens
                FROM documents WHERE {sql_strip("text")} <> ''))
"""


def _packed(spark, sf_dir) -> DataFrame:
    docs = non_blank(corpus(spark, sf_dir)).select("doc_id", strip("text").alias("text"))
    return packing.pack_sequences(docs, LENGTH)


@query(
    "m_pack_sequences",
    f"""SELECT chunk_id, count(*) AS n_tokens, string_agg(token, '' ORDER BY doc_id, i) AS text
        FROM ({SQL_PACKED}) GROUP BY chunk_id""",
)
def pack(spark, sf_dir) -> DataFrame:
    return _packed(spark, sf_dir).select(
        "chunk_id", F.col("n_tokens").cast("bigint"), tokens.decode(F.col("tokens")).alias("text")
    )


@query(
    "m_pack_stats",
    f"""SELECT (count(*) + {LENGTH} - 1) // {LENGTH} AS chunks, count(*) AS tokens,
               (count(*) - 1) % {LENGTH} + 1 AS last_chunk_tokens
        FROM ({SQL_PACKED})""",
)
def pack_statistics(spark, sf_dir) -> DataFrame:
    return packing.pack_stats(_packed(spark, sf_dir))


TOKENS = 3


@query(
    "m_trajectory",
    f"""WITH s AS (
           SELECT label, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER w AS b,
                  row_number() OVER w AS place
           FROM embeddings WINDOW w AS (PARTITION BY label, vec_id % {TOKENS} ORDER BY vec_id)),
       p AS (SELECT label, place, avg(list_distance(v, b)) AS step FROM s WHERE b IS NOT NULL
             GROUP BY label, place),
       t AS (SELECT label, avg(step) AS trajectory FROM p GROUP BY label),
       l AS (SELECT label, avg(embedding[1]::DOUBLE) AS loss FROM embeddings GROUP BY label)
       SELECT label AS seq_id, round(loss, 6) AS loss,
              round(coalesce(trajectory, 0), 6) AS trajectory,
              round(loss + 0.01 * coalesce(trajectory, 0), 6) AS total_loss
       FROM l LEFT JOIN t USING (label)""",
)
def mean_trajectory(spark, sf_dir) -> DataFrame:
    """Labels read as sequences of a few tokens, whose vectors are dealt to them as their layers."""
    states = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("seq_id"),
        (F.col("vec_id") % TOKENS).alias("token"),
        F.col("vec_id").alias("layer"),
        F.col("embedding").alias("vec"),
    )
    losses = states.groupBy("seq_id").agg(F.avg(F.get("vec", 0).cast("double")).alias("loss"))
    total = trajectory.total_loss(losses, trajectory.mean_displacement(states))
    numbers = [F.round(c, 6).alias(c) for c in ("loss", "trajectory", "total_loss")]
    return total.select("seq_id", *numbers)
