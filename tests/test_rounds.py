import json

from pyspark.sql import functions as F

from textquarry.functions.templates import ANSWERS_HEADING, ROUND_REVIEW
from textquarry.operators import rounds
from textquarry.sources import sinks

CONFIG = {"r": 16.0, "learning_rate": 5e-5}


def tables(spark, hot=0):
    losses = [("a", r, s * 10, 2.0 - r / 10 - s / 100) for r in (1, 2, 3, 5) for s in range(1, 4)]
    losses += [("a", 6, s, 1.0) for s in range(hot)]
    responses = {1: '{"r": 8}', 2: "no idea", 3: '{"r": 99, "learning_rate": 1e-4}', 5: "{}"}
    proposals = [("a", r, CONFIG, t) for r, t in responses.items()] + [("a", 4, CONFIG, "{}")]
    results = [("a", r, q, f"q{q}?", "x" * 610 if q == 6 else f"a{q}")
               for r in (1, 2) for q in range(1, 12)]
    return (
        spark.createDataFrame(losses, "run_id string, round bigint, step bigint, loss double"),
        spark.createDataFrame(
            proposals, "run_id string, round bigint, config map<string,double>, response string"
        ),
        spark.createDataFrame(
            results, "run_id string, round bigint, q bigint, question string, answer string"
        ),
    )


def expected_prompt(r):
    changes = {1: ["  r: 16 → 8"], 2: [], 3: ["  learning_rate: 5e-05 → 0.0001", "  r: 16 → 64"],
               5: []}
    loss = {r: [2.0 - r / 10 - s / 100 for s in (1, 2, 3)] for r in changes}
    earlier = [p for p in changes if p < r][-3:]
    history = "".join(
        f"\n  Round {p}: changes={changes[p]}, start_loss={loss[p][0]:.4f}, "
        f"end_loss={loss[p][-1]:.4f}"
        for p in earlier
    )
    answers = [f"Q{q:03d}: q{q}?\nA: " + ("x" * 600 + "…" if q == 6 else f"a{q}") for q in (1, 6, 11)]
    return ROUND_REVIEW.format(
        round=r,
        config=json.dumps({"learning_rate": 5e-5, "r": 16}, indent=2),
        losses="\n".join(f"  step {s * 10:4d}: loss={v:.4f}" for s, v in enumerate(loss[r], 1)),
        history=history or "  (no previous rounds)",
        answers=ANSWERS_HEADING + "\n\n".join(answers) if r < 3 else "",
    )


def test_review_prompt_of_pieces(spark):
    losses, proposals, results = tables(spark)
    outcome = rounds.with_round_history(rounds.with_outcome(losses, proposals))
    pieces = rounds.round_reviews(losses, outcome, results).orderBy("round", "pos").collect()
    whole = {}
    for r in pieces:
        whole[r.round] = whole.get(r.round, "") + r.text
    assert whole == {r: expected_prompt(r) for r in (1, 2, 3, 5)}


def test_a_round_is_one_record_at_any_size(spark):
    losses, proposals, _ = tables(spark, hot=12_000)
    outcome = rounds.with_outcome(losses, proposals)
    when = F.to_timestamp(F.lit("2026-01-02 03:04:05"))
    records = rounds.round_records(losses, outcome, "out", timestamp=when).collect()
    (hot,) = [r for r in records if r.round == 6]
    assert [e.step for e in hot.loss_log] == list(range(12_000))
    third = next(r for r in records if r.round == 3)
    assert third.adapter_dir == "out/round_03_adapter" and third.patch["r"].toJson() == "99"
    assert third.timestamp == "2026-01-02T03:04:05"
    assert third.changes == ["  learning_rate: 5e-05 → 0.0001", "  r: 16 → 64"]
    assert not [r for r in records if r.round == 4]  # no losses, no record


def test_round_log_round_trip(spark, tmp_path):
    losses, proposals, _ = tables(spark)
    records = rounds.round_records(losses, rounds.with_outcome(losses, proposals), "out")
    sinks.write_round_log(records, str(tmp_path / "log"))
    back = spark.read.schema(records.schema).json(str(tmp_path / "log")).drop("timestamp")
    assert sorted(map(str, back.collect())) == sorted(map(str, records.drop("timestamp").collect()))


def test_best_round_prefers_the_earlier(spark):
    df = spark.createDataFrame(
        [("a", 1, 2.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 5.0)],
        "run_id string, round bigint, end_loss double",
    )
    assert sorted(tuple(r) for r in rounds.best_round(df).collect()) == [("a", 2, 1.0), ("b", 1, 5.0)]


def cut(text, limit):
    lines = [
        line[:limit] + "…" if line.startswith("A: ") and len(line) > limit else line
        for line in text.split("\n")
    ]
    return "\n".join(lines)


def test_fit_budget_over_parts(spark):
    text = "\n".join(f"Q{i}\nA: " + "y" * 590 for i in range(6))
    pieces = [p if i == 0 else "\n" + p for i, p in enumerate(text.split("\n"))]
    df = spark.createDataFrame(
        [(k, i, p) for k in (1, 2) for i, p in enumerate(pieces)], "k int, part int, text string"
    )
    for budget in (len(text), len(text) - 1, len(cut(text, 200)), len(cut(text, 100)), 10):
        limit = next(
            (n for n in (None, 500, 200, 100) if len(cut(text, n or 10**9)) <= budget), "none"
        )
        rows = rounds.fit_budget(df, ["k"], budget).where("k = 1").orderBy("part").collect()
        if limit == "none":
            assert not any(r.fits for r in rows) and all(r.text is None for r in rows)
        else:
            assert "".join(r.text for r in rows) == cut(text, limit or 10**9)
            assert {r.answer_limit for r in rows} == {limit}


def test_loss_summary_formats(spark):
    df = spark.createDataFrame(
        [("a", 1, 10, 1.23456), ("a", 1, 9, 2.0), ("a", 1, 12345, 0.00005)],
        "run_id string, round bigint, step bigint, loss double",
    )
    lines = rounds.loss_summary(df).orderBy("pos").collect()
    assert "\n".join(r.text for r in lines) == "\n".join(
        f"  step {s:4d}: loss={v:.4f}" for s, v in ((9, 2.0), (10, 1.23456), (12345, 0.00005))
    )
