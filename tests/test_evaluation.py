from pyspark.sql import functions as F

from textquarry.operators import chat, evaluation, pairs, prepare, trajectory


def test_chat_window_over_a_long_conversation(spark):
    rows = [(1, t, "USER" if t % 2 == 0 else "assistant", f"m{t}") for t in range(9)]
    rows += [(2, 5, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.with_history(df).collect()}
    assert got[1, 0].history == "" and got[2, 5].history == ""
    assert got[1, 8].history == "".join(
        f"\n{'User' if t % 2 == 0 else 'Assistant'}: m{t}" for t in range(2, 8)
    )
    assert [got[1, t].n_history for t in range(9)] == [0, 1, 2, 3, 4, 5, 6, 6, 6]


def test_blank_message_gives_no_prompt(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", " \n"), (1, 1, "user", "hi")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    assert [r.turn for r in chat.chat_prompts(df).collect()] == [1]


def test_append_exchange(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(1, 4, "user", "a")], schema)
    new = spark.createDataFrame(
        [(1, "q", "r"), (2, "new", "yes"), (3, "  ", "no")],
        "conv_id bigint, question string, reply string",
    )
    rows = sorted(tuple(r) for r in chat.append_exchange(df, new).collect())
    assert rows == [
        (1, 4, "user", "a"), (1, 5, "user", "q"), (1, 6, "assistant", "r"),
        (2, 0, "user", "new"), (2, 1, "assistant", "yes"),
    ]


def test_reports(spark):
    results = spark.createDataFrame(
        [(2, "why?", "b"), (1, "what?", "a")], "q bigint, question string, answer string"
    )
    total = spark.range(3).agg(F.count("*"))
    report = evaluation.closed_book_report(results, total, F.lit("m1"), title="T")
    lines = [r["text"] for r in report.orderBy("pos").collect()]
    assert "\n".join(lines) == (
        "T\nModel: m1\nQuestions answered: 2/3\n" + "=" * 70 + "\n\n"
        "Q001. what?\n" + "-" * 70 + "\na\n\nQ002. why?\n" + "-" * 70 + "\nb\n"
    )
    results = results.withColumns({"run_id": F.lit("a"), "round": F.lit(3)})
    head = evaluation.round_report(results).orderBy("pos").first()["text"]
    assert head == "ROUND 3 — BENCHMARK ANSWERS\n" + "=" * 70 + "\n"


def test_open_book_report(spark):
    results = spark.createDataFrame(
        [(1234, "q", 5, "a")], "row bigint, question string, context_length bigint, answer string"
    )
    total = spark.range(1).agg(F.count("*"))
    rows = evaluation.open_book_report(results, total, F.lit("m"), "in.json").orderBy("pos").collect()
    assert rows[0]["text"].split("\n")[1:4] == ["Model  : m", "Input  : in.json", "Rows answered: 1/1"]
    assert rows[1]["text"] == "Row 1234. q\n[Context: 5 words]\n" + "-" * 70 + "\na\n"


def test_sampled_answers_go_by_place_not_number(spark):
    results = spark.createDataFrame(
        [(q, f"q{q}", "z") for q in (3, 4, 5, 6, 7, 20)], "q bigint, question string, answer string"
    )
    lines = evaluation.sampled_answers(results).orderBy("pos").collect()
    assert [(r.pos, r.line) for r in lines] == [(1, "Q003: q3\nA: z"), (2, "Q020: q20\nA: z")]


def test_resume_and_merge(spark):
    docs = spark.range(6).withColumnRenamed("id", "doc_id")
    done = spark.createDataFrame([(1,), (1,), (4,)], "doc_id bigint")
    assert sorted(r[0] for r in pairs.unanswered(docs, done).collect()) == [0, 2, 3, 5]
    old = spark.createDataFrame([(1, "o"), (2, "o")], "q bigint, answer string")
    new = spark.createDataFrame([(2, "n"), (3, "n")], "q bigint, answer string")
    merged = sorted(tuple(r) for r in pairs.merge_results(old, new).collect())
    assert merged == [(1, "o"), (2, "n"), (3, "n")]
    skipped = prepare.skip_answered_estimate(docs, 7, 3, "doc_id")
    assert sorted(r[0] for r in skipped.collect()) == [2, 3, 4, 5]


def test_progress_guards(spark):
    df = spark.createDataFrame([(10, 30, 0, 2.0), (5, 30, 5, 2.0), (3, 9, 0, 0.0)],
                               "done int, total int, skipped int, minutes double")
    got = [tuple(r) for r in df.select(*pairs.progress("done", "total", "skipped", "minutes")).collect()]
    assert got == [(5.0, 4.0), (0.0, 0.0), (0.0, 0.0)]


def test_clean_eos_counts_the_end_token(spark):
    df = spark.createDataFrame([("abcdef",), (" abcdefg\n",), (" ",), (None,)], "text string")
    assert [r.text for r in prepare.clean_eos(df).collect()] == ["abcdefg</s>"]
    longer = prepare.clean_eos(df, eos="<|end_of_text|>").collect()
    assert len(longer) == 2


def test_training_documents_by_tier_equals_one_by_one(spark):
    docs = spark.createDataFrame([(1, "w " * 700), (2, "short")], "doc_id bigint, text string")
    together = prepare.training_documents_by_tier(docs).select("doc_id", "tier", "text").collect()
    apart = prepare.training_documents(
        prepare.with_tiers(docs), F.col("token_truncation_length")
    ).select("doc_id", "tier", "text").collect()
    assert sorted(map(tuple, together)) == sorted(map(tuple, apart))
    assert len(together) == 8


def test_overrides(spark):
    docs = spark.range(1)
    rows = prepare.with_tiers(docs, ["4gb"], overrides={"max_steps": 5, "max_seq_length": None})
    assert tuple(rows.select("max_steps", "max_seq_length").first()) == (5, 256)


def test_trajectory(spark):
    states = spark.createDataFrame(
        [(1, 0, 0, [0.0, 0.0]), (1, 0, 1, [3.0, 4.0]), (1, 0, 2, [3.0, 4.0]),
         (1, 1, 0, [1.0, 0.0]), (1, 1, 1, [1.0, 1.0]), (1, 1, 2, [1.0, 3.0]),
         (2, 0, 0, [9.0, 9.0])],
        "seq_id int, token int, layer int, vec array<float>",
    )
    means = {r.seq_id: r.trajectory for r in trajectory.mean_displacement(states).collect()}
    assert means == {1: ((5 + 1) / 2 + (0 + 2) / 2) / 2, 2: 0.0}
    losses = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "seq_id int, loss double")
    total = trajectory.total_loss(losses, trajectory.mean_displacement(states), alpha=0.5)
    assert {r.seq_id: r.total_loss for r in total.collect()} == {1: 2.0, 2: 2.0, 3: 3.0}
