import json
import os

import pytest
from pyspark.sql import functions as F

from textquarry import session
from textquarry.functions import prompts
from textquarry.functions.parsing import SALVAGE_MARKER
from textquarry.operators.completion import CompletionError, complete, completion_ledger
from textquarry.operators.pairs import responses, unanswered
from textquarry.plans import jobs
from textquarry.streaming.jobs import stream_pairs, stream_prompts, stream_results

GOOD = json.dumps([{"question": "q", "answer": "a"}])


def no_pause(_):
    pass


def test_completion_retries_and_salvage(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def completer(prompt):
        calls = log / prompt
        calls.write_text(calls.read_text() + "x" if calls.exists() else "x")
        n = len(calls.read_text())
        if prompt == "ok" or (prompt == "late" and n == 3):
            return f" {prompt} "
        if prompt == "salvage":
            raise CompletionError(400, json.dumps({"error": SALVAGE_MARKER + "inside"}))
        if prompt == "empty":
            raise CompletionError(400, json.dumps({"error": SALVAGE_MARKER}))
        raise ValueError("down")

    names = ["ok", "late", "salvage", "empty", "down"]
    prompts = spark.createDataFrame(list(enumerate(names)), "doc_id bigint, prompt string")
    ledger = completion_ledger(prompts.coalesce(1), completer, pause=no_pause)
    for _ in range(2):  # reading the ledger again repeats no call
        got = {r.doc_id: r.response for r in responses(ledger).collect()}
    assert got == {0: "ok", 1: "late", 2: "inside", 3: None, 4: None}
    calls = {n: len((log / n).read_text()) for n in names}
    assert calls == {"ok": 1, "late": 3, "salvage": 1, "empty": 3, "down": 3}


def test_pauses_double(spark):
    def pause(seconds):
        raise RuntimeError(f"paused {seconds}")

    def completer(_):
        raise ValueError

    prompts = spark.createDataFrame([(1, "p")], "doc_id bigint, prompt string")
    with pytest.raises(Exception, match="paused 1"):
        complete(prompts, completer, pause=pause).collect()


def test_pair_generation_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, "word " * (60 if i else 3), f"c{i}") for i in range(6)],
        "doc_id bigint, text string, citation string",
    )

    def completer(prompt):
        assert "word word" in prompt
        return GOOD

    output, ledger = str(tmp_path / "pairs"), str(tmp_path / "ledger")
    counters = jobs.generate_pairs(docs, completer, output, ledger, count=4, pause=no_pause)
    first = spark.read.json(output).count()
    assert counters["total_pairs"] == counters["documents"] == first
    again = jobs.generate_pairs(docs, completer, output, ledger, count=6, resume=True, pause=no_pause)
    rows = spark.read.json(output).collect()
    assert sorted(r.source for r in rows) == [f"c{i}" for i in range(1, 6)]
    assert again["documents"] == 5 - first
    assert {r.type for r in rows} == {"Unknown"}
    assert unanswered(docs, spark.read.parquet(ledger)).count() == 1


def few_documents(spark):
    return spark.createDataFrame(
        [(i, f"d{i} " + "word " * 60, f"c{i}") for i in range(8)],
        "doc_id bigint, text string, citation string",
    )


def counting(folder, broken):
    """A completer that counts its calls per document and dies on one while ``broken`` exists."""

    def completer(prompt):
        name = next(f"d{i}" for i in range(8) if f"d{i} word" in prompt)
        if broken.exists() and broken.read_text() == name:
            os._exit(1)
        if broken.exists() and broken.read_text() == "down":
            raise ValueError("down")
        with open(folder / name, "a") as calls:
            calls.write("x")
        return GOOD

    return completer


def sources(spark, output):
    return sorted(r.source for r in spark.read.json(output).collect())


def test_stopped_completion_repeats_no_commit(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    output, ledger = str(tmp_path / "pairs"), str(tmp_path / "ledger")
    ask = counting(calls, broken)
    docs = few_documents(spark)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    last = docs.orderBy(slot.desc()).first().doc_id
    broken.write_text(f"d{last}")
    options = {"count": 8, "commits": 4, "pause": no_pause}
    with pytest.raises(Exception):
        jobs.generate_pairs(docs, ask, output, ledger, **options)
    kept = {r.doc_id for r in spark.read.parquet(ledger).collect()}
    assert kept == {r.doc_id for r in docs.where(slot < docs.select(F.max(slot)).scalar()).collect()}
    broken.unlink()
    jobs.generate_pairs(docs, ask, output, ledger, resume=True, **options)
    assert sources(spark, output) == [f"c{i}" for i in range(8)]
    assert all(len((calls / f"d{i}").read_text()) == 1 for i in kept)


def test_stop_between_ledger_and_pairs_loses_nothing(spark, tmp_path, monkeypatch):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    output, ledger = str(tmp_path / "pairs"), str(tmp_path / "ledger")
    ask, docs = counting(calls, broken), few_documents(spark)
    options = {"count": 8, "commits": 2, "pause": no_pause}

    def stopped(*_):
        raise KeyError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "write_pairs", stopped)
        with pytest.raises(KeyError):
            jobs.generate_pairs(docs, ask, output, ledger, **options)
    counters = jobs.generate_pairs(docs, ask, output, ledger, resume=True, **options)
    assert counters["documents"] == counters["total_pairs"] == 8
    assert sources(spark, output) == [f"c{i}" for i in range(8)]
    jobs.generate_pairs(docs, ask, output, ledger, resume=True, **options)
    assert sources(spark, output) == [f"c{i}" for i in range(8)]
    assert all(len((calls / f"d{i}").read_text()) == 1 for i in range(8))


def test_failed_documents_are_asked_again(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    output, ledger = str(tmp_path / "pairs"), str(tmp_path / "ledger")
    ask, docs = counting(calls, broken), few_documents(spark)
    options = {"count": 8, "commits": 2, "pause": no_pause}
    broken.write_text("down")
    assert jobs.generate_pairs(docs, ask, output, ledger, **options)["no_response"] == 8
    broken.unlink()
    counters = jobs.generate_pairs(docs, ask, output, ledger, resume=True, **options)
    assert counters["total_pairs"] == 8 and sources(spark, output) == [f"c{i}" for i in range(8)]


def test_training_sets(spark, tmp_path):
    raw, pairs = tmp_path / "corpus.jsonl", tmp_path / "pairs.jsonl"
    raw.write_text(json.dumps({"text": "some law text", "citation": "c"}) + "\n")
    first = jobs.fine_tuning_set(spark, str(pairs), str(raw), "4gb").collect()
    assert "Citation: c\nJurisdiction: Unknown Jurisdiction" in first[0]["text"]
    pairs.write_text(json.dumps({"question": "q?", "answer": "a."}) + "\n")
    second = jobs.fine_tuning_set(spark, str(pairs), str(raw), "4gb").collect()
    assert second[0]["text"].endswith("### Input:\nq?\n\n### Response:\na.</s>")

    docs = spark.createDataFrame([(1, " a b "), (2, ""), (3, "long enough text")],
                                 "doc_id bigint, text string")
    chunks = jobs.pretraining_set(docs, length=3, longer_than=3).orderBy("chunk_id").collect()
    assert ["".join(c.tokens) for c in chunks] == ["a b</s>", "long enough text", "</s>"]


def test_closed_book_evaluation_resumes(spark):
    questions = spark.createDataFrame([(q, f"q{q}?") for q in range(1, 5)], "q bigint, question string")

    def completer(prompt):
        if "q3?" in prompt:
            raise ValueError("down")
        assert prompt.endswith("### Response:\n")
        return "new"

    earlier = spark.createDataFrame(
        [(1, "q1?", "old"), (2, "q2?", "old")], "q bigint, question string, answer string"
    )
    got = jobs.closed_book_evaluation(questions, completer, 2, earlier, pause=no_pause)
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "q1?", "old"), (2, "q2?", "new"), (4, "q4?", "new"),
    ]
    short = jobs.closed_book_evaluation(
        questions, lambda p: str(len(p)), prompt=prompts.short, pause=no_pause, parallelism=2
    )
    assert short.count() == 4


def test_open_book_evaluation(spark):
    rows = spark.createDataFrame(
        [(1, " q? ", " a b  c\n"), (2, "r?", "d")], "row bigint, question string, context string"
    )
    got = jobs.open_book_evaluation(rows, lambda p: "yes " if "a b  c\n\nQUESTION:\nq?" in p else "no")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "q?", 3, "yes"), (2, "r?", 1, "no")]


def test_review_rounds_fit_the_budget(spark):
    losses = spark.createDataFrame(
        [("a", 1, 1, 2.0)], "run_id string, round bigint, step bigint, loss double"
    )
    proposals = spark.createDataFrame(
        [("a", 1, {"r": 8.0}, None)],
        "run_id string, round bigint, config map<string,double>, response string",
    )
    results = spark.createDataFrame(
        [("a", 1, 1, "q", "y" * 590)],
        "run_id string, round bigint, q bigint, question string, answer string",
    )
    def review(budget):
        pieces = jobs.review_rounds(losses, proposals, results, budget).orderBy("pos").collect()
        return "".join(p.text for p in pieces), {p.answer_limit for p in pieces}

    whole, no_limit = review(10_000)
    cut, limit = review(len(whole) - 1)
    assert no_limit == {None} and limit == {500}
    assert cut == whole.replace("A: " + "y" * 590, "A: " + "y" * 497 + "…")


def write_json(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_streams_resume_without_repeats(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def answered(i):
        return {"doc_id": i, "text": "t", "citation": f"c{i}", "response": GOOD if i % 3 else None,
                "error_body": None if i % 3 else json.dumps({"error": SALVAGE_MARKER + GOOD})}

    def run():
        query = stream_pairs(spark, str(source), out, check)
        query.awaitTermination(120)
        return sorted(r.source for r in spark.read.json(out).collect())

    write_json(source, "a.json", [answered(i) for i in range(4)])
    assert run() == ["c0", "c1", "c2", "c3"]
    assert run() == ["c0", "c1", "c2", "c3"]
    write_json(source, "b.json", [answered(4)])
    assert run() == ["c0", "c1", "c2", "c3", "c4"]


def test_stream_prompts_and_results(spark, tmp_path):
    docs = tmp_path / "docs"
    write_json(docs, "a.json", [{"doc_id": 1, "text": "w " * 60}, {"doc_id": 2, "text": "short"}])
    query = stream_prompts(spark, str(docs), str(tmp_path / "p"), str(tmp_path / "pc"))
    query.awaitTermination(120)
    assert [r.doc_id for r in spark.read.json(str(tmp_path / "p")).collect()] == [1]

    results = tmp_path / "results"
    for name, q in (("a.json", 2), ("b.json", 1)):
        write_json(results, name, [{"q": q, "question": "q", "answer": "a"}])
        stream_results(spark, str(results), str(tmp_path / "r"), str(tmp_path / "rc")).awaitTermination(120)
    assert sorted(r.q for r in spark.read.json(str(tmp_path / "r/results")).collect()) == [1, 2]
    lines = spark.read.text(str(tmp_path / "r/report")).collect()
    assert sum(line.value.startswith("Q00") for line in lines) == 2


def test_settings_leave_the_shuffle_partitions_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session.configure(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def get(self, name, default):
            return default

    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "x"

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.shared_dir(spark) == configured
