"""Streams that call the model, replay after a stop, and close their report."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions.parsing import SALVAGE_MARKER
from textquarry.operators.completion import CompletionError
from textquarry.operators.evaluation import open_book_report
from textquarry.streaming import jobs

GOOD = json.dumps([{"question": "q", "answer": "a"}])


def no_pause(_):
    pass


def write_json(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n")


def documents(*numbers):
    return [{"doc_id": i, "text": f"d{i} " + "word " * 60, "citation": f"c{i}"} for i in numbers]


def counting(folder, down=None):
    """A completer that notes its calls per document and has no answer while ``down`` exists."""

    def completer(prompt):
        name = next(f"d{i}" for i in range(40) if f"d{i} word" in prompt)
        if down is not None and down.exists() and name in down.read_text().split():
            raise ValueError("down")
        with open(folder / name, "a") as calls:
            calls.write("x")
        if name == "d3":
            raise CompletionError(400, json.dumps({"error": SALVAGE_MARKER + GOOD}))
        return GOOD

    return completer


class Generation:
    def __init__(self, spark, folder, **options):
        self.spark, self.source, self.calls = spark, folder / "in", folder / "calls"
        self.calls.mkdir()
        self.down = folder / "down"
        self.output, self.ledger = str(folder / "pairs"), str(folder / "ledger")
        self.options = {"commits": 3, "pause": no_pause, **options}
        self.checkpoint = str(folder / "check")

    def completer(self):
        return counting(self.calls, self.down)

    def run(self):
        query = jobs.stream_generation(
            self.spark, str(self.source), self.completer(), self.output, self.ledger,
            self.checkpoint, **self.options,
        )
        query.awaitTermination(180)

    def sources(self):
        rows = self.spark.read.json(f"{self.output}/batch=*").collect()
        return sorted(int(r.source[1:]) for r in rows)

    def called(self):
        return {p.name: len(p.read_text()) for p in self.calls.iterdir()}


def test_generation_answers_inside_the_stream(spark, tmp_path):
    job = Generation(spark, tmp_path)
    write_json(job.source, "a.json", documents(*range(5)))
    job.run()
    job.run()
    assert job.sources() == [0, 1, 2, 3, 4]
    write_json(job.source, "b.json", [*documents(4, 5), {"doc_id": 6, "text": "short"}])
    job.run()
    assert job.sources() == [0, 1, 2, 3, 4, 5]  # 4 came again and was not asked again
    assert job.called() == {f"d{i}": 1 for i in range(6)}
    counters = jobs.generation_counters(spark, job.ledger).first()
    assert (counters.documents, counters.total_pairs, counters.errors) == (6, 6, 0)


def test_stop_between_answers_and_pairs(spark, tmp_path, monkeypatch):
    job = Generation(spark, tmp_path, max_files=1)
    write_json(job.source, "a.json", documents(0, 1, 2))
    write_json(job.source, "b.json", documents(10, 11, 12, 13))
    commit = jobs._commit

    def stopped(rows, path, form="json"):
        if path.endswith("pairs/batch=1"):
            raise KeyError("stopped")
        commit(rows, path, form)

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_commit", stopped)
        with pytest.raises(Exception, match="stopped"):
            job.run()
    calls = job.called()
    assert sorted(job.sources()) in ([0, 1, 2], [10, 11, 12, 13])
    job.run()
    assert job.sources() == [0, 1, 2, 10, 11, 12, 13]
    assert job.called() == calls == {f"d{i}": 1 for i in (0, 1, 2, 10, 11, 12, 13)}


def test_stop_between_commits_repeats_no_finished_one(spark, tmp_path, monkeypatch):
    job = Generation(spark, tmp_path, commits=4)
    write_json(job.source, "a.json", documents(*range(12)))
    commit = jobs._commit

    def stopped(rows, path, form="json"):
        if path.endswith("commit=2"):
            raise KeyError("stopped")
        commit(rows, path, form)

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_commit", stopped)
        with pytest.raises(Exception, match="stopped"):
            job.run()
    assert 0 < len(job.called()) < 12
    job.run()
    assert job.sources() == list(range(12))
    assert set(job.called().values()) == {1}


def test_failed_documents_of_a_stream_are_asked_again(spark, tmp_path):
    job = Generation(spark, tmp_path, tries=1)
    rows = documents(*range(6))
    write_json(job.source, "a.json", rows)
    job.down.write_text("d1 d4 d5")
    job.run()
    assert job.sources() == [0, 2, 3]
    docs = spark.createDataFrame(rows, jobs.DOCUMENT)
    job.down.write_text("d5")
    args = (spark, docs, job.completer(), job.output, job.ledger)
    assert jobs.retry_failed(*args, tries=1, pause=no_pause) == 3
    assert job.sources() == [0, 1, 2, 3, 4]
    job.down.write_text("none")
    assert jobs.retry_failed(*args, tries=1, pause=no_pause) == 1
    assert jobs.retry_failed(*args, tries=1, pause=no_pause) == 0
    assert job.sources() == [0, 1, 2, 3, 4, 5]
    assert job.called() == {f"d{i}": 1 for i in range(6)}


def test_open_book_report_grows_by_batch_and_is_closed(spark, tmp_path, monkeypatch):
    source, output, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def results(*rows):
        return [{"row": n, "question": f"q{n}?", "context_length": 10 * n, "answer": f"a{n}\nb"}
                for n in rows]

    def run():
        query = jobs.stream_results(spark, str(source), output, check, jobs.OPEN_BOOK)
        query.awaitTermination(120)

    write_json(source, "a.json", results(2, 3))
    run()
    assert jobs.close_report(spark, output, 4, "base", jobs.OPEN_BOOK, source="rows.json") == 2
    write_json(source, "b.json", results(1, 12))
    commit = jobs._commit

    def stopped(rows, path, form="json"):
        commit(rows, path, form)
        if "/results/batch=1" in path:
            raise KeyError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_commit", stopped)
        with pytest.raises(Exception, match="stopped"):
            run()
    run()  # the batch is replayed
    saved = spark.read.json(f"{output}/results/batch=*")
    assert sorted(r.row for r in saved.collect()) == [1, 2, 3, 12]
    assert jobs.close_report(spark, output, 4, "base", jobs.OPEN_BOOK, source="rows.json") == 4
    got = jobs.streamed_report(spark, output, jobs.OPEN_BOOK).orderBy("pos").collect()
    total = spark.range(1).select(F.lit(4).alias("n"))
    want = open_book_report(saved, total, F.lit("base"), "rows.json").orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(r.pos, r.text) for r in want]
    assert got[0].text.endswith("Input  : rows.json\nRows answered: 4/4\n" + "=" * 70 + "\n")
    blocks = spark.read.text(f"{output}/report/batch=1", wholetext=True).collect()
    assert "".join(b.value for b in blocks).count("[Context: ") == 2
