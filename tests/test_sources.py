import csv
import json

import pytest

from textquarry.sources import corpus, evalsets, sinks


def test_corpus_skips_blank_lines_and_fails_on_bad_ones(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"text": "a", "citation": "c", "other": 1}\n\n  \n{"text": null}\n', "utf-8")
    rows = corpus.scan_corpus(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("a", "c", None, None), (None, None, None, None)]
    path.write_text('{"text": "a"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        corpus.scan_corpus(spark, str(path)).collect()


def test_doc_ids_are_unique_and_follow_the_file(spark, tmp_path):
    lines = [json.dumps({"text": f"t{i}", "citation": "c" * 500}) for i in range(3_000)]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        docs = corpus.with_doc_ids(corpus.scan_corpus(spark, str(tmp_path / "c.jsonl")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = docs.orderBy("doc_id").collect()
    assert len({r.doc_id for r in rows}) == 3_000
    assert [r.text for r in rows] == [f"t{i}" for i in range(3_000)]


def test_directory(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one", "x": 1}\n{"x": 2}\n')
    (tmp_path / "b.txt").write_bytes(b"  two\nlines \xff \n")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "C.TXT").write_text("upper")
    (tmp_path / "d.json").write_text('{"text": "other"}')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.txt").write_text("deep")
    texts = [r.text for r in corpus.scan_directory(spark, str(tmp_path)).collect()]
    assert sorted(t or "" for t in texts) == ["", "one", "two\nlines �"]


def test_directory_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpus.scan_directory(spark, str(tmp_path))
    (tmp_path / "empty.txt").write_text("\n")
    with pytest.raises(FileNotFoundError):
        corpus.scan_directory(spark, str(tmp_path))
    (tmp_path / "a.jsonl").write_text('{"body": "one"}\n')
    with pytest.raises(ValueError, match="text"):
        corpus.scan_directory(spark, str(tmp_path))


def test_latest_snapshot(spark, tmp_path):
    assert corpus.latest_snapshot_path(spark, str(tmp_path)) is None
    for name, holds in (("2", True), ("10", True), ("11", False), ("v99", True)):
        (tmp_path / name).mkdir()
        if holds:
            (tmp_path / name / "corpus.jsonl").write_text(json.dumps({"text": name}))
    path = corpus.latest_snapshot_path(spark, str(tmp_path))
    assert [r.text for r in corpus.scan_corpus(spark, path).collect()] == ["10"]


def test_latest_version_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(9, "a"), (10, "b"), (10, "c")], "version int, text string")
    rows.write.partitionBy("version").parquet(path)
    latest = corpus.latest_version(spark.read.parquet(path))
    assert sorted(r.text for r in latest.collect()) == ["b", "c"]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan


def test_preferred_source_and_counts(spark, tmp_path):
    raw, pairs = tmp_path / "corpus.jsonl", tmp_path / "pairs"
    raw.write_text('{"text": "a"}\n')
    assert corpus.preferred_source(spark, str(pairs), str(raw))[0] == "corpus"
    assert corpus.count_existing(spark, str(pairs)) == 0
    row = [("q", "é", "s", "j", "t")]
    df = spark.createDataFrame(row, "question string, answer string, source string, "
                                    "jurisdiction string, type string")
    sinks.write_pairs(df, str(pairs))
    sinks.write_pairs(df, str(pairs), resume=True)
    kind, found = corpus.preferred_source(spark, str(pairs), str(raw))
    assert kind == "pairs" and [tuple(r) for r in found.collect()] == row * 2
    assert corpus.count_existing(spark, str(pairs)) == 2
    sinks.write_pairs(df, str(pairs))
    assert corpus.count_existing(spark, str(pairs)) == 1
    assert "é" in "".join(p.read_text("utf-8") for p in pairs.glob("part-*"))


ROWS = [("q1", 'line\n"two"'), ("", "c,2"), (" q3 ", "")]


@pytest.mark.parametrize("envelope", [False, True])
def test_open_book_json(spark, tmp_path, envelope):
    rows = [{"context": c, "question": q, "extra": 1} for q, c in ROWS]
    body = {"z rows": rows, "a": [1]} if envelope else rows
    path = tmp_path / "in.JSON"
    path.write_text(json.dumps(body, indent=2))
    got = evalsets.scan_open_book(spark, str(path)).orderBy("row").collect()
    assert [(r.row, r.question, r.context) for r in got] == [(i, *r) for i, r in enumerate(ROWS, 1)]


def test_open_book_csv(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", newline="") as f:
            writer = csv.writer(f)
            writer.writerow(["id", "context", "question"])
            writer.writerows((i, c, q) for i, (q, c) in enumerate(ROWS))
    for path in (tmp_path / "a.csv", tmp_path / "*.csv"):
        files = {}
        for r in evalsets.scan_open_book(spark, str(path)).orderBy("file", "row").collect():
            files.setdefault(r.file, []).append((r.row, r.question, r.context))
        assert len(files) == (1 if path.name == "a.csv" else 2)
        for rows in files.values():
            assert rows == [(i, *r) for i, r in enumerate(ROWS, 1)]


def test_open_book_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="xml"):
        evalsets.scan_open_book(spark, "in.xml")
    (tmp_path / "a.csv").write_text("question,body\nq,b\n")
    with pytest.raises(ValueError, match="row 1 .*context"):
        evalsets.scan_open_book(spark, str(tmp_path / "a.csv"))
    (tmp_path / "a.json").write_text('[{"question": "q", "context": "c"}, {"context": "c"}, {}]')
    rows = evalsets.scan_open_book(spark, str(tmp_path / "a.json"))
    missing = evalsets.missing_columns(rows).orderBy("row").collect()
    assert [tuple(r) for r in missing] == [(2, "question"), (3, "question")]
    with pytest.raises(ValueError, match="row 2 .*question"):
        evalsets.require_columns(rows)


def test_results_in_both_forms(spark, tmp_path):
    rows = [{"q": 1, "question": "a", "answer": "b"}, {"q": 2, "question": "c", "answer": "d"}]
    want = [(1, "a", "b"), (2, "c", "d")]
    assert evalsets.scan_results(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("array.json", "lines.json"):
        got = evalsets.scan_results(spark, str(tmp_path / name)).orderBy("q").collect()
        assert [tuple(r) for r in got] == want
    (tmp_path / "loss.json").write_text('[{"step": 10, "loss": 1.5}]')
    assert [tuple(r) for r in evalsets.scan_loss_log(spark, str(tmp_path / "loss.json")).collect()] == [(10, 1.5)]


def test_report_files_keep_the_order(spark, tmp_path):
    report = spark.range(200).selectExpr("199 - id AS pos", "concat('l', 199 - id) AS text")
    sinks.write_report(report.repartition(7), str(tmp_path / "r"))
    parts = sorted(p for p in (tmp_path / "r").iterdir() if p.name.startswith("part-"))
    lines = "".join(p.read_text() for p in parts).split()
    assert lines == [f"l{i}" for i in range(200)]


def test_results_of_both_forms_in_one_folder(spark, tmp_path):
    rows = [{"q": q, "question": f"q{q}", "answer": "a"} for q in range(4)]
    (tmp_path / "a.json").write_text("\n  " + json.dumps(rows[:2], indent=1))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in rows[2:]))
    (tmp_path / "c.json").write_text("\n")
    got = evalsets.scan_results(spark, str(tmp_path / "*.json")).collect()
    assert sorted(r.q for r in got) == [0, 1, 2, 3]


def test_envelopes_with_any_key_and_unreadable_bodies(spark, tmp_path):
    row = {"question": "q", "context": "c"}
    (tmp_path / "good.json").write_text(json.dumps({"o'r.o\"ws": [row, row]}))
    assert evalsets.scan_open_book(spark, str(tmp_path / "good.json")).count() == 2
    for i, body in enumerate(("", "{}", '{"a": 1}', "[{", "nothing")):
        path = tmp_path / f"bad{i}.json"
        path.write_text(body)
        with pytest.raises(Exception):
            evalsets.scan_open_book(spark, str(path)).collect()


class Small:
    """Files of a few hundred bytes already count as large, and splits are small."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")

    def __exit__(self, *_):
        self.spark.conf.unset("spark.sql.files.maxPartitionBytes")


ODD = [
    ('q "1" }', 'a } b { [ ] "x" \\" \\\\'),
    ("", "line\nend\r\nmore, \"quoted\""),
    ("é" * 50, "}" * 40 + "{" * 3 + "\\"),
    ("\\\\\"", "]} , {"),
]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("envelope", [False, True])
def test_large_arrays_are_read_by_many_tasks(spark, tmp_path, envelope, indent):
    for file in ("a.json", "b.json"):
        rows = [{"context": c + str(i), "question": q + file, "more": {"x": [{"y": "}"}, {}]}}
                for i in range(60) for q, c in ODD]
        other = {"z \"}[ rows": rows, "other": [{"question": "no", "context": "no"}], "n": {"a": {}}}
        (tmp_path / file).write_text(json.dumps(other if envelope else rows, indent=indent) + "\n")
    with Small(spark):
        got = evalsets.scan_open_book(spark, str(tmp_path / "*.json"), whole_below=100)
        pieces = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
        assert pieces > 6
        files = {}
        for r in got.orderBy("file", "row").collect():
            files.setdefault(r.file[-6:], []).append((r.row, r.question, r.context))
    want = [(q, c + str(i)) for i in range(60) for q, c in ODD]
    assert files == {f: [(n, q + f, c) for n, (q, c) in enumerate(want, 1)] for f in ("a.json", "b.json")}


def test_large_files_that_hold_no_array(spark, tmp_path):
    for i, body in enumerate(("{}", '{"a": 1, "b": [{}]}', "nothing}", '{"a": {"b": [{}]}}', "  ")):
        (tmp_path / f"bad{i}.json").write_text(body)
        with pytest.raises(Exception, match="no array of rows"):
            evalsets.scan_open_book(spark, str(tmp_path / f"bad{i}.json"), whole_below=1).collect()
    (tmp_path / "half.json").write_text('[{"question": "q"}, 3, {"question": "r"}]')
    with pytest.raises(Exception):
        evalsets.scan_open_book(spark, str(tmp_path / "half.json"), whole_below=1).collect()
    for i, body in enumerate(("[]", ' { "a" : [ ] , "b" : [{"question": "no"}]}', "[\n]\n")):
        (tmp_path / f"none{i}.json").write_text(body)
        got = evalsets.scan_open_book(spark, str(tmp_path / f"none{i}.json"), whole_below=1)
        assert got.count() == 0


def test_a_64_mb_array_is_not_one_task(spark, tmp_path):
    item = json.dumps({"question": "q{}", "context": "c [\"]\\" * 60})
    n = (64 << 20) // len(item) + 1
    (tmp_path / "big.json").write_text("[" + ",".join([item] * n) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(8 << 20))
    try:
        rows = evalsets.scan_open_book(spark, str(tmp_path / "big.json"), whole_below=1 << 20)
        got = rows.selectExpr("count(*)", "count(DISTINCT row)", "max(row)", "max(length(context))")
        got = got.first()
        splits = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
        assert splits >= 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == (n, n, n, 360)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_csv_is_read_by_many_tasks(spark, tmp_path, end):
    for file in ("a.csv", "b.csv"):
        with open(tmp_path / file, "w", newline="") as f:
            writer = csv.writer(f, lineterminator=end)
            writer.writerow(["id", "context", "question \"x\"", "question"])
            for i in range(80):
                for q, c in ODD:
                    writer.writerow((i, c.replace("\r", "") + str(i), "", q.strip() + file))
                if i % 9 == 0:
                    f.write(end)
    with Small(spark):
        small = evalsets.scan_open_book(spark, str(tmp_path / "*.csv"), whole_below=100)
        got = sorted((r.file[-5:], r.row, r.question, r.context) for r in small.collect())
    want = [(q, c.replace("\r", "") + str(i)) for i in range(80) for q, c in ODD]
    assert got == [(f, n, q.strip() + f, c) for f in ("a.csv", "b.csv") for n, (q, c) in enumerate(want, 1)]
    (tmp_path / "b.csv").write_text("id,question,context\n1,q,c\n")
    with pytest.raises(Exception, match="another header"):
        evalsets.scan_open_book(spark, str(tmp_path / "*.csv"), whole_below=10).collect()


def test_results_as_one_array(spark, tmp_path):
    rows = [(q, f"q{q}", 'a "é"\n' + "x" * q) for q in range(30)] + [(30, None, "last")]
    df = spark.createDataFrame(rows, "q bigint, question string, answer string").repartition(7)
    for files in (1, None):
        path = tmp_path / f"r{files}"
        sinks.write_array(df, str(path), ["q"], files)
        parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
        arrays = [json.loads(p.read_text("utf-8")) for p in parts]
        assert len(arrays) == 1 or files is None
        flat = [(r["q"], r["question"], r["answer"]) for a in arrays for r in a]
        assert flat == rows
        back = evalsets.scan_results(spark, str(path)).orderBy("q").collect()
        assert [tuple(r) for r in back] == rows
    sinks.write_array(df.where("q < 0"), str(tmp_path / "none"), ["q"], 1)
    (part,) = [p for p in (tmp_path / "none").iterdir() if p.name.startswith("part-")]
    assert json.loads(part.read_text()) == []
    assert evalsets.scan_results(spark, str(tmp_path / "none")).count() == 0


def test_rerun_of_one_label_and_round_leaves_the_others(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "model_label string, round int, q bigint, answer string"
    first = [(m, n, q, "old") for m in ("base", "tuned") for n in (1, 2) for q in (1, 2, 3)]
    sinks.write_results(spark.createDataFrame(first, schema), path, by=["model_label", "round"])
    again = [("tuned", 2, 1, "new"), ("tuned", 3, 1, "new")]
    sinks.write_results(spark.createDataFrame(again, schema), path, by=["model_label", "round"])
    got = spark.read.schema("q bigint, answer string, model_label string, round int").json(path)
    want = [r for r in first if r[:2] != ("tuned", 2)] + again
    assert sorted((r.model_label, r.round, r.q, r.answer) for r in got.collect()) == sorted(want)
    sinks.write_results(spark.createDataFrame(again[:1], schema), path)
    assert spark.read.json(path).count() == 1


def test_split_readers_store_their_counts(spark, tmp_path):
    """Plans of sums of sums read the files once for the texts, not once for every sum."""
    rows = [{"question": f"q{k}", "context": "} ] \" {" * (k % 4)} for k in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "a.csv").write_text(
        "question,context\n" + "".join(f'"q{k}","a\n""{k}"""\n' for k in range(50))
    )
    for name in ("a.json", "a.csv"):
        found = evalsets.scan_open_book(spark, str(tmp_path / name), whole_below=0)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [value#") == 1
        assert [r.question for r in found.orderBy("row").collect()] == [f"q{k}" for k in range(50)]
