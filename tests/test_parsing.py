import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions.parsing import (
    SALVAGE_MARKER,
    exploded_pairs,
    extract_object,
    salvage_error,
    with_pairs,
)

QA = '{"question":"q","answer":"a"}'
QA1 = '{"question":"q1","answer":"a1"}'
QA2 = '{"question":"q2","answer":"a2"}'

CASES = [
    (f"[{QA}]", [("q", "a")], 1),
    (f"```json\n[{QA}]\n```", [("q", "a")], 1),
    (f"Here are pairs:\n[{QA}]", [("q", "a")], 1),
    (f"[{QA}]\nDone.", [("q", "a")], 1),
    (f"{QA1}\n{QA2}", [("q1", "a1"), ("q2", "a2")], 2),
    (f"[{QA1}]\n[{QA2}]", [("q1", "a1"), ("q2", "a2")], 2),
    (f"[{QA1}, {QA2}", [("q1", "a1"), ("q2", "a2")], 2),
    (f'[{QA1}], "b": [{QA2}]', [("q1", "a1"), ("q2", "a2")], 2),
    (f"[{QA1}]] tail ]", [("q1", "a1")], 2),
    (f'[{{"question":5,"answer":"x"}},{QA},{{"question":" ","answer":"a"}},3]', [("q", "a")], 1),
    ("Q: one? A: yes.\nQuestion: two? Answer: no", [("one?", "yes."), ("two?", "no")], 3),
    ('[{"question":5,"answer":"x"}]', [], 0),
    ("", [], 0),
    ("plain prose without pairs", [], 0),
    ('[{"question":"q","answer":"a","x":{"y":1}}] tail ]', [], 0),
    ("Q: What is Australia. A: a place", [("What is Australi", "A: a place")], 3),
    ("Idea 1:\n* Question: u?\n* Answer: v", [("u?\n*", "v")], 3),
    ("Q: lone question", [], 0),
    ("A: lone answer", [], 0),
    ("Q:   A: end", [], 0),
    ("Q: one? A: 1 Q: two?", [("one?", "1")], 3),
    ("Q1\nQ) first\n\nA) line one\nline two\nQ) second A) x",
     [("first", "line one\nline two"), ("second", "x")], 3),
    ('[{"question":" padded\\n","answer":"\\ta "}]', [("padded", "a")], 1),
    ('[{"question":"old","question":"new","answer":"a"}]', [("new", "a")], 1),
    ('[{"question":"line\nbreak","answer":"a"}]', [], 0),
    (None, [], 0),
]


def test_golden_responses(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, response string")
    got = with_pairs(df).orderBy("i").collect()
    for row, (response, pairs, strategy) in zip(got, CASES):
        assert ([tuple(p) for p in row["pairs"]], row["strategy"]) == (pairs, strategy), response


def test_rendered_pairs_come_back(spark):
    pairs = [(f'q "{i}" {{x}} [y]', f"a\n{i}\t\\ é") for i in range(5)]
    body = json.dumps([{"question": q, "answer": a} for q, a in pairs])
    df = spark.createDataFrame([(f"Sure!\n```json\n{body}\n```",)], "response string")
    rows = exploded_pairs(with_pairs(df)).orderBy("pair_no").collect()
    assert [tuple(r["pair"]) for r in rows] == pairs


def test_many_questions_without_answers_stay_fast(spark):
    df = spark.createDataFrame([("Q: one A: two " + "Q: x " * 50_000,)], "response string")
    row = with_pairs(df).first()
    assert row["strategy"] == 3 and row["pairs"][0]["answer"] == "two"


def test_strategies_are_parsed_once(spark):
    plan = exploded_pairs(with_pairs(spark.createDataFrame([("x",)], "response string")))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("```[a-z]*") == 1


@pytest.mark.parametrize(
    "body, want",
    [
        (json.dumps({"error": SALVAGE_MARKER + "X"}), "X"),
        (json.dumps({"error": "other"}), "other"),
        (json.dumps({"error": ""}), None),
        (json.dumps({"error": {"deep": 1}}), None),
        (json.dumps({"code": 1}), None),
        ("{}", "{}"),
        (f"Error code: 400 - {SALVAGE_MARKER}tail", "tail"),
        (SALVAGE_MARKER, None),
        ("", None),
        (None, None),
    ],
)
def test_salvage_error(spark, body, want):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(salvage_error("b")).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"r": 8}', {"r": "8"}),
        ('```json\n{"r": 8, "a": "x"}\n```', {"r": "8", "a": "x"}),
        ('I suggest {"r": 8.5} now', {"r": "8.5"}),
        ('{"r": 8} {"r": 9}', {}),
        ('{"r": 8}, "b": {}', {}),
        ('{"r": 8', {}),
        ("nothing", {}),
        (None, {}),
    ],
)
def test_extract_object(spark, text, want):
    found = F.transform_values(extract_object("t"), lambda _, v: v.cast("string"))
    assert spark.createDataFrame([(text,)], "t string").select(found).first()[0] == want
