import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions import prompts, text, tokens
from textquarry.functions.templates import CLOSED_BOOK, QA_GENERATION, ROUND_REVIEW

TEXTS = [
    "\n a b \t c\n",
    "  a   b ",
    "",
    "  ",
    "a\x1cb",
    "\xa0x y　",
    "one two three four",
    " é  ü\x85",
]


def rows(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def test_strip_and_words_equal_python(spark):
    got = rows(spark, TEXTS, text.strip("t"), text.word_count("t"), text.words("t"))
    assert got == [(t.strip(), len(t.split()), t.split()) for t in TEXTS]


def test_every_whitespace_character(spark):
    values = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    got = rows(spark, values, text.strip("t"), text.word_count("t"))
    assert got == [(v.strip(), len(v.split())) for v in values]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_has_words(spark, n):
    assert rows(spark, TEXTS, text.has_words("t", n)) == [(len(t.split()) >= n,) for t in TEXTS]


def test_truncate_words(spark):
    got = rows(spark, TEXTS, text.truncate_words("t", 2))
    want = [t if len(t.split()) <= 2 else " ".join(t.split()[:2]) + "…" for t in TEXTS]
    assert got == [(w,) for w in want]


def test_caps_and_previews(spark):
    values = ["x" * 80, "y" * 81, "a\nb", ""]
    got = rows(spark, values, text.preview("t"), text.one_line("t", 2), text.cap("t", 80))
    assert got == [
        ("x" * 80, "xx", "x" * 80),
        ("y" * 80 + "...", "yy", "y" * 80 + "…"),
        ("a\nb", "a ", "a\nb"),
        ("", "", ""),
    ]


def test_capitalize(spark):
    values = ["USER", "assistant", "", "two WORDS"]
    assert rows(spark, values, text.capitalize("t")) == [(v.capitalize(),) for v in values]


def test_truncate_answer_lines(spark):
    value = "A: abcdef\nmore of it\nQ: A: abcdef\nA: ab"
    want = "A: a…\nmore of it\nQ: A: abcdef\nA: a…"
    assert rows(spark, [value], text.truncate_answer_lines("t", 4)) == [(want,)]


def test_fixed_decimals_equal_python(spark):
    rng = random.Random(1)
    values = [rng.uniform(-20, 20) for _ in range(300)] + [
        0.00015, 0.03125, 2.00005, 0.0, 1e9, float("nan"), float("inf"), float("-inf"),
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(text.fixed_decimals("v")).collect()]
    assert got == [f"{v:.4f}" for v in values]


def test_float_text_equals_python(spark):
    values = [
        5e-5, 1e-6, 0.00025, 1e-4, 0.1, 16.5, 128.0, 0.0, -3.5, 1.5e7, 12345678.25, 1e16, 2.5e-11,
        123456789012345680.0, -1e-7,
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.float_text("v")).collect()] == [repr(v) for v in values]


def test_templates_do_not_expand_inserted_values(spark):
    value = "{text} {question} {{x}}"
    got = rows(spark, [value], prompts.closed_book("t"), prompts.qa_generation("t", 3))
    assert got == [(CLOSED_BOOK.format(question=value), QA_GENERATION.format(n=3, text=value))]


def test_split_template_keeps_literal_braces():
    pieces = prompts.split_template(ROUND_REVIEW)
    assert [field for _, field in pieces] == [
        "round", "config", "losses", "history", "answers", None,
    ]
    assert "return: {}\n" in pieces[-1][0]


def test_chat_prompt_without_history(spark):
    got = rows(spark, [""], prompts.chat("t", F.lit("why?"), "be kind"))[0][0]
    assert "### Previous conversation: (none)\n" in got and "be kind" in got


def test_tokens_are_lossless(spark):
    values = [*TEXTS, "a  b\n\nc d "]
    got = rows(spark, values, tokens.decode(tokens.encode("t")), F.size(tokens.encode("t")))
    assert [g[0] for g in got] == values
    assert got[0][1] == 4  # the trailing newline is its own token


def test_truncated_text_loses_the_end_token(spark):
    values = ["a b c", "a b", "a"]
    got = rows(spark, values, tokens.truncate("t", 2), tokens.truncate("t", F.lit(3)))
    assert got == [("a b", "a b c"), ("a b", "a b</s>"), ("a</s>", "a</s>")]
