"""Question-answer pairs and JSON objects from untidy model responses.

Everything runs as built-in expressions. ``try_parse_json`` accepts text after the first JSON
value, so a slice is parsed inside an array that a known last item closes: only when both come
back was the slice exactly one JSON value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import clean, col, let, not_blank, strip

PAIRS_TYPE = "array<struct<question:string,answer:string>>"

# The markers a response may use, and the text a server puts before salvaged output.
FENCE_OPEN = r"```[a-z]*\n?"
FENCE_CLOSE = r"\n?```"
FLAT_OBJECT = r"(\{[^{}]+\})"
QUESTION_MARK = r"[Qq](?:uestion)?[:\.\)]"
ANSWER_MARK = r"[Aa](?:nswer)?[:\.\)]"
SALVAGE_MARKER = "Failed to parse input at pos 0: "

_END = "~end of slice~"
_SPACE = r"[\s\x1c-\x1f]*"


def strict_json(slice_: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null."""

    def unwrap(wrapped: Column) -> Column:
        items = F.try_variant_get(wrapped, "$", "array<variant>")
        whole = (F.size(items) == 2) & (F.try_variant_get(wrapped, "$[1]", "string") == _END)
        return F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), slice_, F.lit(f',"{_END}"]'))), unwrap)


def _text_field(item: Column, name: str) -> Column:
    """The field when it is a JSON string, else null."""

    def as_text(field: Column) -> Column:
        is_text = F.schema_of_variant(field) == "STRING"
        return F.when(is_text, F.try_variant_get(field, "$", "string"))

    return let(F.try_variant_get(item, f"$.{name}", "variant"), as_text)


def _pair(item: Column) -> Column:
    return F.struct(
        _text_field(item, "question").alias("question"),
        _text_field(item, "answer").alias("answer"),
    )


def _valid(pair: Column) -> Column:
    return not_blank(pair["question"]) & not_blank(pair["answer"])


def without_fences(response: Column | str) -> Column:
    text = strip(F.regexp_replace(col(response), FENCE_OPEN, ""))
    return strip(F.regexp_replace(text, FENCE_CLOSE, ""))


def pairs_from_array(text: Column) -> Column:
    """First ``[`` to last ``]`` read as one JSON array; invalid elements are dropped."""
    slice_ = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    items = F.try_variant_get(strict_json(slice_), "$", "array<variant>")
    return F.filter(F.transform(items, _pair), _valid)


def pairs_from_objects(text: Column) -> Column:
    """Every brace pair without inner braces, each parsed alone."""
    objects = F.regexp_extract_all(text, F.lit(FLAT_OBJECT), F.lit(1))
    return F.filter(F.transform(objects, lambda o: _pair(F.try_parse_json(o))), _valid)


def pairs_from_markers(text: Column) -> Column:
    """All questions and all answers found by their markers, zipped to the shorter list.

    Questions are sought only up to the last answer marker: no later one can match, and looking
    for it would scan the rest of the text once per question marker.
    """
    until_last_answer = F.regexp_extract(text, rf"(?s)^(.*{ANSWER_MARK})", 1)
    questions = F.regexp_extract_all(
        until_last_answer,
        F.lit(rf"(?sU){QUESTION_MARK}{_SPACE}(.+?)(?={ANSWER_MARK})"),
        F.lit(1),
    )
    answers = F.regexp_extract_all(
        text,
        F.lit(rf"(?sU){ANSWER_MARK}{_SPACE}(.+?)(?={QUESTION_MARK}|\z)"),
        F.lit(1),
    )

    def zip_shorter(found: Column) -> Column:
        n = F.least(F.size(found["q"]), F.size(found["a"]))
        zipped = F.zip_with(
            F.slice(found["q"], F.lit(1), n),
            F.slice(found["a"], F.lit(1), n),
            lambda q, a: F.struct(q.alias("question"), a.alias("answer")),
        )
        return F.filter(zipped, _valid)

    return let(F.struct(questions.alias("q"), answers.alias("a")), zip_shorter)


def _stripped(pairs: Column) -> Column:
    return F.transform(
        pairs,
        lambda p: F.struct(
            strip(p["question"]).alias("question"), strip(p["answer"]).alias("answer")
        ),
    )


def parse_pairs(response: Column | str) -> Column:
    """``struct<strategy, pairs>`` of the first strategy that finds a valid pair.

    Strategies are 1 array, 2 objects, 3 markers, 0 none. ``coalesce`` stops at the first that
    succeeds, so a clean response is parsed once.
    """
    finders = (pairs_from_array, pairs_from_objects, pairs_from_markers)

    def result(strategy: int, pairs: Column) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), _stripped(pairs).alias("pairs"))

    def attempt(strategy: int, text: Column) -> Column:
        pairs = finders[strategy - 1](text)
        return let(pairs, lambda found: F.when(F.size(found) > 0, result(strategy, found)))

    none = result(0, F.array().cast(PAIRS_TYPE))
    return let(
        without_fences(F.coalesce(col(response), F.lit(""))),
        lambda text: F.coalesce(*[attempt(n, text) for n in (1, 2, 3)], none),
    )


def with_pairs(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``strategy`` and ``pairs``."""
    parsed = df.withColumn("_parsed", parse_pairs(response))
    return parsed.select(*df.columns, "_parsed.*")


def exploded_pairs(parsed: DataFrame, *columns: Column | str) -> DataFrame:
    """One row per pair: ``columns``, ``pair_no`` from 0, ``pair``.

    The outer form keeps the optimizer from adding a filter on ``pairs`` that would parse every
    response a second time.
    """
    rows = parsed.select(*columns, F.posexplode_outer("pairs").alias("pair_no", "pair"))
    return rows.where(F.col("pair_no").isNotNull())


def salvage_error(body: Column | str, message: Column | str | None = None) -> Column:
    """Text after the marker in an error, the whole error without one, null when empty.

    ``body`` is the server's JSON error body; without one the error's own text is used.
    """
    body = col(body)
    own_text = body if message is None else col(message)

    def message_of(parsed: Column) -> Column:
        kind = F.schema_of_variant(parsed)
        is_object = kind.startswith("OBJECT<") & (kind != "OBJECT<>")
        return F.when(is_object, _text_field(parsed, "error")).otherwise(own_text)

    def after_marker(text: Column) -> Column:
        at = F.instr(text, SALVAGE_MARKER)
        rest = F.substr(text, at + F.lit(len(SALVAGE_MARKER)))
        return F.nullif(F.when(at > 0, rest).otherwise(text), F.lit(""))

    return let(let(F.try_parse_json(body), message_of), after_marker)


def extract_object(text: Column | str) -> Column:
    """First ``{`` to last ``}`` as ``map<string,variant>``; an empty map when it is not JSON."""
    body = clean(text)
    body = F.regexp_replace(body, r"^```[a-z]*\n?", "")
    body = F.regexp_replace(body, r"\n?```\z", "")
    slice_ = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    found = F.try_variant_get(strict_json(slice_), "$", "map<string,variant>")
    return F.coalesce(found, F.create_map().cast("map<string,variant>"))
