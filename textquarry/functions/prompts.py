"""Fill templates with columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions import templates as t
from textquarry.functions.text import clean, col
from textquarry.functions.tokens import EOS


def split_template(template: str) -> list[tuple[str, str | None]]:
    """``(literal, following field name)`` pairs, in template order."""
    pieces, literal = [], ""
    for text, field, _, _ in Formatter().parse(template):
        literal += text
        if field is not None:
            pieces.append((literal, field))
            literal = ""
    return [*pieces, (literal, None)] if literal else pieces


def render(template: str, **fields: Column | str) -> Column:
    """One concat of literals and columns, so inserted values are never expanded again."""
    pieces: list[Column] = []
    for literal, field in split_template(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(col(fields[field]))
    return F.concat(*pieces)


def qa_generation(chunk: Column | str, n: int = 3) -> Column:
    return render(t.QA_GENERATION, n=F.lit(str(n)), text=chunk)


def training_qa(question: Column | str, answer: Column | str, eos: str = EOS) -> Column:
    return F.concat(render(t.TRAINING_QA, question=question, answer=answer), F.lit(eos))


def training_document(
    citation: Column | str, jurisdiction: Column | str, kind: Column | str, text: Column | str
) -> Column:
    """Document-completion text, still without the end-of-text token."""
    return render(
        t.TRAINING_DOCUMENT,
        citation=citation,
        jurisdiction=jurisdiction,
        type=kind,
        text=F.coalesce(col(text), F.lit("")),
    )


def closed_book(question: Column | str) -> Column:
    return render(t.CLOSED_BOOK, question=question)


def open_book(question: Column | str, context: Column | str) -> Column:
    return render(t.OPEN_BOOK, question=clean(question), context=clean(context))


def short(question: Column | str) -> Column:
    return render(t.SHORT, question=question)


def chat(history: Column | str, question: Column | str, system: str = t.CHAT_SYSTEM) -> Column:
    """``history`` is empty when the conversation has no earlier message."""
    earlier = F.coalesce(col(history), F.lit(""))
    return render(
        t.CHAT,
        system=F.lit(system.strip()),
        history=F.when(earlier == "", F.lit(t.NO_HISTORY)).otherwise(earlier),
        question=question,
    )
