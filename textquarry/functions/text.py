"""Whitespace, words, previews and fixed number formats."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip and str.split treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
TOKEN_BOUNDARY = r"(?U)(?<=[^\s\x1c-\x1f])(?=[\s\x1c-\x1f])"

ELLIPSIS = "…"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove Unicode whitespace at both ends; null stays null."""
    return F.btrim(col(text), F.lit(WHITESPACE))


def clean(text: Column | str) -> Column:
    """Strip, with null read as empty text."""
    return F.coalesce(strip(text), F.lit(""))


def not_blank(text: Column | str) -> Column:
    return F.length(clean(text)) > 0


def words(text: Column | str, limit: int = -1) -> Column:
    """Words of ``text``; with ``limit``, the last item holds the unsplit rest."""
    # Clean text has no empty item but the one that empty text gives.
    return F.array_remove(F.split(clean(text), SPACE_RUN, limit), "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def has_words(text: Column | str, n: int) -> Column:
    """At least ``n`` words. Splitting stops at word ``n``, however long the text is."""
    return F.size(words(text, n)) >= n


def truncate_words(text: Column | str, n: int) -> Column:
    """First ``n`` words joined by one space plus an ellipsis; shorter text is unchanged."""
    text = col(text)

    def cut(head: Column) -> Column:
        first = F.array_join(F.slice(head, 1, n), " ")
        return F.when(F.size(head) <= n, text).otherwise(F.concat(first, F.lit(ELLIPSIS)))

    return let(words(text, n + 1), cut)


def cap(text: Column | str, n: int, mark: str = ELLIPSIS) -> Column:
    """First ``n`` characters, marked when something was cut."""
    text = col(text)
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def preview(text: Column | str, n: int = 80) -> Column:
    return cap(text, n, "...")


def one_line(text: Column | str, n: int = 300) -> Column:
    """First ``n`` characters with newlines shown as spaces."""
    return F.translate(F.left(col(text), F.lit(n)), "\n", " ")


def capitalize(text: Column | str) -> Column:
    """First character upper case, the rest lower case."""
    text = col(text)
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def truncate_answer_lines(text: Column | str, n: int) -> Column:
    """Cut each line that starts with ``A: `` to ``n`` characters; other lines stay whole."""

    def cut(line: Column) -> Column:
        return F.when(line.startswith("A: "), cap(line, n)).otherwise(line)

    return F.array_join(F.transform(F.split(col(text), "\n"), cut), "\n")


def truncated_lengths(text: Column | str, limits: Sequence[int | None]) -> Column:
    """Lengths of ``truncate_answer_lines`` for each limit, None for the whole text, as an array.

    Counted from the lengths of the lines, without building the texts.
    """

    def counted(lines: Column) -> Column:
        def total(limit: int | None) -> Column:
            def length(line: Column) -> Column:
                whole = line["length"]
                if limit is None:
                    return whole
                return F.when(line["answer"] & (whole > limit), limit + len(ELLIPSIS)).otherwise(whole)

            return F.aggregate(lines, F.size(lines) - 1, lambda sum_, line: sum_ + length(line))

        return F.array(*[total(limit) for limit in limits])

    lines = F.transform(
        F.split(col(text), "\n"),
        lambda line: F.struct(
            F.length(line).alias("length"), F.startswith(line, F.lit("A: ")).alias("answer")
        ),
    )
    return let(lines, counted)


def fixed_decimals(value: Column | str, places: int = 4) -> Column:
    """``%.<places>f`` with the exact binary value rounded half-even, as C and Python do."""
    value = col(value).cast("double")
    pattern = "0." + "0" * places
    # Java's formatter drops a lone 5 just past the last place without looking at its exact value.
    half = 5 / 10 ** (places + 1)
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .when(value == half, F.lit(f"{half:.{places}f}"))
        .when(value == -half, F.lit(f"{-half:.{places}f}"))
        .otherwise(F.call_function("format_number", value, F.lit(pattern)))
    )


def float_text(value: Column | str) -> Column:
    """Shortest decimal text of a finite double: ``0.1``, ``16.5``, ``5e-05``, ``1e+16``.

    Spark writes an exponent outside 1e-3..1e7; the wanted text does so outside 1e-4..1e16.
    """

    def parts(raw: Column) -> Column:
        return F.struct(
            raw.alias("raw"),
            F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "").alias("mantissa"),
            F.split_part(raw, F.lit("E"), F.lit(2)).try_cast("int").alias("exponent"),
        )

    def assemble(p: Column) -> Column:
        exponent, mantissa = p["exponent"], p["mantissa"]
        digits = F.replace(mantissa, F.lit("."), F.lit(""))
        zeros = F.repeat(F.lit("0"), F.abs(exponent) - 1)
        power = F.abs(exponent).cast("string")
        return (
            F.when(exponent.isNull(), p["raw"])
            .when(exponent < -9, F.concat(mantissa, F.lit("e-"), power))
            .when(exponent < -4, F.concat(mantissa, F.lit("e-0"), power))
            .when(exponent < 0, F.concat(F.lit("0."), zeros, digits))
            .when(exponent >= 16, F.concat(mantissa, F.lit("e+"), power))
            # The point moves right, behind zeros or between the digits.
            .when(
                F.length(digits) <= exponent + 1,
                F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0")),
            )
            .otherwise(
                F.concat(
                    F.left(digits, exponent + 1),
                    F.lit("."),
                    F.substr(digits, exponent + F.lit(2)),
                )
            )
        )

    value = col(value).cast("double")
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, let(parts(F.abs(value).cast("string")), assemble))
