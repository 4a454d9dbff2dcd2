"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests.

Every whole text is searched with built-in expressions. Positions come from the texts between the
matches, as a match starts where what stands before it ends. A run of letters and digits, or a
part of one, that uses all kinds of characters of an encoding is tested against chance: uniform use of the alphabet
(chi-squared), runs above and below its middle, and correlation of neighbours. Runs for which
chance is a discovery-controlled rejection (Benjamini-Hochberg, per encoding and length) are names,
numbers or prose; the others are reported as spans of kind ``random``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.tables import Scratch, query, table

# The patterns and least lengths of the base kinds.
ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "random"]

SHORTEST = 16
RUN = f"[A-Za-z0-9+/_-]{{{SHORTEST},}}"
# A run that fits no encoding is cut at + and /, and what then fits none at all separators but
# those between groups of hex digits. Groups repeat possessively: other repeats of a group take a
# stack frame each, which very long texts exhaust.
PARTS = [
    f"[A-Za-z0-9_-]{{{SHORTEST},}}",
    "(?<![A-Za-z0-9])(?:[0-9a-f]{4,}(?:-[0-9a-f]{4,}+(?![A-Za-z0-9]))++"
    "|[0-9A-F]{4,}(?:-[0-9A-F]{4,}+(?![A-Za-z0-9]))++)"
    f"|[A-Za-z0-9]{{{SHORTEST},}}",
]
# Encodings by the characters a run must and may use, and their alphabets in code order.
DIGITS, UP, LOW = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": ("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    "upperhex": ("^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    "hexgroups": ("^(?=.*[0-9])(?=.*[a-f])(?=.*-)(?!.*--)[0-9a-f][0-9a-f-]*[0-9a-f]$", DIGITS + "abcdef"),
    "upperhexgroups": ("^(?=.*[0-9])(?=.*[A-F])(?=.*-)(?!.*--)[0-9A-F][0-9A-F-]*[0-9A-F]$", DIGITS + "ABCDEF"),
    "base32": ("^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UP + "234567"),
    "base36": ("^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOW),
    "upper36": ("^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UP),
    "letters": ("^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", UP + LOW),
    "base62": ("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", DIGITS + UP + LOW),
    "base64": ("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", UP + LOW + DIGITS + "+/"),
    "base64url": ("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", UP + LOW + DIGITS + "-_"),
}
FDR = 0.01
_CHUNK = 256  # matches placed at a time
_STEP, _WORST = 20, 6000  # p-values are binned by 20 steps a decade, down to 1e-300


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str, kind: str, passes) -> Column:
    """Array of (start, end, kind, value): leftmost matches of ``pattern`` that pass."""

    def located(matches: Column) -> Column:
        # Chunk by chunk, so that no growing list is copied for every match of a long text.
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _CHUNK).cast("int")),
            lambda c: F.slice(matches, c * _CHUNK + 1, F.lit(_CHUNK)),
        )
        return _let(chunks, lambda parts: F.flatten(F.zip_with(parts, _starts(parts), _walk)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    walk = _let(F.arrays_zip(found.alias("value"), gaps.alias("gap")), located)
    spans = F.transform(
        F.filter(walk, lambda s: passes(s["value"])),
        lambda s: F.struct(
            s["start"], F.lit(KINDS.index(kind)).alias("kind"), s["end"], s["value"]
        ),
    )
    # Almost every text holds no match: one search settles those.
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def _length(match: Column) -> Column:
    return match["gap"] + F.coalesce(F.length(match["value"]), F.lit(0))


def _starts(parts: Column) -> Column:
    """Where each chunk of matches begins in the text."""
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, part: F.struct(
            F.aggregate(part, acc["at"], lambda at, m: at + _length(m)).alias("at"),
            F.concat(acc["out"], F.array(acc["at"])).alias("out"),
        ),
    )["out"]


def _walk(part: Column, start: Column) -> Column:
    """A chunk's matches with their places; the end of each is carried on to the next."""
    return F.aggregate(
        part,
        F.struct(start.alias("at"), F.array().cast(MATCHES).alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + _length(m)).alias("at"),
            F.when(
                m["value"].isNotNull(),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + m["gap"]).alias("start"),
                            (acc["at"] + _length(m)).alias("end"),
                            m["value"].alias("value"),
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )["out"]


MATCHES = "array<struct<start:int,end:int,value:string>>"
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _longer(kind: str):
    if kind == "assign":
        return lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= LEAST[kind]
    return lambda v: F.length(v) >= LEAST[kind]


def _encoding(value: Column) -> Column:
    name = F.lit(None).cast("string")
    for key, (pattern, _) in reversed(ENCODINGS.items()):
        name = F.when(value.rlike(pattern), key).otherwise(name)
    return name


def _symbols(value: Column, encoding: Column) -> Column:
    """The characters of a run that its encoding draws."""
    return F.when(encoding.endswith("groups"), F.replace(value, F.lit("-"), F.lit(""))).otherwise(value)


def _fitting(spans: Column, patterns: list[str]) -> Column:
    """The spans that fit an encoding, and of the others the parts that do."""

    def cut(s):
        if not patterns:
            return F.array().cast(SPANS)
        parts = _spans(s["value"], patterns[0], "random", lambda v: F.lit(True))
        moved = F.transform(
            parts,
            lambda part: F.struct(
                (s["start"] + part["start"]).alias("start"),
                part["kind"].alias("kind"),
                (s["start"] + part["end"]).alias("end"),
                part["value"].alias("value"),
            ),
        )
        return _fitting(moved, patterns[1:])

    return F.flatten(
        F.transform(
            spans, lambda s: F.when(_encoding(s["value"]).isNotNull(), F.array(s)).otherwise(cut(s))
        )
    )


def _tail(z: Column) -> Column:
    """P(|N(0, 1)| > z) for z >= 0 by a rational approximation of the error function."""
    # Abramowitz and Stegun, formula 7.1.26.
    x = z / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (
        0.254829592
        + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))
    )
    return poly * F.exp(-x * x)


def randomness(value: Column, encoding: Column) -> Column:
    """Struct of z-values (uniform, runs, serial) and p: how likely chance strays as far.

    Moments of all three tests are exact for n independent uniform symbols, so short strings are
    judged by what their length can show.
    """
    alphabet = F.lit("")
    for key, (_, letters) in reversed(ENCODINGS.items()):
        alphabet = F.when(encoding == key, letters).otherwise(alphabet)

    drawn = _symbols(value, encoding)
    codes = F.transform(F.split(drawn, ""), lambda c: F.instr(alphabet, c) - 1)
    read = F.struct(codes.alias("codes"), F.length(alphabet).cast("double").alias("size"))
    return _let(read, _battery)


def _battery(s: Column) -> Column:
    codes, size = s["codes"], s["size"]
    n = F.size(codes).cast("double")
    middle, spread = (size - 1) / 2, (size * size - 1) / 12
    squares = F.aggregate(
        F.transform(
            F.array_distinct(codes),
            lambda c: F.pow(F.size(F.filter(codes, lambda o: o == c)).cast("double"), F.lit(2.0)),
        ),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    neighbours = F.zip_with(
        F.slice(codes, 1, F.size(codes) - 1),
        F.slice(codes, 2, F.size(codes) - 1),
        lambda a, b: F.struct(
            ((a > middle) != (b > middle)).cast("double").alias("change"),
            ((a - middle) * (b - middle)).alias("product"),
        ),
    )
    totals = F.aggregate(
        neighbours,
        F.struct(F.lit(0.0).alias("changes"), F.lit(0.0).alias("products")),
        lambda acc, x: F.struct(
            (acc["changes"] + x["change"]).alias("changes"),
            (acc["products"] + x["product"]).alias("products"),
        ),
    )
    uniform = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    runs = (totals["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    serial = totals["products"] / spread / F.sqrt(n - 1)
    z = F.sqrt(
        F.pow(F.greatest(uniform, F.lit(0.0)), F.lit(2.0))
        + F.pow(runs, F.lit(2.0))
        + F.pow(serial, F.lit(2.0))
    )
    # Upper tail of a chi-squared variable with three degrees of freedom at z squared.
    p = _tail(z) + z * (2 / 3.141592653589793) ** 0.5 * F.exp(-z * z / 2)
    return F.struct(
        uniform.alias("uniform"),
        runs.alias("runs"),
        serial.alias("serial"),
        F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)).alias("p"),
    )


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR
) -> DataFrame:
    """Per row of ``docs``: doc_id and spans, an array of (start, kind, end, p) in text order.

    start and end count code points of the raw text, end exclusive; kind is a place in KINDS; p is
    null for the base kinds. A null or empty text has no spans. Rows that repeat are answered
    alike, and an empty table gives an empty result. Other columns play no part.

    fdr: of the runs called non-random, at most this share is random, in every class of encoding
    and length (in octaves).
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(docs[text_col], F.lit(""))
    spans = [
        _spans(text, pattern, kind, _longer(kind)).alias(kind)
        for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", "[0-9a-f]{32,}"))
    ]
    runs = _fitting(_spans(text, RUN, "random", lambda v: F.length(v) >= SHORTEST), PARTS)
    named = F.transform(
        runs,
        lambda s: F.struct(
            s["start"], s["kind"], s["end"], s["value"], _encoding(s["value"]).alias("encoding")
        ),
    )
    tested = F.transform(
        named,
        lambda s: F.struct(
            s["start"],
            s["kind"],
            s["end"],
            s["encoding"],
            F.floor(F.log2(F.length(_symbols(s["value"], s["encoding"])))).cast("int").alias("octave"),
            randomness(s["value"], s["encoding"])["p"].alias("p"),
        ),
    )
    found = scratch.write(
        docs.select(
            docs[id_col].alias("doc_id"),
            F.transform(
                F.concat(*spans),
                lambda s: F.struct(
                    s["start"], s["kind"], s["end"], F.lit(None).cast("double").alias("p")
                ),
            ).alias("base"),
            tested.alias("tested"),
        ),
        "found",
    )

    def bin_of(p):
        return F.least(F.floor(-F.log10(p) * _STEP), F.lit(_WORST)).cast("int")

    bins = (
        found.select(F.explode("tested").alias("s"))
        .groupBy("s.encoding", "s.octave", bin_of(F.col("s.p")).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    # At most one row per class and bin from here on: a few thousand, whatever the input.
    family = Window.partitionBy("encoding", "octave")
    worse = family.orderBy(F.desc("bin"))
    ranked = bins.select(
        "*", F.sum("n").over(worse).alias("below"), F.sum("n").over(family).alias("all")
    )
    # The bin's largest p is 10 ** (-bin / step).
    rejected = ranked.where(
        F.pow(F.lit(10.0), -F.col("bin") / _STEP) * F.col("all") <= fdr * F.col("below")
    )
    least = rejected.groupBy("encoding", "octave").agg(F.min("bin").alias("bin"))
    bounds = least.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws(" ", "encoding", "octave"), F.col("bin")))
        )
    ).scalar()
    shown = F.filter(
        "tested",
        lambda s: bin_of(s["p"])
        < F.coalesce(
            F.col("bounds")[F.concat_ws(" ", s["encoding"], s["octave"])], F.lit(_WORST + 1)
        ),
    )
    kept = F.transform(shown, lambda s: F.struct(s["start"], s["kind"], s["end"], s["p"]))
    return found.withColumn("bounds", bounds).select(
        "doc_id", F.array_sort(F.concat("base", kept)).alias("spans")
    )


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


@query("op9_secret_scan")
def op9(spark, sf_dir):
    found = secret_spans(table(spark, sf_dir, "documents"))

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    return found.select(
        "doc_id",
        *[n(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
