"""Large JSON arrays and quoted CSV files, read by many tasks.

Spark splits a text file at any separator. A file is cut into pieces after every closing brace or
line end; whether a piece begins inside a quoted string, and how deep, follows from counts over the
pieces before it, which are summed without the texts. Pieces of one element are then put together.
The counts and each sum are stored: a sum reads its input more than once, and sums follow sums, so the
files would be read and searched for every reading of the last one. Texts are read twice.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.ordered import prefix_sum
from textquarry.session import hadoop, stage

_AT = "at"


def file_pieces(spark: SparkSession, paths: Sequence[str], separator: str) -> DataFrame:
    """``(file, at, piece)``: what stands before each separator; ``at`` grows along the file."""
    lines = spark.read.option("lineSep", separator).text(list(paths))
    # A split's rows keep their order, and splits tell where in the file they begin.
    place = F.struct(
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    file = F.col("_metadata.file_path").alias("file")
    return lines.select(file, place.alias(_AT), F.col("value").alias("piece"))


def _joined(pieces: DataFrame, places: DataFrame, group: str, separator: str) -> DataFrame:
    """``(file, group, text)``: the pieces of each group in order, put together again."""
    parts = F.array_sort(F.collect_list(F.struct(_AT, "piece")))
    text = F.array_join(F.transform(parts, lambda p: p["piece"]), separator)
    return pieces.join(places, ["file", _AT]).groupBy("file", group).agg(text.alias("text"))


# How a file begins: the bracket of its array, or a brace, one key and that bracket.
_BARE = r"^\s*\["
_ENVELOPE = r'^\s*\{\s*"(?:[^"\\]|\\.){0,1000}"\s*:\s*\['
_HEAD_BYTES = 16 << 10


def _bases(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """Each file that holds an element, and how deep its elements are. Reads the files' beginnings."""
    found = []
    for path in paths:
        hadoop_path, fs = hadoop(spark, path)
        stream = fs.open(hadoop_path)
        head = bytes(stream.readNBytes(_HEAD_BYTES)).decode("utf-8", "ignore")
        stream.close()
        for base, opening in ((1, _BARE), (2, _ENVELOPE)):
            if begin := re.match(opening, head):
                break
        first = head[begin.end() :].lstrip()[:1] if begin else ""
        if first not in ("{", "]"):
            raise ValueError(f"no array of rows in {path}")
        if first == "{":
            found.append((hadoop_path.toUri().toString(), base))
    return found


def array_elements(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, row, text)``: the objects of a JSON array per file, numbered from 1.

    The array is the file's only value, or the first value of its one object; what else the object
    holds is left out. A file that is neither is an error, and so are elements that are no objects,
    once they are parsed.
    """
    bases = spark.createDataFrame(_bases(spark, paths), "file string, base int")
    pieces = file_pieces(spark, paths, "}")
    # Without escaped characters every quote opens or closes a string: what stands outside of
    # strings is every other part, the first or the second by how the piece begins.
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"')

    def outside(begins_inside: int) -> Column:
        return F.array_join(F.filter(parts, lambda _, i: i % 2 == begins_inside), " ")

    def depth(begins_inside: int) -> Column:
        text = outside(begins_inside)
        opened = F.length(text) - F.length(F.translate(text, "[{", ""))
        closed = F.length(text) - F.length(F.translate(text, "]}", ""))
        # The separator closes an object unless it stands in a string.
        brace = F.when((F.size(parts) - 1 + begins_inside) % 2 == 0, 1).otherwise(0)
        return opened - closed - brace

    counts = pieces.select(
        "file",
        _AT,
        (F.size(parts) - 1).alias("quotes"),
        depth(0).alias("depth_outside"),
        depth(1).alias("depth_inside"),
        F.regexp_like(outside(0), F.lit(r"^[\s,]*\]")).alias("closes"),
    )
    inside = prefix_sum(
        stage(counts, "pieces"), _AT, F.col("quotes"), "quotes_before", ["file"]
    )
    begins_inside = F.col("quotes_before") % 2 == 1
    change = F.when(begins_inside, F.col("depth_inside")).otherwise(F.col("depth_outside"))
    inside = inside.select(
        "file", _AT, "quotes", "closes", begins_inside.alias("inside"), change.alias("change")
    )
    deep = prefix_sum(stage(inside, "pieces"), _AT, F.col("change"), "depth", ["file"])

    placed = stage(deep, "pieces").join(F.broadcast(bases), "file")
    over = (F.col("depth") == F.col("base")) & ~F.col("inside") & F.col("closes")
    end = placed.where(over).groupBy("file").agg(F.min(_AT).alias("over"))
    last = (F.col("depth") + F.col("change") == F.col("base")) & (
        (F.col("quotes") + F.col("inside").cast("int")) % 2 == 0
    )
    elements = placed.join(end, "file", "left").where(
        F.col("over").isNull() | (F.col(_AT) < F.col("over"))
    )
    elements = elements.select("file", _AT, last.cast("int").alias("last"))
    numbered = prefix_sum(stage(elements, "pieces"), _AT, F.col("last"), "before", ["file"])
    places = numbered.select("file", _AT, (F.col("before") + 1).alias("row"))
    texts = _joined(pieces, places, "row", "}")
    opening = rf"(?:{_ENVELOPE}|{_BARE})\s*"
    before = F.when(F.col("row") > 1, F.lit(r"^\s*,?\s*")).otherwise(F.lit(opening))
    own = F.concat(F.regexp_replace("text", before, F.lit("")), F.lit("}"))
    return texts.select("file", "row", own.alias("text"))


def quoted_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, record, text)``: the records of CSV files with their header as the first.

    Line ends inside quotes are part of a record; lines that are empty outside of quotes are none.
    Quotes in a value must be doubled, and the value quoted.
    """
    lines = file_pieces(spark, paths, "\n")
    quotes = F.length("piece") - F.length(F.translate("piece", '"', ""))
    blank = F.rtrim("piece", F.lit("\r")) == ""
    counts = lines.select("file", _AT, quotes.alias("quotes"), blank.alias("blank"))
    open_ = prefix_sum(stage(counts, "pieces"), _AT, F.col("quotes"), "before", ["file"])
    starts = F.col("before") % 2 == 0
    kept = open_.where(~(starts & F.col("blank")))
    kept = stage(kept.select("file", _AT, starts.cast("int").alias("starts")), "pieces")
    numbered = prefix_sum(kept, _AT, F.col("starts"), "record", ["file"])
    places = numbered.select("file", _AT, (F.col("record") + F.col("starts")).alias("record"))
    texts = _joined(lines, places, "record", "\n")
    return texts.withColumn("text", F.rtrim("text", F.lit("\r")))
