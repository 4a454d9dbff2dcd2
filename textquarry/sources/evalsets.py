"""Evaluation inputs and earlier results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry import schemas
from textquarry.functions.text import not_blank, strip
from textquarry.operators.ordered import number_rows
from textquarry.session import hadoop
from textquarry.sources.corpus import _matches
from textquarry.sources.pieces import array_elements, quoted_records

REQUIRED = ("question", "context")
# Bytes up to which a file is one task's work.
WHOLE_BELOW = 64 << 20


def scan_open_book(spark: SparkSession, path: str, **options) -> DataFrame:
    """``(file, row, question, context)`` from JSON or CSV, chosen by the extension."""
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if extension == "json":
        return scan_open_book_json(spark, path, **options)
    if extension == "csv":
        return scan_open_book_csv(spark, path, **options)
    raise ValueError(f"unsupported file type .{extension}: use .json or .csv")


def _by_size(spark: SparkSession, path: str, limit: int) -> tuple[list[str], list[str], list[str]]:
    """Empty files, those of at most ``limit`` bytes, and larger ones."""
    hadoop_path, fs = hadoop(spark, path)
    found: tuple[list[str], list[str], list[str]] = ([], [], [])
    for status in fs.globStatus(hadoop_path) or []:
        for file in fs.listStatus(status.getPath()):  # of a folder, what is directly in it
            if file.isFile() and not file.getPath().getName().startswith(("_", ".")):
                size = file.getLen()
                found[0 if not size else 1 if size <= limit else 2].append(
                    file.getPath().toString()
                )
    return found


def scan_open_book_json(spark: SparkSession, path: str, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """An array of objects per file, or an object whose first value is that array.

    ``row`` counts from 1 inside each file. A file of at most ``whole_below`` bytes is read whole by
    one task, a larger one by as many as it has splits. A body that is neither is an error.
    """
    empty, small, large = _by_size(spark, path, whole_below)
    if empty:  # Spark passes over them
        raise ValueError(f"no array of rows in {empty[0]}")
    item = f"struct<{schemas.OPEN_BOOK}>"
    parts = []
    if large:
        texts = array_elements(spark, large)
        parsed = F.from_json("text", item, {"mode": "FAILFAST"})
        parts.append(texts.select("file", "row", parsed.alias("item")))
    if small or not large:
        parts.append(_whole_arrays(spark, small or [path], item))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("file", F.col("row").cast("bigint").alias("row"), "item.*")


def _whole_arrays(spark: SparkSession, paths: list[str], item: str) -> DataFrame:
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), strip("value").alias("body")
    )
    # Read as a map, the values of an envelope stay JSON text and any key will do.
    envelope = F.from_json("body", "map<string,string>", {"mode": "FAILFAST"})
    first_value = envelope[F.get(F.json_object_keys("body"), F.lit(0))]
    body = F.when(F.startswith("body", F.lit("{")), first_value).otherwise(F.col("body"))
    message = F.concat(F.lit("no array of rows in "), F.col("file"))
    is_array = F.startswith(body, F.lit("["))
    rows = F.when(is_array, body).otherwise(F.raise_error(message).cast("string"))
    parsed = F.from_json(rows, f"array<{item}>", {"mode": "FAILFAST"})
    items = files.select("file", F.posexplode(parsed).alias("pos", "item"))
    return items.select("file", (F.col("pos") + 1).alias("row"), "item")


_CSV = {"quote": '"', "escape": '"', "emptyValue": ""}


def scan_open_book_csv(spark: SparkSession, path: str, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """Header row, quoted newlines and doubled quotes; every value is text.

    ``row`` counts from 1 inside each file. A file of at most ``whole_below`` bytes is read by one
    task, which meets its rows in order, a larger one by as many as it has splits. All files have
    the same header.
    """
    _, small, large = _by_size(spark, path, whole_below)
    parts = []
    if large:
        parts.append(_split_csv(spark, large))
    if small or not large:
        parts.append(_whole_csv(spark, small or [path]))
    return reduce(DataFrame.unionByName, parts)


def _csv_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    table = spark.read.options(header=True, multiLine=True, **_CSV).csv(paths)
    for name in REQUIRED:
        if name not in table.columns:
            raise ValueError(f"row 1 is missing required column '{name}'")
    return table


def _whole_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    texts = [F.coalesce(F.col(name), F.lit("")).alias(name) for name in REQUIRED]
    ids = _csv_table(spark, paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("id"),
        *texts,
    )
    first = ids.groupBy("file").agg(F.min("id").alias("first"))
    return ids.join(first, "file").select(
        "file", (F.col("id") - F.col("first") + 1).alias("row"), *REQUIRED
    )


def _split_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    columns = _csv_table(spark, paths[:1]).columns
    fields = [f"_{i}" for i in range(len(columns))]
    parsed = F.from_csv("text", ", ".join(f"{f} string" for f in fields), _CSV)
    records = quoted_records(spark, paths).select("file", "record", parsed.alias("v"))
    same = F.forall(
        F.arrays_zip(
            F.array(*[F.col(f"v.{f}") for f in fields]), F.array(*[F.lit(c) for c in columns])
        ),
        lambda z: z["0"].eqNullSafe(z["1"]),
    )
    message = F.concat(F.lit("another header in "), F.col("file"))
    header = (F.col("record") == 1) & F.when(same, F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    places = {c: f for f, c in zip(fields, columns, strict=True)}
    return records.where(~header).select(
        "file",
        (F.col("record") - 1).alias("row"),
        *[F.coalesce(F.col(f"v.{places[name]}"), F.lit("")).alias(name) for name in REQUIRED],
    )


def missing_columns(df: DataFrame, row: str = "row") -> DataFrame:
    """``(row, missing_column)`` of each row lacking a required value, first in column order."""
    missing = F.coalesce(
        *[F.when(F.col(name).isNull(), F.lit(name)) for name in REQUIRED]
    )
    return df.select(F.col(row), missing.alias("missing_column")).where(
        F.col("missing_column").isNotNull()
    )


def require_columns(df: DataFrame, row: str = "row") -> DataFrame:
    """The input, or an error naming its first incomplete row."""
    first = missing_columns(df, row).agg(F.min(F.struct(row, "missing_column")).alias("m")).first()
    if first["m"] is not None:
        number, name = first["m"]
        raise ValueError(f"row {number} is missing required column '{name}'")
    return df


def numbered_questions(benchmark: DataFrame, order: str = "item_id", text: str = "text") -> DataFrame:
    """``(q, question)`` with ``q`` counting from 1 in ``order``."""
    numbered = number_rows(benchmark, order, "q")
    return numbered.select("q", F.col(text).alias("question"))


def scan_results(spark: SparkSession, path: str, schema: str = schemas.CLOSED_RESULT) -> DataFrame:
    """Earlier results, as JSON lines or JSON arrays; no rows when there are none yet."""
    if not _matches(spark, path):
        return spark.createDataFrame([], schema)
    # Each file tells its own form: an array begins with a bracket, lines with an object.
    lines = spark.read.text(path).where(not_blank("value")).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        F.startswith(F.ltrim("value"), F.lit("[")).alias("opens"),
    )
    first = lines.groupBy("file").agg(F.min_by("opens", "at").alias("is_array"))
    forms = {r.is_array: r.files for r in
             first.groupBy("is_array").agg(F.collect_list("file").alias("files")).collect()}
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    parts = [
        reader.option("multiLine", is_array).json(files) for is_array, files in sorted(forms.items())
    ]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def scan_loss_log(spark: SparkSession, path: str) -> DataFrame:
    return scan_results(spark, path, schemas.LOSS)
