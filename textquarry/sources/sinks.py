"""Writers. Non-ASCII text is kept; a job writes once instead of rewriting per row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pairs(pairs: DataFrame, path: str, resume: bool = False) -> None:
    """JSON lines; appended to earlier output when resuming."""
    columns = ["question", "answer", "source", "jurisdiction", "type"]
    pairs.select(*columns).write.mode("append" if resume else "overwrite").json(path)


def write_results(results: DataFrame, path: str, by: str | Sequence[str] | None = None) -> None:
    """JSON lines, in one folder per value of ``by`` (a model label, a round, or both) when given.

    Without ``by`` earlier results go. With it only the folders that the new rows fall in are
    replaced, so the run of one label and round leaves all others as they are.
    """
    writer = results.write.mode("overwrite")
    if by:
        keys = [by] if isinstance(by, str) else list(by)
        writer = writer.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def write_array(rows: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """JSON arrays of the rows as objects: each file is one, and in name order they follow ``order``.

    With ``files=1`` the whole is one array, written by one task; a large table is better left to
    several. No rows give one empty array. A file is a single line, so that readers of JSON lines
    find the same rows.
    """
    parts = [files, *order] if files else list(order)
    sorted_rows = rows.repartitionByRange(*parts).sortWithinPartitions(*order)
    whole = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    objects = sorted_rows.select(whole.alias("value"))
    arrays = objects.mapInArrow(_as_array, "value string")
    if rows.isEmpty():
        arrays = rows.sparkSession.range(0, 1, 1, 1).select(F.lit("[]").alias("value"))
    arrays.write.mode("overwrite").text(path, lineSep=" ")


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of a task with the brackets and commas that make them one array."""
    opened = False
    for batch in batches:
        if batch.num_rows:
            values = batch["value"].to_pylist()
            # A comma goes before its object, so none need know whether it is the last.
            marks = ["," if opened else "[", *[","] * (len(values) - 1)]
            lines = [mark + value for mark, value in zip(marks, values, strict=True)]
            opened = True
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    if opened:
        yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])


def write_report(report: DataFrame, path: str, position: str = "pos") -> None:
    """Text files whose concatenation in name order is the report."""
    report.orderBy(position).select("text").write.mode("overwrite").text(path)


def write_round_log(records: DataFrame, path: str, files: int | None = 1) -> None:
    """Nested round records as a JSON array, in order of run and round."""
    write_array(records, path, ["run_id", "round"], files)
