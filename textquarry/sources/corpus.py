"""Corpus readers: JSON lines, directories of JSONL and TXT, newest snapshot, preferred source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry import schemas
from textquarry.functions.text import not_blank, strip
from textquarry.session import hadoop, stage


def scan_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return scan_json_lines(spark, path, schemas.CORPUS)


def scan_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return scan_json_lines(spark, path, schemas.PAIR)


def scan_jsonl_texts(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """``text`` of every matching file directly in ``path``."""
    reader = spark.read.schema(schemas.RAW_TEXT).option("mode", "FAILFAST")
    return reader.option("pathGlobFilter", glob).json(path)


def scan_text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One stripped document per matching file; broken UTF-8 is replaced, empty files dropped."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    texts = files.select(strip(F.call_function("make_valid_utf8", F.col("value"))).alias("text"))
    return texts.where(not_blank("text"))


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """JSONL and TXT files directly in ``path`` as one bag of texts."""
    jsonl = _matches(spark, f"{path}/*.jsonl")
    parts = []
    if jsonl:
        _require_text_field(spark, jsonl)
        parts.append(scan_jsonl_texts(spark, path))
    if _matches(spark, f"{path}/*.txt"):
        texts = scan_text_files(spark, path)
        if not texts.isEmpty():
            parts.append(texts)
    if not parts:
        raise FileNotFoundError(f"no usable .jsonl or .txt file in {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _require_text_field(spark: SparkSession, paths: list[str]) -> None:
    """Some line must carry the field; the search stops at the first that does."""
    lines = spark.read.text(paths)
    has_field = F.array_contains(F.json_object_keys("value"), "text")
    if lines.where(has_field).isEmpty():
        raise ValueError("the .jsonl files have no 'text' field")


def with_doc_ids(docs: DataFrame) -> DataFrame:
    """Add a unique bigint ``doc_id`` that grows in reading order, and fix it by writing once.

    Ids computed anew in each job could differ after a change of files or splits; later jobs read
    the stored ones.
    """
    return stage(docs.withColumn("doc_id", F.monotonically_increasing_id()), "corpus")


def latest_snapshot_path(spark: SparkSession, root: str, name: str = "corpus.jsonl") -> str | None:
    """File in the numerically highest all-digit directory that holds one, or None."""
    found = {}
    for path in _matches(spark, f"{root}/*/{name}"):
        version = path.rsplit("/", 2)[1]
        if version.isdecimal():
            found[int(version)] = path
    return found[max(found)] if found else None


def latest_version(df: DataFrame, version: str = "version") -> DataFrame:
    """Rows of the newest version; on a partition column only its files are read."""
    newest = df.agg(F.max(version))
    return df.where(F.col(version) == newest.scalar())


def preferred_source(spark: SparkSession, pairs_path: str, corpus_path: str) -> tuple[str, DataFrame]:
    """``("pairs", rows)`` when the pair file exists, else ``("corpus", rows)``."""
    if _matches(spark, pairs_path):
        return "pairs", scan_pairs(spark, pairs_path)
    return "corpus", scan_corpus(spark, corpus_path)


def existing_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines already written."""
    return spark.read.text(path).where(not_blank("value"))


def count_existing(spark: SparkSession, path: str) -> int:
    """How many there are, 0 when there is no output yet."""
    return existing_lines(spark, path).count() if _matches(spark, path) else 0


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    path, fs = hadoop(spark, pattern)
    return sorted(status.getPath().toString() for status in fs.globStatus(path) or [])
