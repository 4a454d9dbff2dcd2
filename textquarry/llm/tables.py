"""Tables written once to the shared folder, and the registry of this package's queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from textquarry.session import hadoop, staging_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ROOT = str(Path(__file__).resolve().parents[2])
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffles go with the query that made them, not when the driver next collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # What a task hands to Python at a time: bytes, as rows may hold whole texts or sets.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings these operators rely on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    # Python workers import this package from where the driver found it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return spark


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Intermediate tables in the shared folder: what is read twice is written once.

    They survive lost executors, cut lineage, and go when the driver ends, on ``drop``, or on
    ``release`` once the results of the operators that wrote them are written themselves.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False):
        self.spark, self.name = spark, name
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        if not lasting:
            Scratch._open.append(self)

    @classmethod
    def forget(cls) -> None:
        """Let ``release`` pass over everything opened so far."""
        cls._open.clear()

    @classmethod
    def release(cls) -> None:
        """Delete all tables opened since ``forget``, but those of lasting ones."""
        for scratch in cls._open:
            for df, _ in list(scratch._paths.values()):
                scratch.drop(df)
        cls._open.clear()

    def write(self, df: DataFrame, step: str) -> DataFrame:
        path = staging_path(self.spark, f"{self.name}-{step}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def write_each(self, parts: Iterable[DataFrame], step: str) -> DataFrame:
        """One table of the rows of several, each written before the next is asked for."""
        path = staging_path(self.spark, f"{self.name}-{step}")
        schema = None
        for df in parts:
            df.write.mode("append").option("compression", "zstd").parquet(path)
            schema = df.schema
        out = self.spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        _, path = self._paths.pop(id(df))
        hadoop_path, fs = hadoop(self.spark, path)
        fs.delete(hadoop_path, True)
