import hashlib

import pytest
from pyspark.sql import functions as F

from textquarry.operators import sampling


def expected(n, size, seed):
    order = sorted(range(size), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return sorted(order[:n])


@pytest.mark.parametrize("n", [0, 1, 7, 500, 1_000, 5_000])
@pytest.mark.parametrize("digits", [1, 3])
def test_exact_size(spark, monkeypatch, n, digits):
    monkeypatch.setattr(sampling, "DIGITS", digits)
    docs = spark.range(1_000).withColumnRenamed("id", "doc_id").repartition(7)
    got = sorted(r.doc_id for r in sampling.seeded_sample(docs, n, seed=9).collect())
    assert got == expected(n, 1_000, 9)


def test_same_rows_for_any_partitioning(spark):
    docs = spark.range(300).withColumnRenamed("id", "doc_id")
    a, b = (
        {r.doc_id for r in sampling.seeded_sample(docs.repartition(p), 40).collect()}
        for p in (1, 11)
    )
    assert a == b


def test_every_nth(spark):
    df = spark.range(1, 13).withColumnRenamed("id", "q")
    assert [r.q for r in sampling.every_nth(df, "q", 5).orderBy("q").collect()] == [1, 6, 11]


def test_texts_are_not_shuffled(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    plan = sampling.seeded_sample(docs, 10)._jdf.queryExecution().optimizedPlan().toString()
    main = plan.split("scalar-subquery")[0]
    assert "Join" not in plan and "Aggregate" not in main and "Sort" not in main
