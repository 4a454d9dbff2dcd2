import random

import pandas as pd
import pytest
from pyspark.sql.functions import pandas_udf

from textquarry.functions import tokens
from textquarry.operators.packing import pack_sequences, pack_stats


def make_docs(spark, seed=1, n=40):
    rng = random.Random(seed)
    docs = [(i * 3, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 2, 9, 70]))))
            for i in range(n)]
    return docs, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)


@pytest.mark.parametrize("length", [1, 7, 64, 100_000])
@pytest.mark.parametrize("block", [1, 10, 1_000])
def test_packing_keeps_every_token_in_order(spark, length, block):
    docs, df = make_docs(spark)
    chunks = pack_sequences(df, length, docs_per_block=block).orderBy("chunk_id").collect()
    stream = [t for c in chunks for t in c.tokens]
    assert "".join(stream) == "".join(text + tokens.EOS for _, text in docs)
    assert [c.chunk_id for c in chunks] == list(range(len(chunks)))
    assert all(len(c.tokens) == length for c in chunks[:-1])
    assert [c.n_tokens for c in chunks] == [len(c.tokens) for c in chunks]


def test_one_huge_document_and_empty_texts(spark):
    docs = [(0, ""), (1, " ".join(["x"] * 5_000)), (2, ""), (3, "end")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    chunks = pack_sequences(df, 16, docs_per_block=2).orderBy("chunk_id").collect()
    whole = "".join(t for c in chunks for t in c.tokens)
    assert whole == "".join(text + tokens.EOS for _, text in docs)


def test_drop_remainder_and_stats(spark):
    _, df = make_docs(spark)
    chunks = pack_sequences(df, 50)
    stats = pack_stats(chunks).first()
    assert stats.tokens == (stats.chunks - 1) * 50 + stats.last_chunk_tokens
    assert pack_sequences(df, 50, drop_remainder=True).count() == stats.tokens // 50


def test_plugged_tokenizer_with_staged_tokens(spark):
    @pandas_udf("array<int>")
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [len(w) for w in t.split()] + [-1])

    docs, df = make_docs(spark, n=12)
    chunks = pack_sequences(df, 8, encode=lengths, stage_tokens=True).orderBy("chunk_id").collect()
    want = [n for _, text in docs for n in [*map(len, text.split()), -1]]
    assert [t for c in chunks for t in c.tokens] == want


def test_only_border_slices_are_shuffled_twice(spark):
    _, df = make_docs(spark)
    chunks = pack_sequences(df, 64, docs_per_block=16)  # several blocks, so borders
    chunks.collect()
    # The final plan ends where the initial one of the whole query, not of a subquery, begins.
    plan = chunks._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(chunk_id") == 1
    assert "ReusedExchange [doc_id" in plan
