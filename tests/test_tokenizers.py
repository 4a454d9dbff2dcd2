"""Token ids against the library, on the tier and packing paths; the raw-corpus job."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions.prompts import training_document
from textquarry.functions.tokenizers import Ids
from textquarry.operators.packing import pack_sequences
from textquarry.operators.prepare import training_documents, training_documents_by_tier
from textquarry.plans import jobs
from textquarry.sources.tiers import TIERS

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
END = 50256
TEXTS = ["Plain words, twice. Plain words.", "", None, "é中文 🙂 " * 300, "<|endoftext|> is text here",
         "a\n\n  b\t" * 900]


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def ids():
    return Ids(public_tokenizers.path("byte_bpe_50k.json"), END)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(docs, ids, library):
    got = docs.select("doc_id", ids.encode_document("text").alias("ids"))
    got = got.withColumn("text", ids.decode("ids")).collect()
    for r in got:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == [*encoded(library, text), END]
        assert r.text == text + "</s>"


def test_ranks_give_the_ids_of_the_library(spark, library):
    pytest.importorskip("tiktoken")
    path = public_tokenizers.path
    ranked = Ids(path("byte_bpe_50k.json"), END, ranks=path("byte_bpe_50k.tiktoken"))
    texts = [*TEXTS, " " * 1_200_000 + "x", "\n \t" * 5, "don't  stop\u00a0\u2028 12 345"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rows.select("doc_id", ranked.encode("text").alias("ids")).collect():
        assert r.ids == encoded(library, texts[r.doc_id])


def test_texts_are_cut_as_ids(docs, ids, library):
    for n in (1, 7, 100, 10_000):
        got = {r.doc_id: r.t for r in docs.select("doc_id", ids.truncate("text", n).alias("t")).collect()}
        for k, text in enumerate(TEXTS):
            own = [*encoded(library, text), END][:n]
            closed = own[-1] == END
            assert got[k] == library.decode(own[:-1] if closed else own) + "</s>" * closed


def test_tiers_take_the_tokenizer(docs, ids, library):
    rows = docs.withColumns({"citation": F.lit("c"), "jurisdiction": F.lit("j"), "type": F.lit("t")})
    full = {r.doc_id: r.t for r in rows.select(
        "doc_id", training_document("citation", "jurisdiction", "type", "text").alias("t")).collect()}
    for r in training_documents_by_tier(rows, tokenizer=ids).collect():
        own = [*encoded(library, full[r.doc_id]), END][: TIERS[r.tier]["token_truncation_length"]]
        closed = own[-1] == END
        assert r.text == library.decode(own[:-1] if closed else own) + "</s>" * closed
    one = training_documents(rows, 50, tokenizer=ids.truncate).collect()
    assert {r.text for r in one} == {
        library.decode((own := [*encoded(library, t), END][:50])[: len(own) - (own[-1] == END)])
        + "</s>" * (own[-1] == END) for t in full.values()
    }


def test_packing_takes_ids(docs, ids, library):
    chunks = pack_sequences(docs, 64, encode=ids.encode_document, stage_tokens=True, docs_per_block=2)
    got = chunks.orderBy("chunk_id").collect()
    stream = [i for text in TEXTS for i in [*encoded(library, text), END]]
    assert [i for c in got for i in c.tokens] == stream
    assert all(len(c.tokens) == 64 for c in got[:-1])


def snapshot(folder, name, texts):
    (folder / name).mkdir(parents=True)
    lines = [json.dumps({"text": t, "citation": "c"}) for t in texts]
    (folder / name / "corpus.jsonl").write_text("\n".join(lines))


def test_raw_corpus_job_reads_the_newest_snapshot(spark, tmp_path):
    snapshot(tmp_path, "2", ["an old text that is long enough"])
    snapshot(tmp_path, "10", ["  the new text, long enough ", "", "short", None, "another long new text"])
    (tmp_path / "11").mkdir()
    texts = jobs.raw_corpus(spark, versions=str(tmp_path))
    assert len(texts.inputFiles()) == 1 and "/10/corpus.jsonl" in texts.inputFiles()[0]
    chunks, counts = jobs.raw_corpus_set(spark, versions=str(tmp_path), length=4)
    packed = "".join("".join(c.tokens) for c in chunks.orderBy("chunk_id").collect())
    assert packed == "the new text, long enough</s>another long new text</s>"
    assert counts.get == {"loaded": 5, "cleaned": 2}


def test_raw_corpus_job_prefers_a_directory(spark, tmp_path):
    snapshot(tmp_path / "versions", "1", ["never read"])
    own = tmp_path / "own"
    own.mkdir()
    (own / "a.jsonl").write_text(json.dumps({"text": "from the lines file"}))
    (own / "b.txt").write_text(" from the text file\n")
    chunks, counts = jobs.raw_corpus_set(spark, str(own), str(tmp_path / "versions"), "16gb")
    (row,) = chunks.collect()
    assert sorted("".join(row.tokens).split("</s>")[:2]) == ["from the lines file", "from the text file"]
    assert counts.get == {"loaded": 2, "cleaned": 2}
    for given in ({}, {"versions": str(tmp_path / "none")}):
        with pytest.raises(FileNotFoundError):
            jobs.raw_corpus_set(spark, **given)
