"""Readers: data derived from the tables is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry import schemas
from textquarry.functions.tokens import EOS
from textquarry.operators.ordered import ordered_list, whole_quotient
from textquarry.operators.packing import pack_stats
from textquarry.operators.prepare import concatenate, with_defaults
from textquarry.operators.rounds import first_last_loss
from textquarry.plans.experiments import SQL_LOSSES, loss_table
from textquarry.plans.jobs import raw_corpus, raw_corpus_set
from textquarry.plans.registry import corpus, query, sql_strip, sql_tokens, table
from textquarry.session import hadoop, stage, staging_path
from textquarry.sources import corpus as readers
from textquarry.sources import evalsets, sinks
from textquarry.sources.tiers import PACKED_LENGTH

DOCS_PER_FILE = 100


def _file_number() -> Column:
    return whole_quotient(F.col("doc_id"), DOCS_PER_FILE).alias("file_no")


def _question() -> Column:
    return F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?"))


SQL_QUESTION = "'What does document ' || doc_id || ' say?'"


@query(
    "s_corpus_scan",
    """SELECT text, source AS citation, lang AS jurisdiction, 'Unknown' AS type FROM documents""",
)
def corpus_scan(spark, sf_dir) -> DataFrame:
    path = staging_path(spark, "corpus")
    corpus(spark, sf_dir).write.json(path)
    return with_defaults(readers.scan_corpus(spark, path))


@query(
    "s_dir_scan",
    f"""SELECT text FROM documents
        UNION ALL
        SELECT {sql_strip("string_agg(text, chr(10) ORDER BY doc_id)")} AS text
        FROM documents GROUP BY doc_id // {DOCS_PER_FILE}""",
)
def directory_scan(spark, sf_dir) -> DataFrame:
    docs = corpus(spark, sf_dir)
    lines, files = staging_path(spark, "jsonl"), staging_path(spark, "txt")
    docs.select("text").write.json(lines)
    content = F.array_join(ordered_list(F.col("text"), "doc_id"), "\n").alias("value")
    docs.groupBy(_file_number()).agg(content).write.partitionBy("file_no").text(files)
    return concatenate(
        readers.scan_jsonl_texts(spark, lines, "*.json"),
        readers.scan_text_files(spark, f"{files}/file_no=*"),
    )


@query(
    "s_latest_snapshot",
    """SELECT doc_id, text, CAST(substr(source, 4) AS INTEGER) AS version FROM documents
       WHERE CAST(substr(source, 4) AS INTEGER) =
             (SELECT max(CAST(substr(source, 4) AS INTEGER)) FROM documents)""",
)
def latest_snapshot(spark, sf_dir) -> DataFrame:
    """Documents stored by version, of which only the newest folder is read."""
    path = staging_path(spark, "versions")
    version = F.substr("source", F.lit(4)).cast("int").alias("version")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", version)
    docs.write.partitionBy("version").parquet(path)
    return readers.latest_version(spark.read.parquet(path))


def snapshots(spark, sf_dir) -> str:
    """A folder per version of the documents, named by its number, each with ``corpus.jsonl``."""
    written, root = staging_path(spark, "snapshots"), staging_path(spark, "corpora")
    version = F.substr("source", F.lit(4)).cast("int").alias("version")
    docs = table(spark, sf_dir, "documents").select("text", version)
    docs.write.partitionBy("version").json(written)
    folders, fs = hadoop(spark, f"{written}/version=*")
    for status in fs.globStatus(folders):
        number = status.getPath().getName().split("=")[1]
        target, _ = hadoop(spark, f"{root}/{number}/corpus.jsonl")
        fs.mkdirs(target.getParent())
        fs.rename(status.getPath(), target)
    return root


SQL_NEWEST = """CAST(substr(source, 4) AS INTEGER) =
    (SELECT max(CAST(substr(source, 4) AS INTEGER)) FROM documents)"""


@query("s_snapshot_corpus", f"SELECT text FROM documents WHERE {SQL_NEWEST}")
def snapshot_corpus(spark, sf_dir) -> DataFrame:
    """JSON lines of the newest of the listed snapshot folders."""
    return raw_corpus(spark, versions=snapshots(spark, sf_dir))


RAW_LENGTH = PACKED_LENGTH["8gb"]


@query(
    "m_raw_corpus_stats",
    f"""WITH d AS (
            SELECT {sql_strip("text")} AS text FROM documents WHERE {SQL_NEWEST}),
        t AS (
            SELECT CAST(sum(len({sql_tokens("text")}) + 1) AS BIGINT) AS n
            FROM d WHERE text <> '' AND length(text || '{EOS}') > 10)
        SELECT (n + {RAW_LENGTH - 1}) // {RAW_LENGTH} AS chunks, n AS tokens,
               (n - 1) % {RAW_LENGTH} + 1 AS last_chunk_tokens FROM t""",
)
def raw_corpus_stats(spark, sf_dir) -> DataFrame:
    """The newest snapshot cleaned and packed as a whole job does it."""
    chunks, _ = raw_corpus_set(spark, versions=snapshots(spark, sf_dir))
    return pack_stats(chunks)


@query(
    "s_pairs_scan",
    f"""SELECT {SQL_QUESTION} AS question, text AS answer, source, lang AS jurisdiction,
               'Unknown' AS type FROM documents""",
)
def pairs_scan(spark, sf_dir) -> DataFrame:
    path = staging_path(spark, "pairs")
    docs = with_defaults(corpus(spark, sf_dir))
    pairs = docs.select(
        _question().alias("question"),
        F.col("text").alias("answer"),
        F.col("citation").alias("source"),
        "jurisdiction",
        "type",
    )
    sinks.write_pairs(pairs, path)
    return readers.preferred_source(spark, path, f"{path}-corpus")[1]


def _open_book(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", _question().alias("question"), F.col("text").alias("context")
    )


@query(
    "s_openbook_json",
    f"""SELECT doc_id % {DOCS_PER_FILE} + 1 AS row, {SQL_QUESTION} AS question, text AS context
        FROM documents""",
)
def open_book_json(spark, sf_dir) -> DataFrame:
    path = staging_path(spark, "openbook")
    item = F.to_json(F.struct("question", "context"))
    rows = F.array_join(ordered_list(item, "doc_id"), ",")
    files = _open_book(spark, sf_dir).groupBy(_file_number()).agg(
        F.concat(F.lit('{"rows": ['), rows, F.lit("]}")).alias("value")
    )
    files.write.partitionBy("file_no").text(path)
    return evalsets.scan_open_book_json(spark, f"{path}/file_no=*").drop("file")


def _csv_files(spark, sf_dir) -> str:
    """Files of so many documents each, in order."""
    path = staging_path(spark, "openbook")
    rows = _open_book(spark, sf_dir).withColumn("file_no", _file_number())
    rows = rows.repartition("file_no").sortWithinPartitions("file_no", "doc_id").drop("doc_id")
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    options = {"header": True, "escape": '"', "quoteAll": True, **whole}
    rows.write.options(**options).partitionBy("file_no").csv(path)
    return f"{path}/file_no=*"


SQL_CSV = f"""SELECT doc_id % {DOCS_PER_FILE} + 1 AS row, {SQL_QUESTION} AS question, text AS context
              FROM documents"""


@query("s_openbook_csv", SQL_CSV)
def open_book_csv(spark, sf_dir) -> DataFrame:
    return evalsets.scan_open_book_csv(spark, _csv_files(spark, sf_dir)).drop("file")


@query("s_csv_split", SQL_CSV)
def csv_split(spark, sf_dir) -> DataFrame:
    """The same files, none of them read whole by one task."""
    files = _csv_files(spark, sf_dir)
    return evalsets.scan_open_book_csv(spark, files, whole_below=0).drop("file")


@query(
    "s_array_split",
    f"""SELECT row_number() OVER (ORDER BY doc_id) AS row, {SQL_QUESTION} AS question,
               text AS context FROM documents""",
)
def array_split(spark, sf_dir) -> DataFrame:
    """Documents written as ordered arrays, no file of which is read whole by one task."""
    path = staging_path(spark, "arrays")
    sinks.write_array(_open_book(spark, sf_dir), path, ["doc_id"])
    rows = evalsets.scan_open_book_json(spark, path, whole_below=0)
    # Files follow each other by name. What was put together once is stored before it is counted.
    rows = stage(rows, "elements")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file").agg(F.max("row").alias("n"))
    # One row per file is broadcast.
    sizes = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = rows.join(F.broadcast(sizes), "file")
    return placed.select((F.col("before") + F.col("row")).alias("row"), "question", "context")


@query(
    "s_required_columns",
    """SELECT doc_id + 1 AS row,
              CASE WHEN lang = 'fr' THEN 'question' ELSE 'context' END AS missing_column
       FROM documents WHERE lang = 'fr' OR n_chars < 500""",
)
def required_columns(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        (F.col("doc_id") + 1).alias("row"),
        F.when(F.col("lang") != "fr", _question()).alias("question"),
        F.when(F.col("n_chars") >= 500, F.col("text")).alias("context"),
    )
    return evalsets.missing_columns(rows)


@query(
    "s_benchmark_numbered",
    "SELECT row_number() OVER (ORDER BY item_id) AS q, text AS question FROM benchmark",
)
def benchmark_numbered(spark, sf_dir) -> DataFrame:
    return evalsets.numbered_questions(table(spark, sf_dir, "benchmark"))


@query(
    "s_prior_results",
    f"SELECT doc_id + 1 AS q, {SQL_QUESTION} AS question, text AS answer FROM documents",
)
def prior_results(spark, sf_dir) -> DataFrame:
    path = staging_path(spark, "results")
    results = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("q"), _question().alias("question"), F.col("text").alias("answer"),
        F.col("lang").alias("model_label"),
    )
    sinks.write_results(results, path, by="model_label")
    return evalsets.scan_results(spark, f"{path}/model_label=*", schemas.CLOSED_RESULT)


@query(
    "s_loss_log",
    f"""WITH l AS ({SQL_LOSSES})
        SELECT round, min_by(loss, step) AS start_loss, max_by(loss, step) AS end_loss,
               count(*) AS n_losses
        FROM l GROUP BY round""",
)
def loss_log(spark, sf_dir) -> DataFrame:
    path = staging_path(spark, "losses")
    sinks.write_results(loss_table(spark, sf_dir).select("round", "step", "loss"), path, by="round")
    rounds = [
        evalsets.scan_loss_log(spark, f"{path}/round={n}").withColumn("round", F.lit(n).cast("bigint"))
        for n in range(1, 7)  # nothing was written for the sixth
    ]
    log = concatenate(*rounds).withColumn("run_id", F.lit(0))
    return first_last_loss(log).drop("run_id")


@query(
    "a_existing_count",
    f"""SELECT count(*) AS existing
        FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE {sql_strip("line")} <> ''""",
)
def existing_count(spark, sf_dir) -> DataFrame:
    path = staging_path(spark, "lines")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return readers.existing_lines(spark, path).agg(F.count("*").alias("existing"))
