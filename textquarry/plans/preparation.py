"""Cleaning, templates, text functions, samples and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import prompts, templates, text, tokens
from textquarry.functions.tokenizers import Ids
from textquarry.functions.tokens import EOS
from textquarry.operators import chat, prepare
from textquarry.operators.rounds import fit_budget
from textquarry.operators.sampling import nth_rows, seeded_sample
from textquarry.plans.registry import (
    corpus,
    dialogue,
    query,
    sql_render,
    sql_strip,
    sql_tokens,
    sql_words,
    table,
)
from textquarry.sources.evalsets import numbered_questions
from textquarry.sources.tiers import TIERS

SHORTEST, CHUNK_WORDS = 50, 800


def _padded(column: str = "text") -> Column:
    return F.concat(F.lit(" \n\t"), column, F.lit("\x0b \r\n"))


SQL_PADDED = "' ' || chr(10) || chr(9) || text || chr(11) || ' ' || chr(13) || chr(10)"


def sql_truncated(expression: str, n: int) -> str:
    words = sql_words(expression)
    return (
        f"CASE WHEN len({words}) <= {n} THEN {expression} "
        f"ELSE array_to_string(({words})[1:{n}], ' ') || '…' END"
    )


# -- filters and projections


@query(
    "p_min_words",
    f"SELECT doc_id, text FROM documents WHERE len({sql_words('text')}) >= {SHORTEST}",
)
def min_words(spark, sf_dir) -> DataFrame:
    return prepare.min_words(corpus(spark, sf_dir), SHORTEST).select("doc_id", "text")


@query(
    "p_defaults",
    """SELECT doc_id, source AS citation,
              CASE WHEN lang = 'fr' THEN 'Unknown' ELSE lang END AS jurisdiction,
              'Unknown' AS type
       FROM documents""",
)
def defaults(spark, sf_dir) -> DataFrame:
    docs = corpus(spark, sf_dir).withColumn(
        "jurisdiction", F.nullif(F.col("jurisdiction"), F.lit("fr"))
    )
    return prepare.with_defaults(docs).drop("text")


@query(
    "p_clean_eos",
    f"""WITH c AS (
            SELECT doc_id, {sql_strip("text")} || '{EOS}' AS text
            FROM documents WHERE {sql_strip("text")} <> '')
        SELECT doc_id, text FROM c WHERE length(text) > 10""",
)
def clean_eos(spark, sf_dir) -> DataFrame:
    """Every text padded, and beside each one a blank row that must go."""
    docs = corpus(spark, sf_dir)
    texts = docs.select("doc_id", _padded().alias("text"))
    blank = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(" \n ").alias("text"))
    return prepare.clean_eos(texts.unionByName(blank))


@query("p_start_row", "SELECT doc_id + 1 AS row, text FROM documents WHERE doc_id + 1 >= 10")
def start_row(spark, sf_dir) -> DataFrame:
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    return prepare.from_start_row(docs, 10, "doc_id").select("row", "text")


@query(
    "p_skip_estimate",
    """SELECT doc_id, text FROM
           (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n FROM documents)
       WHERE n > (SELECT count(*) // 3 FROM labels)""",
)
def skip_estimate(spark, sf_dir) -> DataFrame:
    existing = table(spark, sf_dir, "labels").agg(F.count("*")).scalar()
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    return prepare.skip_answered_estimate(docs, existing, 3, "doc_id")


SQL_TIERS = ", ".join(
    f"('{tier}', {t['max_seq_length']}, {t['token_truncation_length']}, 200)"
    for tier, t in TIERS.items()
)


def _sql_document(citation: str, jurisdiction: str, kind: str) -> str:
    return sql_render(
        templates.TRAINING_DOCUMENT,
        citation=citation,
        jurisdiction=jurisdiction,
        type=kind,
        text="text",
    )


@query(
    "p_tier_prepare",
    f"""WITH t(tier, max_seq_length, token_truncation_length, max_steps) AS (VALUES {SQL_TIERS}),
        d AS (SELECT doc_id, list_append({sql_tokens(
            "(" + _sql_document("source", "lang", "'Unknown Type'") + ")")}, '{EOS}') AS tokens
            FROM documents)
        SELECT doc_id, tier, max_seq_length, max_steps,
               array_to_string(tokens[1:token_truncation_length], '') AS text
        FROM d, t""",
)
def tier_prepare(spark, sf_dir) -> DataFrame:
    cut = prepare.training_documents_by_tier(corpus(spark, sf_dir), overrides={"max_steps": 200})
    return cut.select("doc_id", "tier", "max_seq_length", "max_steps", "text")


@query("m_decode_ids", f"SELECT doc_id, text || '{EOS}' AS text FROM documents")
def decode_ids(spark, sf_dir) -> DataFrame:
    """Texts to ids of a byte-level vocabulary, closed, and back."""
    import public_tokenizers

    path = public_tokenizers.path
    ids = Ids(path("byte_bpe_50k.json"), 50256, ranks=path("byte_bpe_50k.tiktoken"))
    encoded = corpus(spark, sf_dir).select("doc_id", ids.encode_document("text").alias("ids"))
    return encoded.select("doc_id", ids.decode("ids").alias("text"))


@query(
    "m_truncate_tokens",
    f"""SELECT doc_id,
               array_to_string(list_append({sql_tokens("text")}, '{EOS}')[1:500], '') AS text
        FROM documents""",
)
def truncate_tokens(spark, sf_dir) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", tokens.truncate("text", 500).alias("text"))


# -- templates


@query(
    "c_qa_generation",
    f"""SELECT doc_id, {sql_render(
            templates.QA_GENERATION, n="'3'", text=sql_truncated("text", CHUNK_WORDS))} AS prompt
        FROM documents WHERE len({sql_words("text")}) >= {SHORTEST}""",
)
def qa_generation(spark, sf_dir) -> DataFrame:
    ready = prepare.qa_prompts(corpus(spark, sf_dir), CHUNK_WORDS, 3, SHORTEST)
    return ready.select("doc_id", "prompt")


SQL_ASK = "'What does document ' || doc_id || ' say?'"


def _ask() -> Column:
    return F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?"))


@query(
    "c_sft_qa",
    f"""SELECT doc_id, {sql_render(templates.TRAINING_QA, question=SQL_ASK, answer="text")}
               || '{EOS}' AS text FROM documents""",
)
def sft_qa(spark, sf_dir) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select(
        "doc_id", _ask().alias("question"), F.col("text").alias("answer")
    )
    return prepare.training_pairs(pairs).select("doc_id", "text")


@query(
    "c_doc_completion",
    f"""SELECT doc_id, {_sql_document("source", "lang", "'Unknown Type'")} || '{EOS}' AS text
        FROM documents""",
)
def doc_completion(spark, sf_dir) -> DataFrame:
    docs = prepare.with_defaults(corpus(spark, sf_dir), prepare.TRAINING_UNKNOWN)
    body = prompts.training_document("citation", "jurisdiction", "type", "text")
    return docs.select("doc_id", F.concat(body, F.lit(EOS)).alias("text"))


@query(
    "c_closed_book",
    f"""SELECT row_number() OVER (ORDER BY item_id) AS q,
               {sql_render(templates.CLOSED_BOOK, question="text")} AS prompt FROM benchmark""",
)
def closed_book(spark, sf_dir) -> DataFrame:
    questions = numbered_questions(table(spark, sf_dir, "benchmark"))
    return questions.select("q", prompts.closed_book("question").alias("prompt"))


@query(
    "c_open_book",
    f"""SELECT doc_id, {sql_render(
            templates.OPEN_BOOK, question=SQL_ASK, context=sql_strip("text"))} AS prompt
        FROM documents""",
)
def open_book(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", prompts.open_book(_ask(), _padded()).alias("prompt"))


@query(
    "c_short",
    f"""SELECT item_id, {sql_render(templates.SHORT, question="text")} AS prompt FROM benchmark""",
)
def short(spark, sf_dir) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return benchmark.select("item_id", prompts.short("text").alias("prompt"))


# -- text functions


@query("x_strip", f"SELECT doc_id, {sql_strip(SQL_PADDED)} AS stripped FROM documents")
def strip(spark, sf_dir) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", text.strip(_padded()).alias("stripped"))


@query(
    "x_word_count",
    f"SELECT doc_id, len({sql_words('text')}) AS n_words FROM documents",
)
def word_count(spark, sf_dir) -> DataFrame:
    counted = text.word_count(_padded()).cast("bigint").alias("n_words")
    return corpus(spark, sf_dir).select("doc_id", counted)


@query(
    "x_truncate_words",
    f"SELECT doc_id, {sql_truncated('text', CHUNK_WORDS)} AS text FROM documents",
)
def truncate_words(spark, sf_dir) -> DataFrame:
    cut = text.truncate_words("text", CHUNK_WORDS).alias("text")
    return corpus(spark, sf_dir).select("doc_id", cut)


@query(
    "x_preview",
    """SELECT doc_id,
              left(text, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS preview,
              replace(left(text, 300), chr(10), ' ') AS one_line
       FROM documents""",
)
def preview(spark, sf_dir) -> DataFrame:
    return corpus(spark, sf_dir).select(
        "doc_id", text.preview("text").alias("preview"), text.one_line("text").alias("one_line")
    )


def _answer_lines() -> Column:
    """Every other line of the document read as an answer line."""
    return F.concat(F.lit("A: "), F.replace("text", F.lit(".\n"), F.lit(".\nA: ")))


SQL_ANSWER_LINES = "'A: ' || replace(text, '.' || chr(10), '.' || chr(10) || 'A: ')"


def _sql_cut_lines(expression: str, n: int) -> str:
    return (
        f"array_to_string(list_transform(string_split({expression}, chr(10)), lambda l: "
        f"CASE WHEN starts_with(l, 'A: ') AND length(l) > {n} THEN left(l, {n}) || '…' ELSE l END"
        "), chr(10))"
    )


@query(
    "x_truncate_answer_lines",
    f"SELECT doc_id, {_sql_cut_lines(SQL_ANSWER_LINES, 200)} AS text FROM documents",
)
def truncate_answer_lines(spark, sf_dir) -> DataFrame:
    cut = text.truncate_answer_lines(_answer_lines(), 200).alias("text")
    return corpus(spark, sf_dir).select("doc_id", cut)


BUDGET = 2_000


@query(
    "x_fit_budget",
    f"""WITH v AS (
            SELECT doc_id, {SQL_ANSWER_LINES} AS t0, {_sql_cut_lines(SQL_ANSWER_LINES, 500)} AS t1,
                   {_sql_cut_lines(SQL_ANSWER_LINES, 200)} AS t2,
                   {_sql_cut_lines(SQL_ANSWER_LINES, 100)} AS t3
            FROM documents)
        SELECT doc_id, 0 AS pos,
               CASE WHEN length(t0) <= {BUDGET} THEN 0 WHEN length(t1) <= {BUDGET} THEN 500
                    WHEN length(t2) <= {BUDGET} THEN 200 WHEN length(t3) <= {BUDGET} THEN 100
                    ELSE -1 END AS answer_limit,
               length(t3) <= {BUDGET} AS fits,
               CASE WHEN length(t0) <= {BUDGET} THEN t0 WHEN length(t1) <= {BUDGET} THEN t1
                    WHEN length(t2) <= {BUDGET} THEN t2 WHEN length(t3) <= {BUDGET} THEN t3
                    ELSE '' END AS text
        FROM v""",
)
def budget(spark, sf_dir) -> DataFrame:
    texts = corpus(spark, sf_dir).select(
        "doc_id", F.lit(0).alias("pos"), _answer_lines().alias("text")
    )
    fitted = fit_budget(texts, ["doc_id"], BUDGET)
    limit = F.when(F.col("fits"), F.coalesce("answer_limit", F.lit(0))).otherwise(-1)
    return fitted.withColumn("answer_limit", limit).fillna("", ["text"])


# -- samples and unions


@query(
    "o_seeded_sample",
    """SELECT doc_id, text FROM documents
       ORDER BY md5('42:' || doc_id), doc_id LIMIT 150""",
)
def sample(spark, sf_dir) -> DataFrame:
    return seeded_sample(corpus(spark, sf_dir), 150, seed=42).select("doc_id", "text")


@query(
    "o_every_fifth",
    """SELECT q, text FROM
           (SELECT row_number() OVER (ORDER BY doc_id) AS q, text FROM documents)
       WHERE (q - 1) % 5 = 0""",
)
def every_fifth(spark, sf_dir) -> DataFrame:
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    return nth_rows(docs, "doc_id", "q", 5).select("q", "text")


@query(
    "u_union_parts",
    "SELECT text FROM documents UNION ALL SELECT html AS text FROM pages",
)
def union_parts(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    return prepare.concatenate(corpus(spark, sf_dir).select("text"), pages)


@query(
    "u_append_exchange",
    """WITH c AS (SELECT * FROM conversations WHERE role <> 'system'),
            e AS (SELECT conv_id, max(turn) AS last, min_by(text, turn) AS question FROM c
                  GROUP BY conv_id)
       SELECT conv_id, turn, role, text FROM c
       UNION ALL SELECT conv_id, last + 1, 'user', question FROM e
       UNION ALL SELECT conv_id, last + 2, 'assistant', 'See above.' FROM e""",
)
def append_exchange(spark, sf_dir) -> DataFrame:
    messages = dialogue(spark, sf_dir)
    exchanges = messages.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("question"), F.lit("See above.").alias("reply")
    )
    return chat.append_exchange(messages, exchanges)
