"""Parsing of model responses, joins on results, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.parsing import (
    SALVAGE_MARKER,
    exploded_pairs,
    extract_object,
    salvage_error,
    with_pairs,
)
from textquarry.functions.text import has_words
from textquarry.operators import evaluation, pairs, prepare
from textquarry.operators.ordered import whole_quotient
from textquarry.plans.registry import (
    SQL_QUESTIONS,
    SQL_SHEETS,
    answer_sheets,
    corpus,
    query,
    sql_strip,
    sql_words,
    table,
)
from textquarry.sources.evalsets import numbered_questions

# The forms responses take, in turn over the documents: bare array, fenced, inside prose, one object
# per line, marked plain text, text without a pair, only an error body with the output, no answer.
FORMS = ["array", "fenced", "prose", "objects", "marked", "none", "error", "failed"]
SQL_FORM = f"({FORMS})[doc_id % {len(FORMS)} + 1]"


def _answered(docs: DataFrame) -> DataFrame:
    """Documents with the response rendered from them, two pairs each, in every form."""
    forms = F.array(*[F.lit(name) for name in FORMS])
    form = F.get(forms, F.col("doc_id") % len(FORMS))
    q1 = F.concat(F.lit("What is said in "), "citation", F.lit("?"))
    q2 = F.lit("How long is it?")
    a2 = F.concat(F.length("text").cast("string"), F.lit(" units"))

    def pair(question: Column, answer: Column) -> Column:
        return F.to_json(F.struct(question.alias("question"), answer.alias("answer")))

    array = F.concat(
        F.lit("["), pair(q1, F.col("text")), F.lit(", "), pair(q2, a2), F.lit("]")
    )
    flat = F.translate("text", "{}", "")
    objects = F.concat(pair(q1, flat), F.lit("\n"), pair(q2, a2))
    marked = F.concat(
        F.lit("Q: "), q1, F.lit("\nA: "), F.translate("text", "aAqQ", ""),
        F.lit("\n\nQ: "), q2, F.lit("\nA: "), a2,
    )
    prose = F.concat(F.lit("Here are pairs:\n"), array, F.lit("\nThat is all."))
    fenced = F.concat(F.lit("```json\n"), array, F.lit("\n```"))
    none = F.translate("text", "aAqQ{}[]", "")
    response = (
        F.when(form == "array", array)
        .when(form == "fenced", fenced)
        .when(form == "prose", prose)
        .when(form == "objects", objects)
        .when(form == "marked", marked)
        .when(form == "none", none)
    )
    error = F.to_json(F.struct(F.concat(F.lit(SALVAGE_MARKER), array).alias("error")))
    return docs.withColumns({"response": response, "error_body": F.when(form == "error", error)})


def _ledger(docs: DataFrame) -> DataFrame:
    return _answered(docs).select("doc_id", "response", "error_body")


# The pairs each document must give, stated from the same columns without any parsing.
SQL_PAIRS = f"""
    WITH f AS (SELECT *, {SQL_FORM} AS form FROM documents)
    SELECT doc_id, pair_no, question, answer, source, lang, form FROM (
        SELECT doc_id, 0 AS pair_no, 'What is said in ' || source || '?' AS question, source, lang,
               {sql_strip("CASE form WHEN 'objects' THEN translate(text, '{}', '') "
                          "WHEN 'marked' THEN translate(text, 'aAqQ', '') ELSE text END")}
               AS answer, form
        FROM f
        UNION ALL
        SELECT doc_id, 1, 'How long is it?', source, lang, length(text) || ' units', form FROM f)
    WHERE form NOT IN ('none', 'failed')
"""


@query(
    "n_parse_pairs",
    f"SELECT doc_id, pair_no, question, answer FROM ({SQL_PAIRS})",
)
def parse_pairs(spark, sf_dir) -> DataFrame:
    parsed = with_pairs(pairs.responses(_ledger(corpus(spark, sf_dir))))
    return exploded_pairs(parsed, "doc_id").select("doc_id", "pair_no", "pair.*")


def _parsed(spark, sf_dir) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return pairs.parsed_documents(prepare.with_defaults(docs), _ledger(docs))


@query(
    "n_pairs_enriched",
    f"""SELECT doc_id, pair_no, question, answer, source, lang AS jurisdiction, 'Unknown' AS type
        FROM ({SQL_PAIRS})""",
)
def pairs_enriched(spark, sf_dir) -> DataFrame:
    return pairs.enriched_pairs(_parsed(spark, sf_dir))


@query(
    "n_parse_strategy_counts",
    f"""SELECT strategy, count(*) AS documents FROM
            (SELECT CASE {SQL_FORM} WHEN 'objects' THEN 2 WHEN 'marked' THEN 3
                    WHEN 'none' THEN 0 WHEN 'failed' THEN 0 ELSE 1 END AS strategy FROM documents)
        GROUP BY strategy""",
)
def strategy_counts(spark, sf_dir) -> DataFrame:
    return _parsed(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("documents"))


@query(
    "a_run_counters",
    f"""SELECT count(*) AS documents,
               (SELECT count(*) FROM ({SQL_PAIRS})) AS total_pairs,
               count(*) FILTER ({SQL_FORM} = 'failed') AS no_response,
               count(*) FILTER ({SQL_FORM} = 'none') AS unparsed,
               count(*) FILTER ({SQL_FORM} IN ('none', 'failed')) AS errors
        FROM documents""",
)
def run_counters(spark, sf_dir) -> DataFrame:
    return _parsed(spark, sf_dir).agg(*pairs.run_counters())


@query(
    "n_salvage_error",
    """SELECT doc_id, text AS salvaged FROM documents WHERE lang <> 'fr'
       UNION ALL SELECT doc_id, '' FROM documents WHERE lang = 'fr'""",
)
def salvage(spark, sf_dir) -> DataFrame:
    """English bodies carry the marker, German are plain text with it, French are empty, the rest
    have an error without it."""
    docs = corpus(spark, sf_dir)
    marked = F.concat(F.lit(SALVAGE_MARKER), "text")

    def body(error: Column) -> Column:
        return F.to_json(F.struct(error.alias("error")))

    lang = F.col("jurisdiction")
    error_body = (
        F.when(lang == "en", body(marked))
        .when(lang == "de", F.concat(F.lit("Error code: 400 - "), marked))
        .when(lang == "fr", body(F.lit("")))
        .otherwise(body(F.col("text")))
    )
    salvaged = F.coalesce(salvage_error(error_body), F.lit(""))
    return docs.select("doc_id", salvaged.alias("salvaged"))


@query(
    "n_extract_object",
    """SELECT event_id, CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN -1
                        ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
       FROM events""",
)
def extract(spark, sf_dir) -> DataFrame:
    """Fenced, inside prose or bare; error events break off and views repeat the object."""
    kind = F.col("event_type")
    response = (
        F.when(kind == "click", F.concat(F.lit(" ```json\n"), "props", F.lit("\n``` \n")))
        .when(kind == "purchase", F.concat(F.lit("I suggest "), "props", F.lit(" for now.")))
        .when(kind == "error", F.concat(F.lit("Sure: "), F.rtrim("props", F.lit("}"))))
        .when(kind == "view", F.concat("props", F.lit("\n"), "props"))
        .otherwise(F.col("props"))
    )
    found = F.try_element_at(extract_object(response), F.lit("k"))
    k = F.coalesce(F.try_variant_get(found, "$", "bigint"), F.lit(-1))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"))


# -- joins on results


@query(
    "j_resume_antijoin",
    """SELECT doc_id, text FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def resume(spark, sf_dir) -> DataFrame:
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    return pairs.unanswered(docs, table(spark, sf_dir, "labels"))


@query(
    "j_merge_results",
    """SELECT doc_id + 1 AS q, 'quality ' || quality AS answer FROM labels
       UNION ALL
       SELECT doc_id + 1, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def merge(spark, sf_dir) -> DataFrame:
    q = (F.col("doc_id") + 1).alias("q")
    old = table(spark, sf_dir, "documents").select(q, F.col("text").alias("answer"))
    new = table(spark, sf_dir, "labels").select(
        q, F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("answer")
    )
    return pairs.merge_results(old, new)


@query(
    "j_question_answer",
    f"""SELECT run_id, q, question, answer
        FROM ({SQL_SHEETS}) JOIN ({SQL_QUESTIONS}) USING (q)""",
)
def question_answer(spark, sf_dir) -> DataFrame:
    questions = numbered_questions(table(spark, sf_dir, "benchmark"))
    answers = answer_sheets(spark, sf_dir).drop("model")
    return evaluation.question_answers(questions, answers).select(
        "run_id", "q", "question", "answer"
    )


@query(
    "j_compare_models",
    f"""WITH a AS ({SQL_SHEETS})
        SELECT coalesce(b.run_id, t.run_id) AS run_id, coalesce(b.q, t.q) AS q,
               coalesce(b.answer, '-') AS base_answer, coalesce(t.answer, '-') AS finetuned_answer
        FROM (SELECT run_id // 2 AS run_id, q, answer FROM a WHERE run_id % 2 = 0) b
        FULL JOIN (SELECT run_id // 2 AS run_id, q, answer FROM a WHERE run_id % 2 = 1) t
        ON b.run_id = t.run_id AND b.q = t.q""",
)
def compare(spark, sf_dir) -> DataFrame:
    """Even sheets read as the base model's answers, odd ones as the fine-tuned model's."""
    sheets = answer_sheets(spark, sf_dir).withColumn("tuned", F.col("run_id") % 2)
    sheets = sheets.withColumn("run_id", whole_quotient(F.col("run_id"), 2))
    both = evaluation.compare_models(
        sheets.where("tuned = 0"), sheets.where("tuned = 1"), ["run_id", "q"]
    )
    return both.fillna("-", ["base_answer", "finetuned_answer"])


@query(
    "a_stage_counts",
    f"""SELECT 'loaded' AS stage, count(*) AS n FROM documents
        UNION ALL SELECT 'long enough', count(*) FROM documents
                  WHERE len({sql_words("text")}) >= 50
        UNION ALL SELECT 'pairs', count(*) FROM ({SQL_PAIRS})""",
)
def stage_counts(spark, sf_dir) -> DataFrame:
    """What a generation run loads, asks about and parses, counted while it is parsed once."""
    parsed = with_pairs(pairs.responses(_answered(corpus(spark, sf_dir))))
    stages = {
        "loaded": F.lit(True),
        "long enough": has_words("text", 50),
        "pairs": F.size("pairs"),
    }
    return prepare.stage_counts(parsed, stages)


@query(
    "a_progress",
    """WITH s AS (
           SELECT source, count(*) AS total, count(l.doc_id) AS done,
                  sum(n_chars) / 60000.0::DOUBLE AS minutes
           FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
       SELECT source, round((done - 1) / minutes, 6) AS docs_per_minute,
              CASE WHEN done > 1 THEN round((total - done) / ((done - 1) / minutes), 6) ELSE 0 END
                  AS minutes_left
       FROM s""",
)
def progress(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("labelled"))
    sources = docs.join(labels, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("total"),
        F.count("labelled").alias("done"),
        (F.sum("n_chars") / 60000.0).alias("minutes"),
    )
    numbers = pairs.progress("done", "total", F.lit(1), "minutes")
    rounded = [F.round(c, 6).alias(n) for c, n in zip(numbers, ("docs_per_minute", "minutes_left"))]
    return sources.select("source", *rounded)
