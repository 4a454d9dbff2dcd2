"""Repeated runs of lines, by suffix ranks of line sequences.

A document is the sequence of its lines that hold words. Prefix doubling ranks every suffix of every
sequence by its first 1, 2, 4, ... lines; suffixes whose prefix is unique drop out, so each round
works on what is still repeated. Suffixes that share their first L lines form the
longest-common-prefix interval of depth L: two overlapping ranks of the largest power of two up to
L name it. The earliest member of an interval is the original, the others are later copies.

A run counts from ``min_words`` words on. Every repeated run of that length is the union of the
shortest such runs inside it, those that begin at one of its lines and those that end at one, so
intervals need only be formed at those depths, none of which exceeds ``min_words`` lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.arrow_text import Chunk, chunks
from textquarry.llm.shingles import hashes, word_spans
from textquarry.llm.tables import Scratch, free_name, query, table

MIN_WORDS = 50
_SALT = np.random.default_rng(11).permutation(256).astype(np.uint8)


def _line_rows(chunk: Chunk, min_words: int) -> dict[str, np.ndarray]:
    """Lines that hold words: text, pos (line of the text), i, two hashes, and how many lines the
    shortest run of ``min_words`` words has that begins (ahead) or ends (back) here, 0 for none."""
    data = chunk.data
    if not len(data):
        return {k: np.zeros(0, np.int64) for k in ("text", "pos", "i", "h1", "h2", "ahead", "back")}
    begin, _ = word_spans(chunk)
    cuts = np.flatnonzero(data == 10) + 1
    first = np.concatenate([chunk.starts, cuts])
    first = np.unique(first[first < len(data)])
    last = np.append(first[1:], len(data))
    text = np.searchsorted(chunk.ends, first, side="right")
    last = np.where(data[last - 1] == 10, last - 1, last)
    pos = np.arange(len(first)) - np.searchsorted(text, text)
    n = np.diff(np.searchsorted(begin, np.append(first, len(data))))
    held = np.flatnonzero(n > 0)
    text, pos, n, first, last = text[held], pos[held], n[held], first[held], last[held]
    start = np.searchsorted(text, text)
    i = np.arange(len(text)) - start
    stop = np.searchsorted(text, text, side="right")
    until = np.cumsum(n)
    before = until - n
    to = np.searchsorted(until, before + min_words)  # last line of the run that begins here
    since = np.searchsorted(before, until - min_words, side="right") - 1
    here = np.arange(len(text))
    return {
        "text": text,
        "pos": pos,
        "i": i,
        "h1": hashes(data, first, last).view(np.int64),
        "h2": hashes(_SALT[data], first, last).view(np.int64),
        "ahead": np.where(to < stop, to - here + 1, 0),
        "back": np.where(since >= start, here - since + 1, 0),
    }


def _lines(min_words: int):
    names = ["pos", "i", "h1", "h2", "ahead", "back"]

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch["text"]):
                rows = _line_rows(chunk, min_words)
                at = pa.array(rows["text"] + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(at),
                        batch["d"].take(at),
                        *[pa.array(rows[c].astype(np.int64)) for c in names],
                    ],
                    names=["doc_id", "d", *names],
                )

    return run


def _ranked(keys: DataFrame, *columns: str) -> DataFrame:
    """``keys`` with a rank that follows their order; gaps do no harm."""
    ordered = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return ordered.withColumn("rank", F.monotonically_increasing_id())


def _document(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col].isNull(), docs[id_col], docs[text_col])


def later_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """(d, pos): the lines, by hash of their document and place in it, that repeat earlier ones."""
    spark = docs.sparkSession
    write = Scratch(spark, "lines").write
    id_type = docs.schema[id_col].dataType.simpleString()
    lines = write(
        docs.select(
            docs[id_col].alias("doc_id"),
            docs[text_col].alias("text"),
            _document(docs, id_col, text_col).alias("d"),
        ).mapInArrow(
            _lines(min_words),
            f"doc_id {id_type}, d long, pos long, i long, h1 long, h2 long, ahead long, back long",
        ),
        "all",
    )
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    names = write(_ranked(twice, "h1", "h2"), "names")
    # Rows that repeat a document give its lines again: once is enough.
    now = write(lines.join(names, ["h1", "h2"]).drop("h1", "h2").distinct(), "ranks-0")
    runs = now.select("doc_id", "d", F.col("i").alias("s"), F.col("ahead").alias("size")).union(
        now.select("doc_id", "d", (F.col("i") - F.col("back") + 1).alias("s"), F.col("back"))
    )
    runs = write(runs.where("size > 0").distinct(), "runs")
    longest = runs.agg(F.max("size")).first()[0] or 0
    copies = None
    where = now.select("d", "i", "pos")
    half = 1
    while half <= longest:
        # Intervals of depths half up to 2 * half - 1.
        ranks = now.select("d", "i", "rank")
        own = runs.where(F.col("size").between(half, 2 * half - 1))
        head = ranks.select("d", F.col("i").alias("s"), F.col("rank").alias("a"))
        tail = ranks.select("d", F.col("i").alias("t"), F.col("rank").alias("b"))
        named = own.join(head, ["d", "s"]).withColumn("t", F.col("s") + F.col("size") - half)
        named = write(named.join(tail, ["d", "t"]), f"runs-{half}")
        at = F.struct(F.col("doc_id").isNull(), "doc_id", "d", "s")
        interval = ["size", "a", "b"]
        spread = named.groupBy(*interval).agg(F.count("*").alias("n"), F.min(at).alias("original"))
        later = named.join(spread.where("n > 1"), interval).where(at > F.col("original"))
        later = later.select("d", "s", "size")
        copies = later if copies is None else copies.union(later)

        pair = ranks.join(
            ranks.select("d", (F.col("i") - half).alias("i"), F.col("rank").alias("next")),
            ["d", "i"],
        )
        pair = write(pair, f"pairs-{half}")
        twice = pair.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        twice = twice.select(F.col("rank").alias("a"), F.col("next").alias("b"))
        names = write(_ranked(twice, "a", "b"), f"names-{half}")
        now = pair.join(
            names, (pair["rank"] == names["a"]) & (pair["next"] == names["b"])
        ).select("d", "i", names["rank"])
        half *= 2
        now = write(now, f"ranks-{half}")
    if copies is None:
        return where.select("d", "pos").limit(0)
    gone = copies.select("d", F.explode(F.expr("sequence(s, s + size - 1)")).alias("i")).distinct()
    return gone.join(where, ["d", "i"]).select("d", "pos")


def without_later_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with the lines of later copies gone, and columns n_lines and n_removed.

    A run of lines of at least ``min_words`` words in all that stands earlier, in order of id, or
    in the same document, goes; lines without words stay and do not interrupt a run. n_lines counts
    the lines that hold words. A text that keeps no word becomes empty. Null and empty texts stay
    as they are. Documents without an id come last. Rows that repeat an id and its text are one
    document and change alike. All other columns stay, but for any named n_lines or n_removed.
    """
    gone = later_copies(docs, id_col, text_col, min_words)
    docs = docs.drop("n_lines", "n_removed")
    key, list_col = free_name(docs, "document_key"), free_name(docs, "gone_lines")
    gone = gone.groupBy(F.col("d").alias(key)).agg(F.collect_list("pos").alias(list_col))
    keyed = docs.withColumn(key, _document(docs, id_col, text_col))
    both = keyed.join(gone, key, "left").drop(key)

    def cut(batches):
        for batch in batches:
            texts, totals, removed = [], [], []
            for text, gone in zip(batch[text_col], batch[list_col].to_pylist(), strict=True):
                text = text.as_py()
                lines = (text or "").split("\n")
                held = [bool(line.strip(" \t\n\v\f\r")) for line in lines]
                totals.append(sum(held))
                removed.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    kept = [k for k in range(len(lines)) if k not in out]
                    text = "\n".join(lines[k] for k in kept) if any(held[k] for k in kept) else ""
                texts.append(text)
            columns = {n: batch[n] for n in batch.schema.names if n != list_col}
            columns[text_col] = pa.array(texts, batch.schema.field(text_col).type)
            columns |= {"n_lines": pa.array(totals, pa.int64())}
            columns |= {"n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = both.drop(list_col).schema.add("n_lines", "long").add("n_removed", "long")
    return both.mapInArrow(cut, schema)


ORACLE = rf"""
    WITH lines AS (
        SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    ), held AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i,
               sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS cum
        FROM lines WHERE w > 0
    ), runs AS (
        SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM held a JOIN held b
        ON a.doc_id = b.doc_id AND b.i >= a.i AND b.cum - a.cum + a.w >= {MIN_WORDS}
        GROUP BY ALL
        UNION
        SELECT a.doc_id, max(b.i), a.i FROM held a JOIN held b
        ON a.doc_id = b.doc_id AND b.i <= a.i AND a.cum - b.cum + b.w >= {MIN_WORDS}
        GROUP BY a.doc_id, a.i
    ), named AS (
        SELECT r.doc_id, r.s, r.e, string_agg(h.line, chr(10) ORDER BY h.i) AS body
        FROM runs r JOIN held h ON h.doc_id = r.doc_id AND h.i BETWEEN r.s AND r.e
        GROUP BY ALL
    ), later AS (
        SELECT doc_id, s, e FROM named
        QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, s) > 1
    ), gone AS (
        SELECT DISTINCT h.doc_id, h.pos FROM held h JOIN later l
        ON h.doc_id = l.doc_id AND h.i BETWEEN l.s AND l.e
    )
    SELECT d.doc_id, count(*) FILTER (w > 0) AS n_lines,
           count(g.pos) AS n_removed,
           CASE WHEN count(g.pos) = 0 THEN any_value(d.text)
                WHEN count(*) FILTER (w > 0) = count(g.pos) THEN ''
                ELSE string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) END AS text
    FROM documents d JOIN lines l USING (doc_id)
    LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
    GROUP BY d.doc_id
"""


@query("op1_line_dedup", ORACLE)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_later_copies(docs)
