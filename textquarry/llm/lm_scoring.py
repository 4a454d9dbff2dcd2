"""Cross-entropy difference of documents under a target and a background bigram model.

Both models have one vocabulary (every word that all documents hold more than once, and one entry
for the words seen once), one order and one discount; only the documents they count differ. A
document's score is the mean over its tokens of target loss less background loss: below zero it reads
more like the target.

Counts cover all documents and stay distributed. The most frequent words have short numbers, and
their counts and the losses of the most frequent bigrams of two such words are sent to every task.
All other words keep their 64-bit hash, and what is counted of them is joined to the documents that
hold them. With it a document scores each bigram that is not sent as if it were its only occurrence,
which it mostly is; the others are corrected by a join. Which words are short affects speed, never the
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.arrow_text import chunks
from textquarry.llm.filters import FILTER_BITS, bits_of, has
from textquarry.llm.shingles import mixed, words
from textquarry.llm.tables import Scratch, query, table

SHORT = (1 << 16) - 3  # words with a two-byte number, at most
OTHER, LONG, START = 0, (1 << 16) - 2, (1 << 16) - 1  # LONG: the next of the row's long words
ENTRIES = 1 << 16  # that unigram losses are spread over, or as many as there are
_HIGH = np.uint64(1 << 63)  # long words are negative
DISCOUNT = 0.75
COMMON = 1 << 20  # bigrams whose losses are sent to every task
_CLASSES = 8  # frequency classes for each factor of two
_HELD = 4_000_000  # tokens a task counts at a time


def _uniques(seen: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``seen`` and the sums of their weights, one row for each value."""
    value, weight = np.concatenate(seen), np.concatenate(weights)
    order = np.argsort(value, kind="stable")
    value, weight = value[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return value[first], np.add.reduceat(weight, first)


def _word_counts(batches):
    """Task: (word, n) over the texts it holds."""
    seen, size = [], 0

    def emitted():
        value, n = _uniques(seen, [np.ones(len(s), np.int64) for s in seen])
        for at in range(0, len(value), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[part]), pa.array(n[part])], names=["word", "n"]
            )

    for batch in batches:
        for chunk in chunks(batch["text"]):
            word, _ = words(chunk)
            if len(word):
                seen.append((word | _HIGH).view(np.int64))
                size += len(word)
            if size > _HELD:
                yield from emitted()
                seen, size = [], 0
    if seen:
        yield from emitted()


def _most_frequent(counts: DataFrame, column: str, most: int) -> Column:
    """Condition on rows: of the highest frequency classes that together hold at most ``most`` rows."""
    level = F.floor(F.log2(column) * _CLASSES).cast("int")
    sizes = dict(counts.groupBy(level.alias("level")).agg(F.count("*")).collect())
    total, least = 0, 64 * _CLASSES
    for found in sorted(sizes, reverse=True):
        total += sizes[found]
        if total > most:
            break
        least = found
    return level >= least


def _parts(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    """A list array of runs of ``values`` that end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _tokens(short):
    """Task: the tokens of every text, as two-byte numbers, and its long words in order."""

    def run(batches):
        known = short.value
        for batch in batches:
            for chunk in chunks(batch["text"]):
                word, text = words(chunk)
                word = (word | _HIGH).view(np.int64)
                token = np.full(len(word), LONG, np.uint16)
                if len(known):
                    row = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    token = np.where(known[row] == word, row + 1, LONG).astype(np.uint16)
                cuts = np.searchsorted(text, np.arange(len(chunk.ends) + 1))
                long = token == LONG
                rows = batch.slice(chunk.first, len(chunk.ends))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"],
                        pa.array(
                            [
                                token[a:b].tobytes()
                                for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                            ],
                            pa.binary(),
                        ),
                        _parts(
                            word[long],
                            np.cumsum(np.bincount(text[long], minlength=len(chunk.ends))),
                            pa.int64(),
                        ),
                    ],
                    names=["doc_id", "tokens", "long"],
                )

    return run


def _settled(batches):
    """Task: the same tokens, where the words ``once`` are no long words but OTHER."""
    for batch in batches:
        tokens, long, ends = [], [np.zeros(0, np.int64)], []
        columns = (batch[c].to_numpy(zero_copy_only=False) for c in ("tokens", "long", "once"))
        for token, own, once in zip(*columns, strict=True):
            if once is not None and len(once):
                gone = np.isin(own, once)
                token = np.frombuffer(token, np.uint16).copy()
                token[np.flatnonzero(token == LONG)[gone]] = OTHER
                token, own = token.tobytes(), own[~gone]
            tokens.append(token)
            long.append(own)
            ends.append(len(own))
        yield pa.RecordBatch.from_arrays(
            [
                batch["row"],
                batch["doc_id"],
                batch["in_target"],
                pa.array(tokens, pa.binary()),
                _parts(np.concatenate(long), np.cumsum(ends), pa.int64()),
            ],
            names=["row", "doc_id", "in_target", "tokens", "long"],
        )


def _bigrams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every bigram of the rows of a batch: the word before, the word, and the row it is from."""
    raw = [np.frombuffer(t.as_buffer(), np.uint16).astype(np.int64) for t in batch["tokens"]]
    n = np.array([len(r) for r in raw], np.int64)
    token = np.concatenate([np.zeros(0, np.int64), *raw])
    token[token == LONG] = batch["long"].flatten().to_numpy()
    before = np.concatenate([[START], token[:-1]]) if len(token) else token
    before[(np.cumsum(n) - n)[n > 0]] = START
    return before, token, np.repeat(np.arange(len(n)), n)


def _flags(batch: pa.RecordBatch, row: np.ndarray) -> np.ndarray:
    """1 for each of ``row`` that is in the target, else 0."""
    return batch["in_target"].to_numpy(zero_copy_only=False).astype(np.int64)[row]


def _bigram_counts(batches):
    """Task: (before, token, n_target, n) over the tokens it holds."""

    def emitted(seen, long):
        value = n = n_target = np.zeros(0, np.int64)
        if seen:
            value, n = _uniques(seen, [np.ones(len(s), np.int64) for s in seen])
            n_target, value = np.where(value & 1, n, 0), value >> 1
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            value, n, n_target = value[first], *(np.add.reduceat(x, first) for x in (n, n_target))
        # Bigrams with a long word seldom repeat in a task.
        before = np.concatenate([value >> 16, *[b for b, _, _ in long]])
        token = np.concatenate([value & 0xFFFF, *[t for _, t, _ in long]])
        n_target = np.concatenate([n_target, *[f for _, _, f in long]])
        n = np.concatenate([n, np.ones(len(token) - len(n), np.int64)])
        for at in range(0, len(n), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[part]) for x in (before, token, n_target, n)],
                names=["before", "token", "n_target", "n"],
            )

    seen, long, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            before, token, row = _bigrams(some)
            flag = _flags(some, row)
            short = (before >= 0) & (token >= 0)
            if short.any():
                seen.append((before[short] << 17) | (token[short] << 1) | flag[short])
            long.append((before[~short], token[~short], flag[~short]))
            size += len(token)
            if size > _HELD:
                yield from emitted(seen, long)
                seen, long, size = [], [], 0
    yield from emitted(seen, long)


_OF_WORD = ("after", "kinds", "single")  # tokens after the word, kinds of them, its own tokens


def _loss(n, after, kinds, single, total) -> np.ndarray:
    """Bits of bigrams met n times, by what is counted of their two words."""
    every = np.maximum(after.astype(float), 1)
    own = np.maximum(n - DISCOUNT, 0) / every
    left = np.where(after > 0, DISCOUNT * kinds / every, 1.0)
    return -np.log2(own + left * ((single + 1) / total)).astype(np.float32)


def _losses(short_words, totals):
    """Task: (before, token, target, background): the loss of bigrams of two short words."""

    def run(batches):
        of = short_words.value
        for batch in batches:
            before, token = batch["before"].to_numpy(), batch["token"].to_numpy()
            out = [batch["before"], batch["token"]]
            for side in ("n_target", "n"):
                known = of[f"after_{side}"][before], of[f"kinds_{side}"][before], of[f"single_{side}"][token]
                out.append(pa.array(_loss(batch[side].to_numpy(), *known, totals[side])))
            yield pa.RecordBatch.from_arrays(out, names=["before", "token", "target", "background"])

    return run


def _slots(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Place of each bigram in the filter."""
    value = mixed(before.view(np.uint64)) + token.view(np.uint64)
    return (mixed(value) & np.uint64(FILTER_BITS - 1)).view(np.int64)


def _corrections(short_words, totals):
    """Task: a bigram's loss less what it would be if met once, with its place in the filter.

    out_target and in_target: under the target model, for documents outside and inside the target.
    What is counted of long words stands in the columns of _joined, of short ones in the broadcast.
    """

    def run(batches):
        for batch in batches:
            before, token = batch["before"].to_numpy(), batch["token"].to_numpy()

            def of(word, column, name):
                own = short_words.value[column][np.where(word >= 0, word, 0)]
                if name not in batch.schema.names:
                    return own
                joined = batch[name].fill_null(0).to_numpy(zero_copy_only=False)
                return np.where(word >= 0, own, joined)

            out = [batch["before"], batch["token"], pa.array(_slots(before, token))]
            for side, once in (("n_target", 0), ("n_target", 1), ("n", 1)):
                known = (
                    of(before, f"after_{side}", f"b_after_{side}"),
                    of(before, f"kinds_{side}", f"b_kinds_{side}"),
                    of(token, f"single_{side}", f"t_single_{side}"),
                )
                loss = _loss(batch[side].to_numpy(), *known, totals[side]).astype(float)
                out.append(pa.array(loss - _loss(once, *known, totals[side])))
            yield pa.RecordBatch.from_arrays(
                out, names=["before", "token", "slot", "out_target", "in_target", "background"]
            )

    return run


def _common(key: np.ndarray, before: np.ndarray, token: np.ndarray):
    """Whether each bigram is in the sorted ``key``, and where."""
    bigram = np.where((before >= 0) & (token >= 0), (before << 16) | token, -1)
    place = np.searchsorted(key, bigram)
    place[place == len(key)] = 0
    return (key[place] == bigram if len(key) else np.zeros(len(bigram), bool)), place


def _sums(common, short_words, totals):
    """Task: per document its tokens and the summed losses of its bigrams.

    Those that are not common are taken as met once, here.
    """

    def run(batches):
        key, losses = common.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                before, token, row = _bigrams(some)
                out = [np.bincount(row, minlength=some.num_rows).astype(np.int64)]
                found, place = _common(key, before, token)
                rare = ~found
                ours, flag = row[rare], _flags(some, row[rare])
                stats = some["stats"].flatten()
                word, first = np.unique(stats.field("word").to_numpy(), return_index=True)

                def of(one, column):
                    own = short_words.value[column][np.where(one >= 0, one, 0)]
                    if not len(word):
                        return own
                    at = np.minimum(np.searchsorted(word, one), len(word) - 1)
                    return np.where(one >= 0, own, stats.field(column).to_numpy()[first][at])

                for side, once, loss in (("n_target", flag, losses[0]), ("n", 1, losses[1])):
                    single = _loss(
                        once,
                        of(before[rare], f"after_{side}"),
                        of(before[rare], f"kinds_{side}"),
                        of(token[rare], f"single_{side}"),
                        totals[side],
                    )
                    total = np.bincount(row[found], loss[place[found]], minlength=some.num_rows)
                    total = total + np.bincount(ours, single, minlength=some.num_rows)
                    out.append(total.astype(float))
                yield pa.RecordBatch.from_arrays(
                    [some["row"], some["doc_id"], *map(pa.array, out)],
                    names=["row", "doc_id", "n_tokens", "target", "background"],
                )

    return run


def _repeated_bigrams(common, repeated):
    """Task: (row, inside, before, token, times) of bigrams that are not common but may be repeated."""

    def run(batches):
        key, _ = common.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                before, token, row = _bigrams(some)
                kept = ~_common(key, before, token)[0]
                kept[kept] = has(repeated.value, _slots(before[kept], token[kept]))
                before, token, row = before[kept], token[kept], row[kept]
                order = np.lexsort((token, before, row))
                before, token, row = before[order], token[order], row[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (np.diff(row) != 0) | (np.diff(before) != 0) | (np.diff(token) != 0)
                first = np.flatnonzero(fresh)
                of_row = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        some["row"].take(of_row),
                        some["in_target"].take(of_row),
                        pa.array(before[first]),
                        pa.array(token[first]),
                        pa.array(np.diff(np.append(first, len(row)))),
                    ],
                    names=["row", "inside", "before", "token", "times"],
                )

    return run


def _by_word(counts: DataFrame) -> DataFrame:
    """Per word and model: tokens after it, kinds of them, and its own tokens."""
    none, sides = F.lit(0).cast("long"), ("n_target", "n")
    left = counts.groupBy(F.col("before").alias("word")).agg(
        *[F.sum(s).alias(f"after_{s}") for s in sides],
        *[F.count_if(F.col(s) > 0).alias(f"kinds_{s}") for s in sides],
        *[none.alias(f"single_{s}") for s in sides],
    )
    right = counts.groupBy(F.col("token").alias("word")).agg(
        *[none.alias(f"{c}_{s}") for c in ("after", "kinds") for s in sides],
        *[F.sum(s).alias(f"single_{s}") for s in sides],
    )
    names = [f"{c}_{s}" for c in _OF_WORD for s in sides]
    return left.union(right).groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


def _joined(counts: DataFrame, by_word: DataFrame) -> DataFrame:
    """Counts of those bigrams that have a long word, and what is counted of their long words.

    Long words are no hot keys, and short ones, which match nothing, are dealt by the whole bigram.
    """
    out = counts.where("before < 0 OR token < 0")
    for word, short, wanted in (("before", "b", ("after", "kinds")), ("token", "t", ("single",))):
        own = by_word.where("word < 0").select(
            F.col("word").alias("key"),
            *[F.col(f"{c}_{s}").alias(f"{short}_{c}_{s}") for c in wanted for s in ("n_target", "n")],
        )
        spread = F.abs(F.xxhash64("before", "token") % (1 << 62))
        out = out.withColumn("at", F.when(F.col(word) < 0, F.col(word)).otherwise(spread))
        out = out.join(own, F.col("at") == F.col("key"), "left").drop("at", "key")
    return out


def cross_entropy_difference(
    docs: DataFrame,
    target_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    short_words: int = SHORT,
    common_bigrams: int = COMMON,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score.

    target_ids: the ids (first column) of the target documents; nulls and repeats do no harm.
    Losses are bits per token, score is their difference. Words are as for shingles, so a null text
    or one without words has no tokens, and its losses and score are null. Every row is reported,
    rows that repeat alike. Without any target document the target model is uniform. Other columns
    play no part.

    short_words and common_bigrams: how many words and bigrams are not joined, at most; the result
    is the same for any.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("id")).where("id IS NOT NULL")
    ids = ids.distinct()
    found = chosen.select("text").mapInArrow(_word_counts, "word long, n long")
    found = scratch.write(found.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    frequent = found.where(_most_frequent(found, "n", short_words)).select("word")
    short = spark.sparkContext.broadcast(np.sort(frequent.toArrow()["word"].to_numpy()))
    scratch.drop(found)

    id_type = chosen.schema["doc_id"].dataType.simpleString()
    of_text = f"doc_id {id_type}, tokens binary, long array<long>"
    read = chosen.mapInArrow(_tokens(short), of_text)
    read = scratch.write(read.withColumn("row", F.monotonically_increasing_id()), "read")
    # A word seen once is in one row.
    once = read.select("row", F.explode("long").alias("word")).groupBy("word")
    once = once.agg(F.count("*").alias("n"), F.min("row").alias("row")).where("n = 1")
    target = read.join(ids, read["doc_id"] == ids["id"], "left_semi")
    marked = once.select("row", "word", F.lit(False).alias("in_target")).union(
        target.select("row", F.lit(None).cast("long"), F.lit(True))
    )
    marked = marked.groupBy("row").agg(
        F.collect_list("word").alias("once"), F.bool_or("in_target").alias("in_target")
    )
    tokens = read.join(marked, "row", "left").select(
        "row", "doc_id", F.coalesce("in_target", F.lit(False)).alias("in_target"),
        "tokens", "long", "once",
    )
    of_row = f"row long, doc_id {id_type}, in_target boolean, tokens binary, long array<long>"
    tokens = scratch.write(tokens.mapInArrow(_settled, of_row), "tokens")
    scratch.drop(read)

    counts = tokens.select("in_target", "tokens", "long").mapInArrow(
        _bigram_counts, "before long, token long, n_target long, n long"
    )
    counts = counts.groupBy("before", "token")
    counts = counts.agg(F.sum("n_target").alias("n_target"), F.sum("n").alias("n"))
    counts = scratch.write(counts, "counts")
    by_word = scratch.write(_by_word(counts), "by-word")
    sizes = by_word.agg(
        F.count_if(F.col("word") != START).alias("entries"),
        *[F.coalesce(F.sum(f"single_{s}"), F.lit(0)).alias(s) for s in ("n_target", "n")],
    ).first()
    totals = {s: sizes[s] + max(sizes["entries"], ENTRIES) for s in ("n_target", "n")}
    rows = by_word.where("word >= 0").toArrow()
    arrays = {c: np.zeros(1 << 16, np.int64) for c in rows.column_names if c != "word"}
    for c, values in arrays.items():
        values[rows["word"].to_numpy()] = rows[c].to_numpy()
    arrays = spark.sparkContext.broadcast(arrays)
    of_short = counts.where("before >= 0 AND token >= 0")
    most = _most_frequent(of_short, "n", common_bigrams)
    often = of_short.where(most).mapInArrow(
        _losses(arrays, totals), "before long, token long, target float, background float"
    )
    often = often.toArrow()
    key = (often["before"].to_numpy() << 16) | often["token"].to_numpy()
    order = np.argsort(key)
    losses = [often[c].to_numpy()[order] for c in ("target", "background")]
    common = spark.sparkContext.broadcast((key[order], losses))

    # Only bigrams met more than once, a part of all, are joined with what is counted of their words.
    corrected = _corrections(arrays, totals)
    of_repeated = (
        "before long, token long, slot long, out_target double, in_target double, background double"
    )
    repeated = of_short.where(~most & (F.col("n") > 1)).mapInArrow(corrected, of_repeated)
    joined = _joined(counts.where("n > 1"), by_word).mapInArrow(corrected, of_repeated)
    repeated = scratch.write(repeated.union(joined), "repeated")
    scratch.drop(counts)

    # Steps are written apart, so that the shuffles of one are gone before the next begins.
    stats = tokens.select("row", F.explode(F.array_distinct("long")).alias("word"))
    stats = stats.join(by_word.where("word < 0"), "word").groupBy("row")
    stats = stats.agg(F.collect_list(F.struct(*by_word.columns)).alias("stats"))
    sums = scratch.write(
        tokens.join(stats, "row", "left").mapInArrow(
            _sums(common, arrays, totals),
            f"row long, doc_id {id_type}, n_tokens long, target double, background double",
        ),
        "sums",
    )
    scratch.drop(by_word)
    bits = spark.sparkContext.broadcast(bits_of(repeated.select("slot")))
    rare = tokens.select("row", "in_target", "tokens", "long").mapInArrow(
        _repeated_bigrams(common, bits),
        "row long, inside boolean, before long, token long, times long",
    )
    under_target = F.when(F.col("inside"), F.col("in_target")).otherwise(F.col("out_target"))
    rest = (
        rare.join(repeated.drop("slot"), ["before", "token"])
        .groupBy("row")
        .agg(
            F.sum(under_target * F.col("times")).alias("rare_target"),
            F.sum(F.col("background") * F.col("times")).alias("rare_background"),
        )
    )
    both = sums.join(rest, "row", "left")

    def mean(side):
        total = F.col(side) + F.coalesce(F.col(f"rare_{side}"), F.lit(0.0))
        return F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))

    return both.select(
        "doc_id",
        "n_tokens",
        mean("target").alias("target_loss"),
        mean("background").alias("background_loss"),
        (mean("target") - mean("background")).alias("score"),
    )


@query("op4_lm_scoring")
def op4(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    good = labels.where("quality = 1 AND coalesce(toxic, 0) <> 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)
