"""Language identification with interpolated Kneser-Ney character models.

One model per language, fitted on a bounded sample of labelled texts. All models share sorted arrays
of n-gram hashes, with one column of log probabilities per language. A text belongs to the language
of the lowest cross-entropy per character. It is rejected when that is higher than anything the
held-back part of the sample showed, allowing for the text's length.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.arrow_text import chunks
from textquarry.llm.tables import query, table

ORDER = 4
SAMPLE_DOCS = 400  # labelled texts per language, at most
SAMPLE_CHARS = 50_000  # longer documents are not sampled
UNDETERMINED = "und"
_PAD = 2  # stands before every text
_A = np.uint64(0xD6E8FEB86659FD93)
# How far beyond the calibration texts a text must lie to be rejected, and in any case: 24 is 1.2
# bits per character for a long text, where one in another alphabet lies 6 bits off.
_RESERVE, _LEAST = 1.5, 24.0


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its letter in lower case, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def symbols(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of UTF-8 texts, ORDER - 1 pads before each, and the text of each."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.repeat(np.arange(len(ends)), np.diff(before[ends], prepend=0))
    codes = _letters()[codes]
    gap = codes == 32
    keep = ~gap
    keep[:1] = True  # a text may begin with a space wherever it stands
    keep[1:] |= ~(gap[:-1] & (text[1:] == text[:-1]))
    codes, text = codes[keep], text[keep]
    pads = np.full(len(ends) * (ORDER - 1), _PAD, np.uint32)
    owner = np.repeat(np.arange(len(ends)), ORDER - 1)
    order = np.argsort(np.concatenate([owner, text]), kind="stable")
    return np.concatenate([pads, codes])[order], np.concatenate([owner, text])[order]


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each position from ORDER - 1 on."""
    size = max(0, len(codes) - ORDER + 1)
    key = np.zeros(size, np.uint64)
    for back in range(n - 1, -1, -1):
        at = ORDER - 1 - back
        key = key * _A + codes[at : at + size].astype(np.uint64) + np.uint64(1)
    return key


class Models:
    """Log probabilities of every language's model over the n-grams any of them has seen."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        grams: list[dict] = [{} for _ in range(ORDER + 1)]
        streams = []
        for language in self.languages:
            raw = [t.encode() for t in texts[language]]
            ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
            codes, _ = symbols(np.frombuffer(b"".join(raw), np.uint8), ends)
            at = np.flatnonzero(codes[ORDER - 1 :] != _PAD)
            streams.append((codes, at))
        self.key, self.logp, self.context, self.gamma = [None], [None], [None], [None]
        lower = None
        # From the longest n-grams down for the counts, then up for the probabilities.
        union, rows = {}, {}
        for n in range(1, ORDER + 1):
            keys = [gram_keys(c, n)[at] for c, at in streams]
            every, first = np.unique(np.concatenate([np.zeros(0, "u8"), *keys]), return_index=True)
            spans = np.concatenate(
                [np.zeros((0, n), np.uint32)]
                + [np.stack([c[at + ORDER - n + i] for i in range(n)], 1) for c, at in streams]
            )
            union[n], rows[n] = every, spans[first]
            if n == ORDER:
                counts = np.zeros((len(every), len(keys)))
                for i, k in enumerate(keys):
                    counts[:, i] = np.bincount(
                        np.searchsorted(every, k), minlength=len(every)
                    )
        count = {ORDER: counts}
        for n in range(ORDER - 1, 0, -1):  # in how many different contexts was it seen
            suffix = np.searchsorted(union[n], _hash(rows[n + 1][:, 1:]))
            count[n] = np.zeros((len(union[n]), len(self.languages)))
            np.add.at(count[n], suffix, count[n + 1] > 0)
        alphabet = len(union[1]) + 1
        self.floor = -np.log2(alphabet)
        lower = np.full((1, len(self.languages)), 1 / alphabet)
        for n in range(1, ORDER + 1):
            c = count[n]
            once, twice = (c == 1).sum(0), (c == 2).sum(0)
            discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
            contexts, place = np.unique(_hash(rows[n][:, :-1]), return_inverse=True)
            total = np.zeros((len(contexts), len(self.languages)))
            kinds = np.zeros_like(total)
            np.add.at(total, place, c)
            np.add.at(kinds, place, c > 0)
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.maximum(c - discount, 0) / np.maximum(total[place], 1)
            suffix = (
                np.searchsorted(union[n - 1], _hash(rows[n][:, 1:]))
                if n > 1
                else np.zeros(len(c), np.int64)
            )
            lower = own + gamma[place] * lower[suffix]
            self.key.append(union[n])
            self.logp.append(np.log2(lower).astype(np.float32))
            self.context.append(contexts)
            self.gamma.append(np.log2(gamma).astype(np.float32))
        self.fitted = bool(self.languages) and len(union[ORDER]) > 0

    def bits(self, codes: np.ndarray, at: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log probabilities of the codes at ``at``, one column per language."""
        if n == 0:
            return np.full((len(at), len(self.languages)), self.floor, np.float32)
        row, seen = _find(self.key[n], _window(codes, at, n))
        out = self.logp[n][row]
        missed = np.flatnonzero(~seen)
        if len(missed):
            rest = at[missed]
            less = self.bits(codes, rest, n - 1)
            row, seen = _find(self.context[n], _window(codes, rest - 1, n - 1))
            less += np.where(seen[:, None], self.gamma[n][row], 0)
            out[missed] = less
        return out

    def cross_entropy(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and its characters (0: no letter)."""
        codes, text = symbols(data, ends)
        at = np.flatnonzero(codes != _PAD)
        owner = text[at]
        n = np.bincount(owner, minlength=len(ends))
        letters = np.bincount(owner, codes[at] != 32, minlength=len(ends))
        bits = self.bits(codes, at)
        total = np.stack(
            [np.bincount(owner, b, minlength=len(ends)) for b in bits.T], 1
        ) if len(at) else np.zeros((len(ends), len(self.languages)))
        return -total / np.maximum(n, 1)[:, None], np.where(letters > 0, n, 0)

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Set the rejection bound and the scale of the scores from texts not fitted on.

        The bound is one for all languages, since texts that mix two are normal in each.
        """
        self.mean = np.zeros(len(self.languages))
        furthest = 0.0
        logits, truth = [], []
        for i, language in enumerate(self.languages):
            raw = [t.encode() for t in texts.get(language, [])]
            if not raw:
                continue
            ce, n = self.cross_entropy(
                np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
            )
            ce, n = ce[n > 0], n[n > 0]
            if len(n):
                self.mean[i] = np.average(ce[:, i], weights=n)
                furthest = max(furthest, self.excess(ce[:, i], n, i).max())
                logits.append(-ce * np.sqrt(n)[:, None])
                truth += [i] * len(n)
        self.bound, self.scale = np.inf, 1.0
        if truth:
            self.bound = max(_LEAST, _RESERVE * furthest)
            logits = np.concatenate(logits)
            losses = {
                s: -np.log(_softmax(logits / s)[np.arange(len(truth)), truth] + 1e-12).mean()
                for s in (0.25, 0.5, 1, 2, 4, 8, 16)
            }
            self.scale = min(losses, key=losses.get)

    def excess(self, ce: np.ndarray, n: np.ndarray, language) -> np.ndarray:
        """Distance from the language's mean, in the spread that a text of n characters has."""
        return (ce - self.mean[language]) / np.sqrt(1 / np.maximum(n, 1) + 1 / 400)

    def predict(self, data: np.ndarray, ends: np.ndarray):
        """Language, score, cross-entropy and rejection of each text."""
        nothing = (
            np.full(len(ends), UNDETERMINED, object),
            np.zeros(len(ends)),
            np.full(len(ends), np.nan),
            np.ones(len(ends), bool),
        )
        if not self.fitted:
            return nothing
        ce, n = self.cross_entropy(data, ends)
        best = ce.argmin(1)
        lowest = ce[np.arange(len(ce)), best]
        score = _softmax(-ce * np.sqrt(n)[:, None] / self.scale)[np.arange(len(ce)), best]
        rejected = self.excess(lowest, n, best) > self.bound
        found = (np.array(self.languages, object)[best], score, lowest, rejected)
        return tuple(np.where(n > 0, f, e) for f, e in zip(found, nothing, strict=True))


def _hash(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        key = key * _A + column.astype(np.uint64) + np.uint64(1)
    return key


def _window(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    key = np.zeros(len(at), np.uint64)
    for back in range(n - 1, -1, -1):
        key = key * _A + codes[at - back].astype(np.uint64) + np.uint64(1)
    return key


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    learn_from: Callable[[Column], Column] = lambda doc_id: ~held_out(doc_id),
    sample_docs: int = SAMPLE_DOCS,
) -> Models:
    """Fit on ``sample_docs`` texts per language, or all it has, drawn by their hash.

    Equal texts of a language are drawn as one. Documents without a language, a text or an id, those
    ``learn_from`` leaves out and those longer than SAMPLE_CHARS are not drawn. A fifth of the sample
    only calibrates.
    """
    text = docs[text_col]
    pool = docs.where(
        docs[id_col].isNotNull()
        & docs[lang_col].isNotNull()
        & (F.length(text) <= SAMPLE_CHARS)
        & learn_from(docs[id_col])
    ).select(docs[lang_col].cast("string").alias("lang"), text.alias("text"))
    pool = pool.withColumn("draw", F.xxhash64("text"))
    # The lowest draws are told apart without their texts, among those that surely hold them.
    distinct = pool.select("lang", "draw").distinct()
    place, near = F.pmod("draw", F.lit(1 << 40)), F.lit(False)
    for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect():
        part = min(1.0, (4 * sample_docs + 64) / r.n)
        near |= (F.col("lang") == r.lang) & (place < int(part * (1 << 40)))
    by_draw = Window.partitionBy("lang").orderBy(place, "draw")
    lowest = distinct.where(near).withColumn("at", F.row_number().over(by_draw))
    lowest = lowest.where(F.col("at") <= sample_docs).drop("at")
    drawn = pool.join(F.broadcast(lowest), ["lang", "draw"], "left_semi")
    drawn = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text")).collect()
    fitted: dict[str, list[str]] = {r.lang: [] for r in drawn}
    kept: dict[str, list[str]] = {r.lang: [] for r in drawn}
    for r in sorted(drawn, key=lambda r: (r.draw, r.text)):
        (kept if len(fitted[r.lang]) > 4 * len(kept[r.lang]) + 3 else fitted)[r.lang].append(r.text)
    models = Models(fitted)
    models.calibrate(kept)
    return models


def identified(
    docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1), cross_entropy, rejected.

    Every whole text is read. A null text, or one without letters, is ``und`` with score 0 and
    rejected, as is every text when nothing could be learned. Rows that repeat are answered alike.
    Other columns, a language among them, play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    chosen = docs.select(
        docs[id_col].alias("doc_id"),
        held_out(docs[id_col]).alias("held_out"),
        docs[text_col].alias("text"),
    )

    def predict(batches):
        for batch in batches:
            for chunk in chunks(batch["text"]):
                lang, score, ce, rejected = shared.value.predict(chunk.data, chunk.ends)
                rows = batch.slice(chunk.first, len(chunk.ends))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"],
                        rows["held_out"],
                        pa.array(lang.tolist(), pa.string()),
                        pa.array(score.astype(float)),
                        pa.array(ce.astype(float)),
                        pa.array(rejected.astype(bool)),
                    ],
                    names=names,
                )

    names = ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"]
    schema = chosen.select("doc_id", "held_out").schema
    for name, kind in zip(names[2:], ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return chosen.mapInArrow(predict, schema)


def recognised(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def keep(batches):
        for batch in batches:
            for chunk in chunks(batch[text_col]):
                rejected = shared.value.predict(chunk.data, chunk.ends)[3]
                rows = batch.slice(chunk.first, len(chunk.ends))
                yield rows.filter(pa.array(~rejected.astype(bool)))

    return docs.mapInArrow(keep, docs.schema)


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))
