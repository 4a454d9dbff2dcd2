"""Near copies by a size-aware heavy-light join of word shingle sets.

Two sets of Jaccard similarity s or more share most of their shingles, so they also share some of
the first few in any common order. The order puts shingles by their number of documents, rarest
first, as far as a bounded table of frequent shingles tells, and then by hash. Small sets enumerate
the pairs (subsets of fixed size two) of their first shingles, which few others share; large sets,
for which that would be too many, scan the inverted lists of single shingles. The boundary is the
size at which the two cost the same over all sets.

Lists are never expanded into all their pairs. In a few turns, sets outside the largest component of
a list are compared with some of its members, and components grow. Then all sets of one list that
are still in different components are compared, so no link between components is left out. Exact
intersections decide, but first a sketch of each set, a sixteenth of its size, bounds the intersection
from above: pairs that cannot be similar fall before any set moves.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.arrow_text import chunks
from textquarry.llm.components import components
from textquarry.llm.filters import FILTER_BITS, bits_of, has
from textquarry.llm.shingles import mixed, set_ids, shingle_sets
from textquarry.llm.tables import Scratch, query, table

SHARE, WHOLE = 75, 100  # similarity of at least SHARE / WHOLE
FREQUENT = 1 << 20  # shingles in the table of frequent ones, at most
MAX_SMALL = 512
MARKS = 8  # words of the sketch that goes with the entries of lists compared in full
TRIED = 4  # sets of another component that a set is compared with in one turn
GAIN = 0.9  # a turn that leaves more than this share of the comparisons is the last
TURNS = 8  # turns at most; what they leave apart is compared in full


def least_shared(n):
    """Shingles that a set of n must share with any similar set."""
    return -(-n * SHARE // WHOLE)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _local_counts(batches):
    """Shingles met more than once by this task, with their documents here."""
    seen: list[np.ndarray] = []
    many = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]

    def merge():
        value = np.concatenate([many[0], *seen])
        count = np.concatenate([many[1], np.ones(len(value) - len(many[0]), np.int64)])
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        many[:] = [value[first], np.add.reduceat(count, first)] if len(value) else many
        seen.clear()

    def emitted():
        merge()
        keep = many[1] > 1
        value, count = many[0][keep], many[1][keep]
        many[:] = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for at in range(0, len(value), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [_signed(value[part]), pa.array(count[part])], names=["shingle", "n"]
            )

    size = 0
    for batch in batches:
        for chunk in chunks(batch["text"]):
            value, _ = shingle_sets(chunk)
            seen.append(value)
            size += len(value)
            if size > 4_000_000:  # what one task holds at a time
                yield from emitted()
                size = 0
    yield from emitted()


def frequent_shingles(texts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and the logarithm of their documents.

    Only the order of the shingles, and so the speed of the join, depends on this table.
    """
    counts = texts.mapInArrow(_local_counts, "shingle long, n long")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n"))
    scratch = Scratch(texts.sparkSession, "near-copies")
    counts = scratch.write(counts, "frequent")
    level = F.floor(F.log2("n")).cast("int")
    sizes = dict(counts.groupBy(level.alias("level")).agg(F.count("*")).collect())
    total, least = 0, 63
    for found in sorted(sizes, reverse=True):
        total += sizes[found]
        if total > most:
            break
        least = found
    rows = counts.where(level >= least).select("shingle", level.alias("level")).toArrow()
    scratch.drop(counts)
    value = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(value)
    return value[order], rows["level"].to_numpy().astype(np.int16)[order]


def _sets(frequent):
    """Task: the sets of a batch of texts, with what finds and bounds their partners."""

    def run(batches):
        value_f, level_f = frequent.value
        for batch in batches:
            for chunk in chunks(batch["text"]):
                value, ends = shingle_sets(chunk)
                n = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(n)), n)
                level = np.zeros(len(value), np.int64)
                if len(value_f):
                    row = np.minimum(np.searchsorted(value_f, value), len(value_f) - 1)
                    level = np.where(value_f[row] == value, level_f[row], 0).astype(np.int64)
                order = np.lexsort((value, level, owner))
                head = np.where(n > 0, np.minimum(n - least_shared(n) + 2, n), 0)
                place = np.arange(len(value)) - np.repeat(ends - n, n)
                front = place < head[owner]
                # Scanning costs an entry in every list but the last's, sorted among the others.
                cost = np.where(place < head[owner] - 1, 1 + level[order], 0)
                sid = set_ids(value, ends, n)
                heads = np.concatenate([[0], np.cumsum(head)])
                rows = batch.slice(chunk.first, len(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"],
                        pa.array(n.astype(np.int64)),
                        pa.array(sid, mask=n == 0),
                        pa.ListArray.from_arrays(
                            pa.array(heads.astype(np.int32)), _signed(value[order][front])
                        ),
                        pa.array(np.bincount(owner, cost, minlength=len(n)).astype(float)),
                    ],
                    names=["doc_id", "n", "sid", "head", "cost"],
                )

    return run


def boundary(sets: DataFrame) -> int:
    """Largest set that enumerates subsets: where both ways together cost least."""
    small = sets.where(F.col("n") <= MAX_SMALL)
    head = F.size("head").cast("double")
    costs = small.groupBy("n").agg(
        F.sum(head * (head - 1) / 2).alias("subsets"), F.sum("cost").alias("scans")
    )
    rows = sorted(tuple(r) for r in costs.collect())  # at most MAX_SMALL
    best, at, gain = 0.0, 0, 0.0
    for n, subsets, scans in rows:
        gain += scans - subsets
        if gain > best:
            best, at = gain, n
    return int(at)


def _keys(limit: int):
    """Task: (key, sid, n, rest) of subsets of small sets and of single shingles of the others.

    Sets near the boundary give both, as their partners may lie beyond it. rest bounds what the set
    shares with one for which this is the first key both have: nothing before it is shared.
    """

    def run(batches):
        corners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                keys, sids, sizes, rests = [], [], [], []
                columns = (rows[c].to_numpy(zero_copy_only=False) for c in ("sid", "n", "head"))
                for sid, n, head in zip(*columns, strict=True):
                    head = head.view(np.uint64) if len(head) else np.zeros(0, np.uint64)
                    own, rest = [], []
                    if n <= limit:
                        if len(head) not in corners:
                            corners[len(head)] = np.triu_indices(len(head), 1)
                        i, j = corners[len(head)]
                        low, high = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
                        own.append(mixed(low * np.uint64(0x9FB21C651E98DF25) ^ mixed(high)))
                        rest.append(n - j + 1)
                    if n * WHOLE > limit * SHARE:
                        own.append(head[: n - least_shared(n) + 1])
                        rest.append(n - np.arange(len(own[-1])))
                    own = np.concatenate(own)
                    keys.append(own)
                    sids.append(np.full(len(own), sid, np.int64))
                    sizes.append(np.full(len(own), n, np.int64))
                    rests += rest
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(np.concatenate(keys)),
                        pa.array(np.concatenate(sids)),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(rests).astype(np.int64)),
                    ],
                    names=["key", "sid", "n", "rest"],
                )

    return run


_MARKED = [f"m{i}" for i in range(MARKS)]


def _marks_meet(na, nb):
    """Whether the marks of x and y leave room for a similar pair; see ``most_shared``."""

    def ones(words):
        return reduce(lambda total, word: total + F.bit_count(word), words, F.lit(0))

    x, y = ([F.col(f"{side}{m}") for m in _MARKED] for side in "xy")
    held = ones([a.bitwiseAND(b) for a, b in zip(x, y, strict=True)])
    return _room(na, nb, held + F.least(na - ones(x), nb - ones(y)))


def _room(na, nb, *rests):
    """Whether sets of these sizes may be similar if they share no more than the least of rests."""
    return F.least(*rests, na, nb) * (WHOLE + SHARE) >= (na + nb) * SHARE


def sketch(value: np.ndarray) -> np.ndarray:
    """One bit for each place that some shingle falls on, among four to eight places a shingle."""
    places = 1 << max(6, (4 * len(value) - 1).bit_length())
    bits = np.zeros(places, np.uint8)
    bits[value & np.uint64(places - 1)] = 1
    return np.packbits(bits, bitorder="little")


def marks(value: np.ndarray) -> np.ndarray:
    """A sketch of MARKS words of 64 places, the same for sets of any size."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[value & np.uint64(64 * MARKS - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_shared(x: np.ndarray, na: int, y: np.ndarray, nb: int) -> int:
    """What sets of na and nb shingles with these sketches share at most.

    A place that both hold may stand for one shared shingle, and for one more with every further
    shingle that fell on a taken place, of the set that has fewer of these.
    """
    if len(x) != len(y):  # places are low bits: the larger sketch folds onto the smaller
        if len(x) < len(y):
            x, y, na, nb = y, x, nb, na
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    x, y = x.view(np.uint64), y.view(np.uint64)
    held, over = int(np.bitwise_count(x & y).sum()), []
    for bits, n in ((x, na), (y, nb)):
        over.append(n - int(np.bitwise_count(bits).sum()))
    return min(held + min(over), na, nb)


def _possible(batches):
    """Task: pairs that may be similar by their sketches, and the share that they may have."""
    for batch in batches:
        keep, shares = [], []
        columns = (batch[c].to_pylist() for c in ("ka", "na", "kb", "nb"))
        for x, na, y, nb in zip(*columns, strict=True):
            shared = most_shared(np.frombuffer(x, np.uint8), na, np.frombuffer(y, np.uint8), nb)
            keep.append(shared * (WHOLE + SHARE) >= (na + nb) * SHARE)
            shares.append(shared / (na + nb))
        rows = batch.drop_columns(["ka", "na", "kb", "nb"])
        rows = rows.append_column("share", pa.array(shares, pa.float64()))
        yield rows.filter(pa.array(keep, pa.bool_()))


def _chosen(wanted):
    """Task: the rows whose sid may be in the filter."""

    def run(batches):
        for batch in batches:
            sid = batch["sid"].to_numpy()
            yield batch.filter(pa.array(has(wanted.value, sid % FILTER_BITS)))

    return run


def _links(batches):
    """Task: pairs that are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch["xa"], batch["xb"], strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(WHOLE * shared >= SHARE * (len(x) + len(y) - shared))
        yield batch.drop_columns(["xa", "xb"]).filter(pa.array(keep, pa.bool_()))


def _whole_sets(wanted):
    """Task: (sid, n, shingles, sketch, marks) of texts whose set may be in the filter."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch["text"]):
                value, ends = shingle_sets(chunk)
                n = np.diff(ends, prepend=0)
                sid = set_ids(value, ends, n)
                rows = np.flatnonzero((n > 0) & has(wanted.value, sid % FILTER_BITS))
                own = [value[ends[r] - n[r] : ends[r]] for r in rows]
                marked = np.array([marks(v) for v in own], np.int64).reshape(-1, MARKS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sid[rows]),
                        pa.array(n[rows].astype(np.int64)),
                        pa.array([v.tobytes() for v in own], pa.binary()),
                        pa.array([sketch(v).tobytes() for v in own], pa.binary()),
                        *[pa.array(column) for column in marked.T],
                    ],
                    names=["sid", "n", "shingles", "sketch", *_MARKED],
                )

    return run


def _moved(links: DataFrame) -> DataFrame:
    """(root, moved): every component that links reach takes the least root around a common one."""
    ends = links.select("from_root", "to_root").distinct()
    least = ends.groupBy("to_root").agg(F.min("from_root").alias("moved"))
    least = least.select("to_root", F.least("to_root", "moved").alias("moved"))
    around = ends.join(least, "to_root").select(F.col("from_root").alias("root"), "moved")
    around = around.union(least.select(F.col("to_root").alias("root"), "moved"))
    return around.groupBy("root").agg(F.min("moved").alias("moved"))


class Near:
    """One run of the join over a table of (doc_id, text)."""

    def __init__(self, texts: DataFrame):
        self.texts, self.spark = texts, texts.sparkSession
        self.scratch = Scratch(self.spark, "near-copies")
        frequent = self.spark.sparkContext.broadcast(frequent_shingles(texts))
        id_type = texts.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {id_type}, n long, sid long, head array<long>, cost double"
        self.docs = self.scratch.write(texts.mapInArrow(_sets(frequent), schema), "sets")

    def filter_of(self, sids: DataFrame):
        """Broadcast of a filter that has all of ``sids``."""
        slots = sids.select(F.pmod("sid", F.lit(FILTER_BITS)).alias("slot"))
        return self.spark.sparkContext.broadcast(bits_of(slots))

    def whole_sets(self, wanted: DataFrame) -> DataFrame:
        """(sid, n, shingles, sketch, marks) of the distinct ids ``wanted``, read again from the texts.

        Most other texts are left where they are by a filter.
        """
        schema = "sid long, n long, shingles binary, sketch binary"
        schema += "".join(f", {m} long" for m in _MARKED)
        kept = self.filter_of(wanted)
        sets = self.texts.mapInArrow(_whole_sets(kept), schema)
        sets = sets.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])
        whole = self.scratch.write(sets, "whole")
        kept.unpersist()
        return whole

    def linked(self, pairs: DataFrame, whole: DataFrame, best: bool) -> DataFrame:
        """Those of the pairs (a, b) of sets that are similar, with all their columns.

        With ``best`` only the pair of each a that may share most is compared.
        """

        def side(columns: dict[str, str]) -> DataFrame:
            return whole.select(*[F.col(c).alias(name) for c, name in columns.items()])

        left = side({"sid": "a", "n": "na", "sketch": "ka"})
        right = side({"sid": "b", "n": "nb", "sketch": "kb"})
        both = pairs.join(left, "a").join(right, "b")
        both = both.select(*pairs.columns, "ka", "na", "kb", "nb")
        schema = pairs.withColumn("share", F.lit(0.0)).schema
        possible = both.mapInArrow(_possible, schema)
        if best:
            most = Window.partitionBy("a").orderBy(F.desc("share"), "b")
            possible = possible.withColumn("at", F.row_number().over(most)).where("at = 1")
        possible = self.scratch.write(possible.select(*pairs.columns), "possible")

        ends = possible.select(F.col("a").alias("sid")).union(possible.select("b"))
        kept = self.filter_of(ends)
        sets = whole.select("sid", "shingles").mapInArrow(_chosen(kept), "sid long, shingles binary")
        left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("xa"))
        right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("xb"))
        both = possible.join(left, "a").join(right, "b").select(*pairs.columns, "xa", "xb")
        found = self.scratch.write(both.mapInArrow(_links, pairs.schema), "links")
        self.scratch.drop(possible)
        kept.unpersist()
        return found

    def apart(
        self, keys: DataFrame, roots: DataFrame | None, turn: int
    ) -> tuple[DataFrame, DataFrame]:
        """All entries with their component, and the lists that lie in several with their main one.

        main is (size, root, TRIED sets of it, drawn by hash and turn, with their sizes).
        """
        member = keys.withColumn("root", F.col("sid"))
        if roots is not None:
            member = keys.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        member = self.scratch.write(member, "members")
        drawn = [
            F.min(F.struct(F.xxhash64(F.lit(turn * TRIED + k), "sid"), "sid", "n", "rest"))
            for k in range(TRIED)
        ]
        drawn = [d.alias(f"t{k}") for k, d in enumerate(drawn)]
        parts = member.groupBy("key", "root").agg(F.count("*").alias("size"), *drawn)
        lists = parts.groupBy("key").agg(
            F.max(
                F.struct("size", "root", F.array(*[f"t{k}" for k in range(TRIED)]).alias("tried"))
            ).alias("main"),
            F.count("*").alias("parts"),
            F.sum("size").alias("length"),
        )
        return member, self.scratch.write(lists.where("parts > 1").drop("parts"), "apart")

    def components(self) -> DataFrame:
        """(node, root) over the ids of sets that are linked to another."""
        write, drop = self.scratch.write, self.scratch.drop
        held = self.docs.where("n > 0")
        sets = held.select("sid", "n", "head").dropDuplicates(["sid"])
        keys = sets.mapInArrow(_keys(boundary(held)), "key long, sid long, n long, rest long")
        lists = keys.groupBy("key").agg(F.count("*").alias("length"), F.min("n").alias("least"))
        keys = keys.join(lists.where("length > 1").select("key", "least"), "key")
        # An entry that has no room for a set of any size in its list is no first common key. Room is
        # most for the least size that may be similar at all, or for the list's least if that is more.
        n, rest = F.col("n"), F.col("rest")
        keys = keys.where(rest * WHOLE >= n * SHARE)
        keys = keys.where(rest * (WHOLE + SHARE) >= (n + F.col("least")) * SHARE)
        keys = write(keys.drop("least"), "lists")
        entries = keys.count()

        # Members outside a list's largest component try a few sets of it, the ones they share most
        # lists with first. A link moves the whole component over. Sets with the same root are
        # always connected; which sets are, all links tell in the end.
        links, roots, turn, before = [], None, 0, float("inf")
        while True:
            member, lists = self.apart(keys, roots, turn)
            left = lists.agg(F.sum((F.col("length") - F.col("main.size")) * F.col("length")))
            left = left.first()[0] or 0
            outside = member.join(lists, "key").where(F.col("root") != F.col("main.root"))
            if turn > 0 and (left <= entries or turn == TURNS or left > GAIN * before):
                break
            before = left
            if turn == 0:
                # Later lists hold no other sets than the first ones of two or more do.
                wanted = member.join(lists, "key", "left_semi").select("sid").distinct()
                wanted = write(wanted, "wanted")
                whole = self.whole_sets(wanted)
                drop(wanted)
            tried = outside.select("sid", "n", "rest", "root", "main", F.explode("main.tried").alias("t"))
            tried = tried.where(_room(*map(F.col, ("n", "t.n", "rest", "t.rest"))))
            tried = tried.groupBy(F.col("sid").alias("a"), F.col("t.sid").alias("b")).agg(
                F.count("*").alias("votes"),
                F.any_value("root").alias("from_root"),
                F.any_value("main.root").alias("to_root"),
            )
            best = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
            tried = tried.withColumn("at", F.row_number().over(best)).where(F.col("at") <= TRIED)
            found = self.linked(tried.select("a", "b", "from_root", "to_root"), whole, True)
            links.append(found.select("a", "b"))
            now = member.select("sid", "root").distinct().join(_moved(found), "root", "left")
            earlier = roots
            roots = write(now.select("sid", F.coalesce("moved", "root").alias("root")), "roots")
            for gone in (member, lists, earlier):
                if gone is not None:
                    drop(gone)
            turn += 1

        # What is still apart is compared in full, with sketches beside the entries, so that pairs that
        # cannot be similar are not even made.
        held = member.join(lists.select("key"), "key", "left_semi")
        held = write(held.join(whole.select("sid", *_MARKED), "sid"), "held")
        outside = held.join(lists, "key").where(F.col("root") != F.col("main.root"))
        x = outside.select(
            "key", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"),
            F.col("rest").alias("sa"), F.col("main.root").alias("main"),
            *[F.col(m).alias(f"x{m}") for m in _MARKED],
        )
        y = held.select(
            "key", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"),
            F.col("rest").alias("sb"), *[F.col(m).alias(f"y{m}") for m in _MARKED],
        )
        rest = (
            x.join(
                y,
                (x["key"] == y["key"])
                & (F.col("ra") != F.col("rb"))
                & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
                & _room(*map(F.col, ("na", "nb", "sa", "sb")))
                & _marks_meet(F.col("na"), F.col("nb")),
            )
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        links.append(self.linked(rest, whole, False))
        for gone in (held, member, lists, roots, whole, keys):
            if gone is not None:
                drop(gone)
        return components(reduce(DataFrame.union, links), self.scratch)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of anything but the six ASCII white space characters, with A-Z in lower case. A
    text's set holds its runs of five words, or its whole sequence where it has fewer. Texts with a
    Jaccard similarity of 0.75 or more are linked; component_id is the least doc_id that links lead
    to, its own included. A text that is null, empty or without words has no set and no links: its
    component is itself. Equal texts are linked. Rows that repeat are answered alike; a null doc_id
    never names a component that has another. Other columns play no part.
    """
    near = Near(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    roots = near.components()
    member = near.docs.select("doc_id", "n", "sid")
    member = member.join(roots, member["sid"] == roots["node"], "left").select(
        "doc_id", "n", F.coalesce("root", "sid").alias("root")
    )
    member = near.scratch.write(member, "documents")
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = member.where("root IS NULL").withColumn("component_id", F.col("doc_id"))
    return (
        member.join(least, "root")
        .unionByName(alone)
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component, with all their columns.

    Rows that repeat an id stand or fall together. Rows without an id or without words all stay.
    """
    kept = near_copies(docs, id_col, text_col)
    gone = kept.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All pairs that share a shingle, and every document that links lead to: for small tables.
ORACLE = rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents),
    runs AS (
        SELECT doc_id, i, n, hash(word, lead(word) OVER o, lead(word, 2) OVER o,
                                  lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
        FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)
        WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, shingle FROM runs WHERE i <= n - 4
        UNION ALL SELECT doc_id, hash(w) FROM words WHERE len(w) BETWEEN 1 AND 4),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
        FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY ALL),
    links AS MATERIALIZED (
        SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
        WHERE {WHOLE} * shared.n >= {SHARE} * (a.n + b.n - shared.n)),
    reached AS (
        SELECT doc_id AS node, doc_id AS root FROM documents
        UNION SELECT y, root FROM reached JOIN links ON x = node)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM documents d LEFT JOIN sizes USING (doc_id)
    JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reached GROUP BY node) USING (doc_id)
"""


@query("op2_jaccard_join", ORACLE)
def op2(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"))
