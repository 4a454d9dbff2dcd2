"""Main text of web pages, by differencing of pages with near URLs.

A page's blocks are its text lines. Every page is aligned, by the longest common subsequence of all
its lines, with the pages beside it in the order of host and path, and template lines go. On a page
that marks no article these are the lines that the nearest page shares. What the markup itself names
as no part of the article goes too, and where it marks the article, what stands outside. A line of a
marked article is a template line if all of the NEAR nearest pages of its host share it, but only
while these are less than half of the article's lines: copies of a text stand on many pages as well.

Pages are dealt by ranges of host and path, so a host of any size spreads over all tasks.
"""

from __future__ import annotations

from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.html_lines import ARTICLE, LOOSE, MAIN, page_lines
from textquarry.llm.tables import Scratch, query, table

NEAR = 10  # pages that must share a line of a marked article
_BLOCK = 1_000  # pages of a window


def _host_and_path(url: str | None) -> tuple[str | None, list[str]]:
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return None, []
    return host or None, [p for p in parts.path.lower().split("/") if p]


def _read(batches):
    """Task: all lines of every page, the places of those that may be its text, and ``open``: no
    article is marked."""
    names = ["page_id", "url", "host", "path", "every", "places", "open"]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            some = batch.slice(at, 200)
            hosts, paths, texts, places, open_ = [], [], [], [], []
            for url, page in zip(some["url"].to_pylist(), some["html"].to_pylist(), strict=True):
                host, path = _host_and_path(url)
                lines = page_lines(page or "", named=True)
                best = max((LOOSE, *(place for place, _ in lines)))
                hosts.append(host)
                paths.append(path)
                texts.append([text for _, text in lines])
                places.append([i for i, (place, _) in enumerate(lines) if place == best])
                open_.append(best not in (ARTICLE, MAIN))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    some["page_id"],
                    some["url"],
                    pa.array(hosts, pa.string()),
                    pa.array(paths, strings),
                    pa.array(texts, strings),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(open_),
                ],
                names=names,
            )


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        taken = row.copy()
        taken[1:] = np.where(b == x, row[:-1] + 1, row[1:])
        row = np.maximum.accumulate(taken)
    return row


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` are in one longest common subsequence with ``b``.

    Exact and in linear memory: ends that agree are taken, elements the other side lacks are left
    out, and the rest is halved (Hirschberg).
    """
    out = np.zeros(len(a), bool)
    same = min(len(a), len(b))
    head = int((np.append(a[:same] != b[:same], True)).argmax())
    out[:head] = True
    a, b, rest = a[head:], b[head:], out[head:]
    same = min(len(a), len(b))
    tail = int((np.append(a[::-1][:same] != b[::-1][:same], True)).argmax())
    rest[len(a) - tail :] = True
    a, b, rest = a[: len(a) - tail], b[: len(b) - tail], rest[: len(a) - tail]
    here = np.flatnonzero(np.isin(a, b))
    b = b[np.isin(b, a)]
    if len(here) == 0:
        return out
    if len(here) == 1:
        rest[here] = True
        return out
    half = len(here) // 2
    left, right = a[here[:half]], a[here[half:]]
    cut = int((_last_row(left, b) + _last_row(right[::-1], b[::-1])[::-1]).argmax())
    rest[here[:half]] = shared(left, b[:cut])
    rest[here[half:]] = shared(right, b[cut:])
    return out


def _differ(batches):
    """Task: which of the lines that may be a page's text are template lines, if any go."""
    for batch in batches:
        rows, found = [], []
        columns = (batch[c] for c in ("row", "own", "places", "open", "others"))
        for row, own, places, open_, others in zip(*columns, strict=True):
            own = np.array(own.as_py(), np.int64)
            places = np.array(places.as_py(), np.int64)
            gone = np.ones(len(places), bool)
            for other in others:
                if not gone.any():
                    break
                gone &= shared(own, np.array(other.as_py(), np.int64))[places]
            most = len(gone) - 1 if open_.as_py() else (len(gone) - 1) // 2
            if 0 < np.count_nonzero(gone) <= most:
                rows.append(row.as_py())
                found.append(gone.tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(found, pa.list_(pa.bool_()))],
            names=["row", "gone"],
        )


def _with_near(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """The pages that are aligned, with ``others``: the lines of the pages that they must share.

    On a page without a marked article, of the two pages beside it in the order of host and path the
    nearer one: with more leading path segments in common; of equal ones, the page before. Else the
    NEAR pages beside it, half of them before where the host has as many; with fewer pages, none.
    """
    order = ["host", "path", "url", "page_id", "row"]
    dealt = pages.where(F.col("host").isNotNull()).select(*order, "own", "places", "open")
    dealt = dealt.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = scratch.write(dealt, "dealt")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    # One row per partition is broadcast.
    numbered = dealt.join(F.broadcast(sizes), "part").select(
        (F.col("before") + place).alias("at"), "row", "host", "path", "own", "places", "open"
    )

    # Every page is lent to the blocks that its neighbours are in.
    blocks = F.sequence(*[F.floor((F.col("at") + side) / _BLOCK) for side in (-NEAR, NEAR)])
    lent = numbered.withColumn("block", F.explode(blocks))
    frame = Window.partitionBy("block").orderBy("at").rowsBetween(-NEAR, NEAR)
    beside = F.collect_list(F.struct("at", "host", "path", "own")).over(frame)
    lent = lent.withColumn("beside", beside).where(F.floor(F.col("at") / _BLOCK) == F.col("block"))
    of_host = F.filter(
        "beside", lambda p: (p["host"] == F.col("host")) & (p["at"] != F.col("at"))
    )
    lent = lent.withColumn("beside", of_host)

    def common(other):
        least = F.least(F.size("path"), F.size(other))
        return F.size(
            F.filter(
                F.sequence(F.lit(0), least),
                lambda k: F.slice("path", 1, k) == F.slice(other, F.lit(1), k),
            )
        )

    def side(step: int):
        return F.get(F.filter("beside", lambda p: p["at"] == F.col("at") + step), F.lit(0))

    lent = lent.withColumns({"previous": side(-1), "next": side(1)})
    after = F.coalesce(common(F.col("next.path")), F.lit(-1))
    nearest = F.when(after > F.coalesce(common(F.col("previous.path")), F.lit(-1)), F.col("next.own"))
    nearest = nearest.otherwise(F.col("previous.own"))
    n_before = F.size(F.filter("beside", lambda p: p["at"] < F.col("at")))
    first = F.greatest(
        F.lit(0), F.least(n_before - NEAR // 2, F.size("beside") - NEAR)
    )
    near = F.transform(F.slice("beside", first + 1, F.lit(NEAR)), lambda p: p["own"])
    others = F.when(F.col("open"), F.array_compact(F.array(nearest)))
    others = others.when(F.size("beside") >= NEAR, near).otherwise(F.array())
    lent = lent.withColumn("others", others).where(F.size("others") > 0)
    return lent.select("row", "own", "places", "open", "others")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (blocks joined by line feeds), n_chars.

    A null or empty page gives an empty text. A page without a host, or alone on its host, is not
    differenced, and neither is a marked article on a host of at most NEAR pages; nor are shared lines
    removed where nothing else, or less than half of a marked article, would remain. Rows that repeat
    give a row each. An empty table gives an empty result; other columns play no part.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    chosen = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")
    )
    id_type = chosen.schema["page_id"].dataType.simpleString()
    schema = (
        f"page_id {id_type}, url string, host string, path array<string>, every array<string>, "
        "places array<int>, open boolean"
    )
    read = chosen.mapInArrow(_read, schema).select(
        "page_id",
        "url",
        "host",
        "path",
        "places",
        "open",
        F.transform("every", lambda line: F.xxhash64(line)).alias("own"),
        F.transform("places", lambda place: F.get("every", place)).alias("lines"),
        F.monotonically_increasing_id().alias("row"),
    )
    read = scratch.write(read, "lines")
    # Few rows where articles are marked: written first, they are known to be, and no line moves.
    gone = _with_near(read, scratch).mapInArrow(_differ, "row long, gone array<boolean>")
    gone = scratch.write(gone, "gone")
    kept = F.filter("lines", lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    return (
        read.join(gone, "row", "left")
        .select("page_id", "url", F.array_join(kept, "\n").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )


@query("op3_html_extraction")
def op3(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
