"""Small tables with every awkward row, and plain computations of what the operators return."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(n: int, seed: int = 0) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    a = prose(60, 1)
    rows = [
        (1, a, "en", "x"),
        (2, a.upper(), None, None),
        (2, a.upper(), None, None),
        (3, None, "en", "x"),
        (None, a, "de", "y"),
        (None, None, None, None),
        (4, "", "en", "x"),
        (5, " \n\t ", "en", "x"),
        (6, prose(40_000, 2), "en", "x"),
        (7, prose(40_000, 2) + " end", "en", "x"),
        (8, "one two", "en", "x"),
        (9, "One TWO", "en", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n", "row", "key", "d", "sid", "digest", "part", "root", "n_lines", "gone_lines"):
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    return docs


def jaccard_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """Per document its set size and component, by comparing all pairs."""
    sets = {}
    for k, text in texts.items():
        w = WORD.findall(lower(text or ""))
        whole = {tuple(w)} if w else set()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else whole
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (len(sets[k]), find(k)) for k in keys}


def edit_distance_inside(item: str, text: str) -> int:
    """Fewest edits that turn ``item`` into some part of ``text``."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)
