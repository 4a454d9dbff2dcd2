"""Vector codes, nearest neighbours and ranked search against plain computations."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from textquarry.llm import nearest_neighbours, ranked_search, vector_codes

NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows, kind="float"):
    rows = [(*r, "clash", "clash") for r in rows]
    return spark.createDataFrame(
        rows, f"vec_id long, embedding array<{kind}>, label int, code string, rank string"
    )


def plain_codes(rows, scale=256, parts=16, entries=64, rounds=2):
    """The contract, number by number."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))

    def whole(v):
        v = [math.floor(scale * x) if abs(x) < 2**52 else int(x) * scale for x in v]
        v += [0] * (width * parts - len(v))
        return [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]

    cut = [whole(r[1]) for r in kept]
    first = sorted((r[0], list(r[1]), i) for i, r in enumerate(kept) if r[0] is not None)[:entries]
    books = [[cut[i][p] for _, _, i in first] for p in range(parts)]

    def near(part, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[part]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(p, v[p])[1], []).append(v[p])
            for e, vs in groups.items():
                books[p][e] = tuple(sum(c) // len(vs) for c in zip(*vs, strict=True))
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    text = ",".join(str(x) for b in books for e in b for x in e)
    sha, top = hashlib.sha256(text.encode()).hexdigest(), 2**63 - 1
    return sorted(
        (repr(r[0]), "".join(f"{e:02x}" for _, e in f), min(x, top), min(labels[r[2]], top), sha)
        for r, f, x in zip(kept, found, errors, strict=True)
    )


def codes(df):
    return sorted((repr(r[0]), *r[1:]) for r in vector_codes.vector_codes(df).collect())


@pytest.mark.parametrize("huge", [1.0, 2.0**21, 3e30])
def test_codes_equal_plain_ones(spark, huge):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(32)], i % 3 or None) for i in range(150)]
    rows = [(i, np.float32(v).tolist(), c) for i, v, c in rows]
    rows += [rows[7], rows[7], (5, rows[9][1], 1), (None, rows[11][1], 2)]  # repeated rows and ids
    rows += [(900, [huge] * 32, 1), (901, [-huge] + [0.5] * 31, None), (-1, [0.0, huge] * 16, 2)]
    odd = [(700, None, 1), (701, [None] + [1.0] * 31, 1), (702, [NAN] * 32, 1), (703, [INF] * 32, 1)]
    got = codes(vectors_of(spark, [*rows, *odd]).repartition(5))
    assert got == plain_codes([(i, np.float32(v).tolist(), c) for i, v, c in rows])


def test_codes_of_few_and_uneven_vectors(spark):
    rows = [(1, [0.5] * 20, 1), (2, [1.0] * 7, 1), (3, [], None), (4, [0.5] * 20, None)]
    assert codes(vectors_of(spark, rows)) == plain_codes(rows)
    empty = vectors_of(spark, rows).where("false")
    assert vector_codes.vector_codes(empty).count() == 0
    assert vector_codes.vector_codes(vectors_of(spark, [(None, [1.0], 1)])).count() == 0


def test_products_are_exact_for_long_numbers():
    draw = np.random.default_rng(1)
    for bits, width in ((3, 1), (24, 4), (30, 4), (29, 64)):
        a, b = (draw.integers(-(1 << bits), 1 << bits, (9, width)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert vector_codes.exact_products(a, b).tolist() == want
        at, least = vector_codes.first_nearest(a, np.concatenate([b, b]))
        gaps = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert at.tolist() == [g.index(min(g)) for g in gaps]
        assert least.tolist() == [min(g) for g in gaps]


def plain_nearest(rows, queries, k):
    """Every pair, as the contract has it; several vectors of one id count by their nearest."""
    def kept(r):
        v = r[1]
        return r[0] is not None and v is not None and all(
            x is not None and math.isfinite(x) for x in v) and any(v)

    rows, queries = [r for r in rows if kept(r)], [r for r in queries if kept(r)]
    width = max(len(r[1]) for r in rows)
    best = {}
    for q in queries:
        for r in rows:
            if q[0] != r[0]:
                a, b = (np.array(v[1] + [0.0] * (width - len(v[1]))) for v in (q, r))
                s = [0.0, 0.0, 0.0]
                for x, y in zip(a, b, strict=True):
                    s = [s[0] + x * y, s[1] + x * x, s[2] + y * y]
                score = s[0] / (math.sqrt(s[1]) * math.sqrt(s[2]))
                own = best.setdefault(q[0], {})
                own[r[0]] = max(own.get(r[0], -9), score)
    return sorted(
        (q, n, v, s) for q, own in best.items()
        for n, (s, v) in enumerate(((-s, v) for s, v in sorted((-s, v) for v, s in own.items())[:k]), 1)
        for s in [-s * -1.0]
    )


@pytest.mark.parametrize("size", [3, 60])
def test_nearest_equal_all_pairs(spark, size):
    draw = random.Random(size)
    rows = [(i, [draw.gauss(0, 1) for _ in range(size)], 1) for i in range(300)]
    base = rows[0][1]
    rows += [(1000 + i, base, 1) for i in range(120)]  # a hot vector
    rows += [(2000 + i, [x * (1 + 1e-9 * draw.random()) for x in base], 1) for i in range(120)]
    rows += [rows[5], rows[50], (50, rows[51][1], 1), (None, base, 1), (3000, [0.0] * size, 1)]
    rows += [(3050, None, 1), (3100, [NAN] * size, 1), (3150, [None] * size, 1), (3200, [INF] * size, 1)]
    rows += [(3250, [1e-30] * size, 1), (3300, [2e30] * size, 1), (3350, [1.0], 1)]
    df = vectors_of(spark, rows, "double").repartition(6)
    got = nearest_neighbours.nearest(df, df.where("vec_id % 50 = 0"))
    got = sorted(tuple(r) for r in got.collect())
    want = plain_nearest(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-12)


def test_nearest_of_few_vectors(spark):
    df = vectors_of(spark, [(50, [1.0, 0.0], 1), (51, [1.0, 1.0], 1)])
    got = nearest_neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(50, 1, 51)]
    assert nearest_neighbours.nearest(df.where("false"), df).count() == 0
    assert nearest_neighbours.nearest(df, df.where("false")).count() == 0


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(16)], 1) for i in range(400)]
    df = vectors_of(spark, rows, "double")
    queries = df.where("vec_id % 4 = 0")
    whole = sorted(nearest_neighbours.nearest(df, queries).collect())
    monkeypatch.setattr(nearest_neighbours, "BLOCK_BYTES", 4096)
    assert sorted(nearest_neighbours.nearest(df, queries).collect()) == whole


def test_bounds_hold_and_drop_most_pairs():
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(500, 64))
    own = nearest_neighbours.Vectors.of(np.arange(500), rows)
    low, high = nearest_neighbours.cosine_bounds(own, own)
    exact = own.scaled @ own.scaled.T / np.outer(own.norm, own.norm)
    assert (low <= exact).all() and (exact <= high).all() and (high - low).max() < 0.1
    best = nearest_neighbours.Nearest(list(range(10)), 5)
    queries = nearest_neighbours._each(np.arange(10), rows[:10])
    assert nearest_neighbours.search_tile(best, 0, queries, own) < 10 * 40


TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_ranks(docs, items, k=20):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, t in held:
            m = 100 - 25 + (25 * len(t) * n) // total
            s = 0
            for x in terms(text):
                if x in t:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
                    tf = t.count(x)
                    s += w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(repr(item), i, repr(None if no else d), -s)
                for i, (s, no, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def ranks(docs, items, **options):
    rows = ranked_search.ranked(docs, items, **options).collect()
    return sorted((repr(r[0]), r[1], repr(r[2]), r[3]) for r in rows)


def drawn_texts(seed, n, words=40):
    draw = random.Random(seed)
    own = [f"w{i}" for i in range(words)] + ["Été", "x1Y", "中文"]
    return [" ".join(own[int(len(own) * draw.random() ** 3)] for _ in range(draw.randrange(1, 60)))
            for _ in range(n)]


@pytest.fixture(scope="module")
def corpus_and_items(spark):
    docs = [*enumerate(drawn_texts(1, 400)), (400, None), (401, ""), (402, " .,;-\n"), (403, "W1 w1-w2_W3!")]
    docs += [docs[3], docs[3], (None, docs[4][1]), (500, "w5 " * 400_000 + "w39"), (501, "é" * 2_500_000)]
    items = [*enumerate(drawn_texts(2, 25)), (90, None), (91, ""), (92, "nowhere"), (None, "w1 w2 w2 w9")]
    items += [items[2], (3, "w7 w7 w7 w8")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, "c", "c") for r in docs], "doc_id long, text string, score string, item string")
    i = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, doc string")
    return d.repartition(5), i


def test_ranks_equal_plain_ones(spark, corpus_and_items):
    docs, items = corpus_and_items
    got = ranks(*frames(spark, docs, items))
    want = plain_ranks(docs, items)
    assert got == want


def test_blocks_and_segments_change_nothing(spark, corpus_and_items, monkeypatch):
    docs, items = corpus_and_items
    monkeypatch.setattr(ranked_search, "BLOCK_CHARS", 600)
    monkeypatch.setattr(ranked_search, "PAIRED", 30)
    numbers = [len(n) for n, _ in ranked_search._blocks(
        frames(spark, docs, items)[1].selectExpr("item_id AS id", "text"))]
    assert len(numbers) > 3
    assert ranks(*frames(spark, docs, items), segment_docs=17) == plain_ranks(docs, items)


def test_ranks_of_empty_tables(spark, corpus_and_items):
    docs, items = frames(spark, *corpus_and_items)
    assert ranks(docs.where("false"), items) == []
    assert ranks(docs, items.where("false")) == []


def test_pair_bounds_score_fewer_documents():
    texts = drawn_texts(4, 2000, 60)
    numbers = {t: i for i, t in enumerate(sorted({x for t in texts for x in terms(t)}))}
    builder = ranked_search._Builder({t.encode(): i for t, i in numbers.items()})
    for i, t in enumerate(texts):
        builder.add(i, t.encode())
    n, total, docs, lengths, used, ends, positions, counts = builder.segment()
    df = np.diff(ends, prepend=0)
    every = np.zeros(len(numbers), np.int64)
    every[used] = df
    statistics = ranked_search.Statistics.of(n, total, every)
    impacts = statistics.impacts(np.repeat(used, df), counts, np.array(lengths)[positions])
    lists = ranked_search._slices(used, ends)
    pairs = np.array([(a, b) for a in used.tolist() for b in used.tolist() if a < b])
    met, joint, shared = ranked_search.pair_lists(len(docs), lists, positions, impacts, pairs)
    peaks = {t: int(impacts[s].max()) for t, s in lists.items()}
    segment = ranked_search.Segment(
        docs, lists, positions, impacts, peaks,
        dict(zip(met, joint, strict=True)), dict(zip(met, shared, strict=True)),
    )
    scored = [0, 0]
    for seed in range(30):
        draw = random.Random(seed)
        own = draw.sample(sorted(lists), 5)
        item = ranked_search.Item(0, np.array(own), np.array([1, 2, 1, 1, 3]))
        at, all_scores, _ = ranked_search.search_segment(segment, item, 1)
        least = sorted(all_scores.tolist())[-20:][0]
        want = sorted((s, p) for s, p in zip(all_scores.tolist(), at.tolist(), strict=True) if s >= least)
        for way in (False, True):
            at, scores, n_scored = ranked_search.search_segment(segment, item, least, way)
            assert sorted(zip(scores.tolist(), at.tolist(), strict=True)) == want
            scored[way] += n_scored
    assert scored[True] < 0.95 * scored[False]
