"""Exact copies, near copies and repeated lines."""

import random

import pytest
from helpers import jaccard_components, lower, prose

from textquarry.llm.exact_dedup import exact_copies
from textquarry.llm.jaccard_join import near_copies, one_of_each
from textquarry.llm.line_dedup import without_later_copies


def test_exact_copies_of_awkward_rows(odd):
    rows = exact_copies(odd).collect()
    assert len(rows) == odd.count()
    kept = {r.text_sha256: r for r in rows if r.kept}
    assert len(kept) == len([r for r in rows if r.kept]) == len({r.text_sha256 for r in rows})
    texts = {r.doc_id: lower(r.text or "") for r in odd.collect() if r.doc_id is not None}
    for r in rows:
        same = [k for k, t in texts.items() if r.doc_id and t == texts[r.doc_id]]
        if r.doc_id is not None:
            assert r.keep_id == max(same)
    assert sorted(r.group_size for r in rows) == [1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4]


def test_exact_copies_heavy_and_light_agree(spark):
    rows = [(i, "Same" if i % 3 == 0 else f"t{i % 500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    few = {tuple(r) for r in exact_copies(docs, tracked=8).collect()}
    many = {tuple(r) for r in exact_copies(docs, tracked=4096).collect()}
    assert few == many and len(few) == 3000
    assert max(r[2] for r in few) == 1000


@pytest.mark.parametrize("operator", [exact_copies, near_copies, without_later_copies])
def test_empty_tables(odd, operator):
    assert operator(odd.where("false")).count() == 0


def test_near_copies_equal_all_pairs(spark):
    draw = random.Random(7)
    texts, k = {}, 0
    for group in range(12):
        base = prose(draw.choice([3, 5, 7, 12, 30, 80, 200]), group).split()
        for _ in range(draw.choice([1, 2, 6, 14])):
            own = list(base)
            for _ in range(draw.randrange(0, 1 + len(own) // 8)):
                own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
            texts[k] = " ".join(own)
            k += 1
    texts |= {k: None, k + 1: "", k + 2: "  ", k + 3: "One two", k + 4: "one  TWO"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies(docs).collect()}
    assert got == jaccard_components(texts)


def test_near_copies_beside_fragments(spark):
    letters = "a b c d e f g h".split()
    texts = {k: " ".join(letters[:n]) for k, n in enumerate((8, 7, 6))}
    draw = random.Random(11)
    for group in range(8):
        base = prose(draw.choice([12, 30, 80, 200]), 50 + group).split()
        other = [*base[:-1], f"y{group}"]  # one word of the text differs
        shares = [draw.uniform(0.3, 0.74) for _ in range(4)]
        for own in (base, other, *[base[: int(s * len(base))] for s in shares]):
            texts[len(texts)] = " ".join(own)
        texts[len(texts)] = " ".join(base[len(base) // 2 :])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies(docs).collect()}
    assert got == jaccard_components(texts)
    assert got[0][1] == got[1][1] != got[2][1]


def test_near_copies_of_awkward_rows(odd):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in near_copies(odd).collect()}
    assert {(1, 56, 1), (2, 56, 1), (None, 56, 1), (3, 0, 3), (None, 0, None), (5, 0, 5)} <= rows
    assert {(6, 39996, 6), (7, 39997, 6), (8, 1, 8), (9, 1, 8)} <= rows
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 8]


def test_lines_of_awkward_rows(odd):
    rows = without_later_copies(odd)
    assert set(odd.columns) <= set(rows.columns)
    got = {(r.doc_id, len(r.text or ""), r.n_lines, r.n_removed) for r in rows.collect()}
    a = prose(60, 1)
    assert {(1, len(a), 1, 0), (None, 0, 1, 1), (3, 0, 0, 0), (5, 4, 0, 0)} <= got
    assert (2, len(a), 1, 0) in got  # other case, and its repeated row is the same document
    assert rows.count() == odd.count()


def test_lines_of_runs(spark):
    run = [prose(20, s) for s in (1, 2, 3)]
    texts = [
        (1, "\n".join(["start", *run, "end"])),
        (2, "\n".join(["other", run[0], " ", run[1], run[2], "tail"])),  # a blank line inside
        (3, "\n".join([run[0], run[1]])),  # 40 words
        (4, "\n".join([run[1], run[2], "x", run[1], run[2], *run])),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in without_later_copies(docs).collect()}
    assert got[1] == (texts[0][1], 0) and got[3] == (texts[2][1], 0)
    assert got[2] == ("other\n \ntail", 3)
    assert got[4] == ("\n".join([run[1], run[2], "x", run[1], run[2]]), 3)


def test_sketches_bound_what_sets_share():
    import numpy as np

    from textquarry.llm.jaccard_join import most_shared, sketch

    draw = np.random.default_rng(3)
    passed = 0
    for _ in range(300):
        na, nb = (int(x) for x in draw.integers(1, 900, 2))
        shared = int(draw.integers(0, min(na, nb) + 1))
        pool = draw.integers(0, 1 << 63, na + nb - shared, dtype=np.uint64)
        a, b = pool[:na], pool[na - shared :]
        bound = most_shared(sketch(a), na, sketch(b), nb)
        assert shared <= bound <= min(na, nb)
        assert bound == most_shared(sketch(b), nb, sketch(a), na)
        passed += 175 * bound >= 75 * (na + nb) and 175 * shared < 60 * (na + nb)
    assert passed < 15  # pairs far from similar seldom pass


def test_marks_never_drop_a_similar_pair(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from textquarry.llm.jaccard_join import _MARKED, _marks_meet, marks

    draw = np.random.default_rng(8)
    rows, similar, made = [], [], []
    for k in range(300):
        na, nb = (int(v) for v in draw.integers(1, 400, 2))
        shared = min(na, nb) - int(draw.integers(0, min(na, nb) + 1)) // (1 + k % 4)
        pool = draw.integers(0, 1 << 63, na + nb - shared, dtype=np.uint64)
        a, b = pool[:na], pool[na - shared :]
        rows.append((k, na, nb, *marks(a).tolist(), *marks(b).tolist()))
        if 175 * shared >= 75 * (na + nb):
            similar.append(k)
    names = ["k", "na", "nb", *[f"x{m}" for m in _MARKED], *[f"y{m}" for m in _MARKED]]
    df = spark.createDataFrame(rows, names)
    made = {r.k for r in df.where(_marks_meet(F.col("na"), F.col("nb"))).collect()}
    assert set(similar) <= made and 10 < len(similar) and len(made) < 200


def test_python_gets_a_bounded_number_of_bytes_at_a_time(spark):
    import pyarrow as pa

    from textquarry.llm.tables import prepare

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    wide = prepare(spark).range(6000).selectExpr("repeat('x', 10000) AS text").coalesce(1)
    found = [r.size for r in wide.mapInArrow(sizes, "size long").collect()]
    assert sum(found) >= 60_000_000 and max(found) < 10 << 20


def test_filter_holds_its_slots_and_few_others(spark):
    import numpy as np

    from textquarry.llm.filters import FILTER_BITS, bits_of, has

    inside = np.random.default_rng(1).integers(0, FILTER_BITS, 3000)
    inside = np.concatenate([inside, [0, 7, 8, FILTER_BITS - 1]])
    bits = bits_of(spark.createDataFrame([(int(x),) for x in inside], "slot long"))
    assert bits.nbytes == FILTER_BITS // 8 and has(bits, inside).all()
    assert int(np.bitwise_count(bits).sum()) == len(set(inside.tolist()))
