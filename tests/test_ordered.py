import random

from pyspark.sql import functions as F

from textquarry.operators.ordered import number_rows, prefix_sum, with_lookback


def hot_rows(seed=3):
    """Key 0 holds most rows; orders have gaps and start below zero."""
    rng = random.Random(seed)
    rows = []
    for key, n in ((0, 400), (1, 7), (2, 1), (3, 60)):
        for order in rng.sample(range(-50, 5_000), n):
            rows.append((key, order, rng.randrange(5)))
    rng.shuffle(rows)
    return rows


def test_prefix_sum_on_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, o bigint, v int").repartition(5)
    out = prefix_sum(df, "o", F.col("v"), "s", ["k"], block=16)
    want = {}
    for key in range(4):
        total = 0
        for _, order, value in sorted(r for r in rows if r[0] == key):
            want[key, order] = total
            total += value
    assert {(r.k, r.o): r.s for r in out.collect()} == want


def test_prefix_sum_without_keys_keeps_wide_integers(spark):
    base = 2**60
    df = spark.createDataFrame([(base + i,) for i in range(50)], "o bigint")
    out = number_rows(df, "o", "n", block=3)
    assert sorted((r.o - base, r.n) for r in out.collect()) == [(i, i + 1) for i in range(50)]


def test_lookback_across_blocks(spark):
    rows = hot_rows(5)
    df = spark.createDataFrame(rows, "k int, o bigint, v int")
    placed = number_rows(df, "o", "p", ["k"], block=64).withColumn("p", F.col("p") - 1)
    out = with_lookback(placed, "p", 6, {"seen": F.collect_list("o")}, ["k"], block=8)
    got = {(r.k, r.o): r.seen for r in out.collect()}
    want = {}
    for key in range(4):
        orders = sorted(o for k, o, _ in rows if k == key)
        for i, order in enumerate(orders):
            want[key, order] = orders[max(0, i - 6) : i]
    assert got == want


def test_lookback_reaches_over_several_blocks(spark):
    df = spark.range(60).withColumnRenamed("id", "p")
    out = with_lookback(df, "p", 8, {"seen": F.collect_list("p")}, block=3)
    assert {r.p: r.seen for r in out.collect()} == {p: list(range(max(0, p - 8), p)) for p in range(60)}


def test_blocks_follow_the_rows_not_the_gaps(spark):
    ids = spark.range(2_000).select(F.xxhash64("id").alias("o"))
    out = prefix_sum(ids, "o", 1, "n", block=100, keep_block=True)
    assert out.select("_block").distinct().count() <= 2_000 / 100 + 2
    rows = sorted((r.o, r.n) for r in out.collect())
    assert [n for _, n in rows] == list(range(2_000))


def test_orders_that_restart_in_every_group_share_blocks(spark):
    rows = spark.range(200_000).selectExpr("id % 10000 AS k", "id div 10000 AS o")
    out = prefix_sum(rows, "o", 1, "n", ["k"], keep_block=True)
    assert out.where("n <> o").isEmpty()
    blocks = [r["count"] for r in out.groupBy("_block").count().collect()]
    assert 10 <= len(blocks) <= 30 and max(blocks) < 15_000


def test_an_outlying_order_does_not_fill_a_block(spark):
    outlier = "CASE WHEN id = 199999 THEN 1000000000000000 ELSE id END AS o"
    out = prefix_sum(spark.range(200_000).selectExpr(outlier), "o", 1, "n", keep_block=True)
    got = out.selectExpr("CASE WHEN o > 199999 THEN 199999 ELSE o END AS o", "n", "_block")
    assert got.where("n <> o").isEmpty()
    blocks = [r["count"] for r in got.groupBy("_block").count().collect()]
    assert 10 <= len(blocks) <= 30 and max(blocks) < 15_000


def test_blocks_of_groups_of_many_sizes(spark):
    rng = random.Random(11)
    rows = [(f"g{g}", f"{g % 3}", order, rng.randrange(-3, 9))
            for g in range(40) for order in rng.sample(range(10**12), rng.choice([1, 2, 30, 500]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, l string, o bigint, v int").repartition(6)
    out = prefix_sum(df, "o", F.col("v"), "s", ["k", "l"], block=25, keep_block=True)
    sums, ends = {}, {}
    for k, _, order, value in sorted(rows):
        sums[k, order] = ends.get(k, 0)
        ends[k] = sums[k, order] + value
    got = out.collect()
    assert {(r.k, r.o): r.s for r in got} == sums
    last = {}
    for r in got:
        last[r.k, r._block] = r._block_end
    for k, end in ends.items():
        assert last[k, max(b for g, b in last if g == k)] == end


def test_positions_need_only_sort(spark):
    df = spark.range(900).selectExpr("id % 2 AS k", "struct(id div 100 AS a, -id AS b) AS o", "id")
    out = number_rows(df, "o", "n", ["k"], block=40)
    want = {}
    for k in (0, 1):
        for n, i in enumerate(sorted(range(k, 900, 2), key=lambda i: (i // 100, -i)), 1):
            want[i] = n
    assert {r.id: r.n for r in out.collect()} == want
