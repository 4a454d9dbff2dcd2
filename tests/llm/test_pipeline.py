"""Every stage of the pipeline on a corpus with planted cases, against what it must keep."""

from helpers import prose

import corpus_pipeline
from textquarry.llm.packing import packed


def test_stages(spark, tmp_path):
    english = [f"the cat and the dog went to town {i} times with the hat" for i in range(9)]
    run = prose(60, 77)
    item = prose(30, 500)
    rows = [(i, f"{prose(80, i)}\n{english[i % 9]}", "en", "s", 5) for i in range(20)]
    rows += [
        (20, f"{prose(90, 30)}\n{run}", "en", "s", 5),
        (21, f"{prose(90, 31)}\n{run}", "en", "s", 5),
        (22, f"{prose(80, 3)} extra\n{english[3]}", "en", "s", 5),  # near copy of 3
        (23, f"{prose(50, 40)} {item.upper()}!", "en", "s", 5),
        (24, "12345 67890", "en", "s", 5),  # no letters
        (25, None, None, None, None),
        (26, f"{prose(80, 4)}\n{english[4]}", "en", "s", 5),  # copy of 4
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now, after = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after.append({r.doc_id: r for r in now.collect()})
    everything = set(range(27))
    assert set(after[0]) == everything - {24, 25}
    assert set(after[1]) == set(after[0]) - {26}
    assert after[1][21].text == prose(90, 31) and after[1][21].n_chars == len(after[1][21].text)
    assert after[1][20].n_chars == 5
    assert set(after[2]) == set(after[1]) - {22}
    assert set(after[3]) == set(after[2]) - {23}
    whole = {tuple(r)[:5] for r in packed(now).collect()}
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == whole
    assert corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
