"""The stages of the pipeline on a small table, each against what it must keep."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, base = prose(40), prose(80)
    rows = [(i, prose(70), "big" if i < 100 else "small") for i in range(120)]
    junk = [(200 + i, prose(60).upper().replace(" ", "!! "), "big") for i in range(60)]
    copies = [(300, base, "big"), (301, base, "small"), (302, base.rsplit(" ", 2)[0], "big")]
    leaks = [(310, f"{prose(20)} {item} {prose(20)}", "big"), (311, f"{item} {prose(5)}", "small")]
    odd = [(320, None, "big"), (None, prose(50), None)]
    every = [(i, t, "en", s, len(t or "")) for i, t, s in [*rows, *junk, *copies, *leaks, *odd]]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _, _ in rows] + [(i, 0, 0) for i, _, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    clean = {i for i, _, _ in rows}
    assert set(kept[0]) >= clean | {300, 301, 302, 310, 311} and not set(kept[0]) & {i for i, _, _ in junk}
    assert sorted(set(kept[0]) - set(kept[1]), key=str) == [301, 302] and len(kept[1]) == len(kept[0]) - 2
    assert set(kept[1]) - set(kept[2]) == {310, 311} and len(kept[2]) == len(kept[1]) - 2
    assert set(kept[3]) <= set(kept[2]) and kept[3].count(119) + kept[3].count(110) >= 2
    assert sorted(map(str, kept[4])) == sorted(map(str, kept[3])) and docs.where("shard is null").count() == 0
