"""The pipeline as a whole: odd rows and empty tables through all stages, and results that outlive later runs."""

import random

import corpus_pipeline

from .test_operators import WORDS, documents, frame


def tables(spark, path, rows, empty=False):
    docs = frame(spark, rows)
    docs = docs.where("false") if empty else docs
    docs.write.parquet(f"{path}/documents.parquet")
    r = random.Random(2)
    labels = [(i, r.randrange(2), int("hate" in (t or ""))) for i, t in rows if i is not None]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    (labels.where("false") if empty else labels).write.parquet(f"{path}/labels.parquet")
    items = spark.createDataFrame([(0, rows[1][1]), (1, None), (None, "")], "item_id long, text string")
    (items.where("false") if empty else items).write.parquet(f"{path}/benchmark.parquet")


def test_odd_rows_empty_tables_and_the_first_result_last(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, t) for i, t in documents() if i != 1] + [(500 + i, " ".join(["hate", "hate", *(r.choice(WORDS) for _ in range(30)), "hate"])) for i in range(30)]
    rows[1:1] = [(1, " ".join(f"item{k}" for k in range(60)))]
    rows += [(700, "before it " + rows[1][1] + " and after"), (None, None), (None, None), (None, ""), (5, rows[7][1]), (5, "another text under that number")]
    tables(spark, tmp_path / "some", rows)
    tables(spark, tmp_path / "none", rows, empty=True)
    first = corpus_pipeline.run(spark, str(tmp_path / "some"))
    at_once = sorted(map(tuple, first.collect()), key=str)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    again = spark.read.parquet(str(tmp_path / "some/documents.parquet"))
    corpus_pipeline.drop_toxic(spark, again, str(tmp_path / "some"))  # a new chain of stages
    assert sorted(map(tuple, first.collect()), key=str) == at_once
    kept = [x[0] for x in at_once]
    assert 1 not in kept and 700 not in kept  # hold a test item
    assert len([i for i in kept if i is not None and 500 <= i < 530]) < 5  # toxic
    assert len([i for i in (3, 60, 61) if i in kept]) == 1  # copies
    assert {0, 2, 4, 6} <= set(kept) and kept.count(5) >= 1


def test_stages_remove_only_what_was_read(spark, tmp_path):
    docs = frame(spark, documents())
    docs.write.parquet(str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    first = corpus_pipeline.cut_repeats(spark, old, "")
    items = spark.createDataFrame([(0, "a b c")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    corpus_pipeline.drop_contaminated(spark, old, str(tmp_path)).collect()  # the next stage, but on another table
    assert first.count() == docs.count()
