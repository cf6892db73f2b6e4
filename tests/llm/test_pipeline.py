import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodeframe.llm.shared import keep_table


def test_stages(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{source}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "dedup" in names[1] and "pack" in names[4]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = keep_table(stage(spark, docs, source))
        assert after.dtypes == first.dtypes, name
        assert 0 < after.count() <= docs.count()
        if name == "pii":
            assert after.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
            assert after.where("n_chars <> length(text)").count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, source)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, source).count() == packed.count()


CASES = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " ", "en", "a", 1), (None, "no id mail a@b.cd", "en", "a", 17), (4, "one two three four five six seven", "en", None, 33), (4, "one two three four five six seven", "en", None, 33), (5, "w " * 20_000, None, "b", 40_000)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_cases(spark, name, stage):
    """Null and empty texts, null ids, repeated rows, clashing names and an empty table."""
    extra = "toxic_score string, row_place int, text_key string, whole_text string"
    docs = spark.createDataFrame([(*x, "s", 1, "k", "t") for x in CASES], f"doc_id long, text string, lang string, source string, n_chars int, {extra}")
    got = stage(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    rows = got.collect()
    assert all((r.toxic_score, r.row_place, r.text_key, r.whole_text) == ("s", 1, "k", "t") for r in rows)
    ids = sorted((r.doc_id for r in rows), key=str)
    if name == "simhash_near_dedup":  # texts without words are copies of each other
        assert ids == [1, 4, 5, None]
    else:
        assert ids == sorted((x[0] for x in CASES), key=str)
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == []


def test_packing_cases(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.start == 0 for r in got) == len(CASES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").collect() == []
