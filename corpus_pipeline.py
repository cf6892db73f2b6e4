"""A corpus pipeline over `documents`: toxic documents go, one of each group of near copies
stays, documents with benchmark passages go, personal data is masked, and what is left is
packed into sequences. Part of the subpackage lodeframe.llm.

In every stage: a null text is as empty; rows with a null id stay (but are not packed apart
from others); empty and very long texts are handled whole; an empty table gives an empty
table; further columns stay, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import op1_toxicity, op2_packing, op3_pii, op5_simhash, op8_decontam
from lodeframe.llm.shared import drop_table, keep_table, spare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5. The model is trained on the labelled ones. Repeated
    rows share their fate; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = op1_toxicity.fit(docs, labels, F.lit(True))
    score = spare("toxic_score", docs)
    return op1_toxicity.score_texts(docs, model, name=score).where(F.col(score).isNull() | (F.col(score) < 0.5)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group with a similarity of 0.8 or more in five-word shingles: that with
    the smallest id, and of rows that share it, by text. Different texts of one id are
    different documents; texts without words are copies of each other."""
    return op5_simhash.one_of_each(docs, op5_simhash.similar_documents(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Rows of one id share their fate."""
    return op8_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked, n_chars counted anew (null for a null text)."""
    kind = docs.schema["n_chars"].dataType
    return op3_pii.redact(docs).withColumn("n_chars", F.length("text").cast(kind))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; each of repeated rows has its
    own place."""
    return op2_packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: SQL can express neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, keep_table(stage(spark, docs, sf_dir))
        drop_table(before)  # but for the input, which isn't such a table
    return STAGES[-1][1](spark, docs, sf_dir)
