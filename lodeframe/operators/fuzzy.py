"""Joins of texts by likeness, as equalities of rare tokens.

Each text is a set of tokens. In one order of all tokens, the rarest first, two sets whose
Jaccard similarity reaches t share a token among the first n - t * n + 1 of each (prefix
filtering). Texts therefore meet under rare tokens only, the sizes rule out most of them, and
an exact measure decides. Texts are made distinct first; null texts and texts without tokens
match nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.classify import indel_ratio
from lodeframe.functions.scalars import trigrams

SLACK = 1e-9


def characters(c: Column) -> Column:
    """Each character with how often it occurred before: shared ones bound a common
    subsequence from above."""
    at = lambda i: F.substr(c, i, F.lit(1))
    before = lambda i: F.substr(c, F.lit(1), i - 1)
    seen = lambda i: F.length(before(i)) - F.length(F.replace(before(i), at(i), F.lit("")))
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat_ws(":", at(i), seen(i)))).otherwise(F.array())


def token_pairs(left: DataFrame, right: DataFrame, a: str, b: str, tokens, threshold: float) -> DataFrame:
    """Distinct texts (a, b) whose token sets are alike by `threshold` or more, and similarity."""
    sides = []
    for df, name in ((left, a), (right, b)):
        sides.append(df.select(F.col(name).cast("string").alias("t")).where("t is not null").distinct().withColumn("x", F.array_distinct(tokens(F.col("t")))).withColumn("n", F.size("x")).where("n > 0"))
    common = sides[0].unionByName(sides[1]).select(F.explode("x").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("t").orderBy("df", "token")
    keys = []
    for side in sides:
        ranked = side.select("t", "n", F.explode("x").alias("token")).join(common, "token").withColumn("rank", F.row_number().over(rarest))
        keys.append(ranked.where(F.col("rank") <= F.col("n") - F.ceil(threshold * F.col("n") - SLACK) + 1).select("t", "n", "token"))
    met = keys[0].toDF("ta", "na", "token").join(keys[1].toDF("tb", "nb", "token"), "token")
    met = met.where((F.col("nb") >= threshold * F.col("na") - SLACK) & (F.col("na") >= threshold * F.col("nb") - SLACK)).select("ta", "tb").distinct()
    both = met.join(sides[0].select(F.col("t").alias("ta"), F.col("x").alias("xa")), "ta").join(sides[1].select(F.col("t").alias("tb"), F.col("x").alias("xb")), "tb")
    shared = F.size(F.array_intersect("xa", "xb"))
    return both.select(F.col("ta").alias(a), F.col("tb").alias(b), (shared / (F.size("xa") + F.size("xb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold - SLACK)


def trigram_pairs(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """a, b, similarity (shared over all distinct trigrams of both texts)."""
    return token_pairs(left, right, a, b, trigrams, threshold)


def ratio_pairs(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """a, b, score: 100 times twice the longest common subsequence over both lengths. Texts
    that reach a ratio share at least as many characters, whose sets are alike by r / (2 - r)."""
    share = threshold / 100

    def exact(batches):
        for rb in batches:
            found = [(x, y, indel_ratio(x, y)) for x, y in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True)]
            found = [f for f in found if f[2] >= threshold - SLACK]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], [a, b, "score"])

    pairs = token_pairs(left, right, a, b, characters, share / (2 - share))
    return pairs.select(a, b).mapInArrow(exact, f"{a} string, {b} string, score double")


def best_of(pairs: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first of each `by` in this order, which should end in a unique column."""
    return pairs.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__rank = 1").drop("__rank")
