"""Connected components of links by repeated minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.shared import drop_table, keep_table


def components(links: DataFrame) -> DataFrame:
    """links: a, b. (node, component) of every node with a link; component: the smallest
    node it reaches. Each round joins every link to the smallest label next to it, then
    follows labels to their own label; the rounds are logarithmic in a chain's length."""
    both = keep_table(links.selectExpr("a", "b").union(links.selectExpr("b", "a")))
    labels = keep_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.selectExpr("node as b", "label as seen"), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        moved = labels.join(near.selectExpr("a as node", "seen"), "node", "left").selectExpr("node", "label as old", "least(label, seen) as label")
        # hooking: the smallest label seen next to any member goes to that member's old label too
        hooked = moved.groupBy("old").agg(F.min("label").alias("root")).withColumnRenamed("old", "node")
        best = moved.join(hooked.withColumnRenamed("root", "mine"), "node", "left").join(hooked.selectExpr("node as old", "root as theirs"), "old", "left").selectExpr("node", "old", "least(label, mine, theirs) as label")
        after = keep_table(best)
        drop_table(labels)
        if after.where("label <> old").limit(1).count() == 0:
            drop_table(both)
            return after.selectExpr("node", "label as component")
        labels = after.select("node", "label")
