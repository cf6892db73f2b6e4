"""Nodes and edges: reach and labels, by repeated joins with a bounded depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.sources.shared import keep_table


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """edges: src, dst. (node, hops): every node within `depth` steps of a start, with the
    fewest steps. Each round keeps only nodes not met before, in a written table, so that
    a round reads the one before it instead of making it again."""
    seen = front = keep_table(starts.select(F.col("node"), F.lit(0).alias("hops")).distinct())
    for hop in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = keep_table(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def ancestors(spark, parents: DataFrame, depth: int = 20) -> DataFrame:
    """parents: child, parent. All (child, ancestor) pairs, by a recursive query."""
    return spark.sql(
        """with recursive up(child, ancestor, n) as (
          select child, parent, 1 from {parents}
          union all select u.child, p.parent, u.n + 1 from up u join {parents} p on u.ancestor = p.child where u.n < {depth}
        ) select child, ancestor, min(n) as steps from up group by child, ancestor""",
        parents=parents,
        depth=depth,
    )
