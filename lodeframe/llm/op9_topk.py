"""Exact top-k search by tiled matrix products.

Vectors become integers, floor(scale * x). Queries are dealt into groups and candidates
into shards; each tile, a group against a shard, is one matrix product in one task, which
keeps the k best of the shard for each query. Top lists of tiles merge in two levels, first
over runs of shards, then over all, each a ranked window whose limit Spark also applies
before the shuffle. A query's rows are never together but for k per tile.

Rows whose vector is null or holds null or non-finite components take no part, nor do rows
with a null id. Vectors of different lengths meet as if padded with zeros. Rows that share
a query's id are its own and not its candidates. Ties go to the smaller id. Repeated query
ids give one list. Very long vectors: a tile holds as many numbers as its rows have. Extra
columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries of a group, and candidates of a shard on average at most: what a task holds at
#: once. Each query travels to every shard and each candidate to every group, so these are large.
GROUP_ROWS, SHARD_ROWS = 65_536, 65_536
#: Scores of a product are at most so many at once.
SCORES = 1 << 23
_LEAST = np.iinfo(np.int64).min


def integers(column: pa.ChunkedArray, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) as doubles, each vector padded to `width`."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of_tile(query_ids, queries, ids, vectors, k: int):
    """(query, id, score) of the k best of each query, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    out = []
    step = max(1, SCORES // max(1, len(ids)))
    for a in range(0, len(query_ids), step):
        scores = products(queries[a : a + step], vectors)
        scores[query_ids[a : a + step, None] == ids[None, :]] = _LEAST
        if len(ids) > k:
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            row, col = np.nonzero((scores >= least[:, None]) & (scores > _LEAST))
        else:
            row, col = np.nonzero(scores > _LEAST)
        value = scores[row, col]
        sort = np.lexsort((col, -value, row))
        row, col, value = row[sort], col[sort], value[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        out.append((query_ids[a + row[rank < k]], ids[col[rank < k]], value[rank < k]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: a condition on id_col."""
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    every = vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    sizes = every.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    groups = max(1, math.ceil(sizes["q"] / GROUP_ROWS))
    shards = max(1, math.ceil(sizes["n"] / SHARD_ROWS), int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = sizes["width"]
    among = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = every.where("is_query").select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), among(shards).alias("s"))
    right = every.select(F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), among(groups).alias("g"), F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(shards)).cast("int").alias("s"))

    def tile(key, queries, candidates):
        if not queries.num_rows or not candidates.num_rows:
            found = [np.zeros(0, np.int64)] * 3
        else:
            ids, first = np.unique(queries["vec_id"].to_numpy(), return_index=True)
            found = best_of_tile(ids, integers(queries["v"], scale, width)[first], candidates["c_id"].to_numpy(), integers(candidates["c_v"], scale, width), k)
        return pa.table({"s": pa.array(np.full(len(found[0]), key[1].as_py()), pa.int32()), "query_id": found[0], "vec_id": found[1], "score": found[2]})

    lists = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(tile, "s int, query_id long, vec_id long, score long")
    step = max(2, math.isqrt(shards))
    for branch in ([F.floor(F.col("s") / step)], []):
        ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *branch).orderBy(F.desc("score"), "vec_id")))
        lists = ranked.where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as a
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(range(1, 1 + len(q.a)), lambda i: q.a[i] * c.a[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
