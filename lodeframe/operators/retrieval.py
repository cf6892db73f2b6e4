"""Chunking, ranking, fusion and selection of evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.sources.shared import keep_table


def chunks(docs: DataFrame, text: str, size: int = 1500, overlap: int = 200, prefix: int = 0, keep_stepping: bool = True) -> DataFrame:
    """Windows of a text: `size` characters less a prefix, stepping by the rest of the
    overlap, at least 100. keep_stepping goes on to the end of the text, so the last window
    may lie inside the one before; without it windows stop once one reaches the end."""
    width = max(size - prefix, 100)
    step = max(width - overlap, 100)
    n = F.length(text)
    last = F.greatest(n - 1, F.lit(0)) if keep_stepping else F.greatest(F.ceil((n - width) / step) * step, F.lit(0)).cast("int")
    starts = F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda s: s < n)
    made = docs.select("*", F.posexplode(starts).alias("chunk", "start"))
    return made.withColumn("chunk_text", F.substr(F.col(text), F.col("start") + 1, F.lit(width)))


def parents(chunked: DataFrame, key: str, group: int) -> DataFrame:
    """Groups of consecutive chunks with their joined text."""
    parent = F.floor(F.col("chunk") / group).cast("int")
    made = chunked.groupBy(key, parent.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("chunk", "chunk_text"))).alias("c"))
    return made.select(key, "parent", F.size("c").alias("children"), F.array_join(F.transform("c", lambda x: x["chunk_text"]), "\n").alias("parent_text"))


def quality(text: Column, stopwords: list[str]) -> tuple[Column, Column]:
    """Distinct words, and the share of words that are stopwords."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    return F.size(F.array_distinct(words)), F.size(F.filter(words, lambda w: w.isin(stopwords))) / F.nullif(F.size(words), F.lit(0))


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Term counts by document."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def impacts(docs: DataFrame, asked: DataFrame, key: str, text: str, k1: float, b: float) -> DataFrame:
    """term, doc_id, part: what a term of the queries adds to a document's BM25 score."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = docs.select(F.col(key).cast("long").alias("doc_id"), words.alias("words"))
    wanted = asked.select("term").unionByName(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
    # the empty term stands for the document, so that one pass over the texts also counts them
    found = split.select("doc_id", F.size("words").alias("dl"), F.explode(F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    found = keep_table(found.join(wanted, "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf")))
    row = found.where("term = ''").agg(F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("dl")).alias("words"), F.sum(F.when(F.col("dl").isNotNull(), F.col("tf"))).alias("texts")).first()  # three numbers
    n, mean = row["n"] or 0, (row["words"] or 0) / (row["texts"] or 1) or 1.0
    found = found.where("term <> ''")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    return found.join(df, "term").select("term", "doc_id", part.alias("part"))


def best_sums(starts: np.ndarray, docs: np.ndarray, parts: np.ndarray, lists: np.ndarray, most: np.ndarray, count: int, k: int, floor: float, slack: float, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers below `count`) and sums of those that may be among the k largest, at
    least `floor`. lists: the terms' posting lists, `most` the largest part in each. Lists are
    read from the largest maximum on. Once what is left can't lift an unseen document to the
    threshold, only documents that may still reach it are looked up. seen: gets the number of
    postings read."""
    order = lists[np.argsort(-most[lists], kind="stable")]
    rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)  # at most, from each list on
    total = np.zeros(count)
    chosen = None
    for i, t in enumerate(order.tolist()):
        a, b = starts[t], starts[t + 1]
        if chosen is None:
            if rest[i] < floor - slack:
                chosen = np.flatnonzero(total > 0)
            else:
                total[docs[a:b]] += parts[a:b]
                if seen is not None:
                    seen.append(b - a)
                if i % 8 == 7 and count > k:
                    floor = max(floor, float(np.partition(total, count - k)[count - k]))
                continue
        chosen = chosen[total[chosen] + rest[i] >= floor - slack]
        at = np.searchsorted(docs[a:b], chosen)
        at[at == b - a] = 0
        hit = docs[a:b][at] == chosen
        total[chosen[hit]] += parts[a:b][at[hit]]
        if seen is not None:
            seen.append(len(chosen))
    chosen = np.flatnonzero(total > 0) if chosen is None else chosen
    return chosen[total[chosen] >= floor - slack], total[chosen[total[chosen] >= floor - slack]]


def sparse_best(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id", text: str = "text", k1: float = 1.2, b: float = 0.75, digits: int = 6, query_rows: int = 4096, postings: int = 1 << 21) -> DataFrame:
    """query_key, doc_id, score (BM25, rounded), rank of each query's `k` best documents; ties
    to the smaller id. Postings of the queries' terms are dealt by document into shards, queries
    into groups; a tile of both hands on the k best of each query, so that no pair of a query
    and a document is written but those. A query's k-th best in the first shard is a threshold
    in all others: lists whose maxima can't reach it are not read."""
    asked = keep_table(terms(queries, query_key, text).select(F.col(query_key).alias("query_id"), "term"))
    held = keep_table(impacts(docs, asked, key, text, k1, b))
    sizes = asked.agg(F.count_distinct("query_id").alias("q")).first()["q"], held.count()
    groups, shards = max(1, -(-sizes[0] // query_rows)), max(1, -(-sizes[1] // postings), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)).cast("int")
    among = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = dict(asked.dtypes)["query_id"]
    slack = 2 * 10.0**-digits

    def tile(left, right):
        out = []
        if left.num_rows and right.num_rows:
            words = right["term"].combine_chunks().dictionary_encode()
            code, parts = words.indices.to_numpy(), right["part"].to_numpy()
            ids, doc = np.unique(right["doc_id"].to_numpy(), return_inverse=True)
            order = np.lexsort((doc, code))
            code, doc, parts = code[order], doc[order], parts[order]
            starts = np.searchsorted(code, np.arange(len(words.dictionary) + 1))
            most = np.maximum.reduceat(parts, starts[:-1])
            at = pc.index_in(left["term"].combine_chunks(), words.dictionary)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            which = at.fill_null(-1).to_numpy()[known]
            query = left["query_id"].combine_chunks().dictionary_encode()
            row = query.indices.to_numpy()
            floors = np.full(len(query.dictionary), -np.inf)
            floors[row] = left["floor"].to_numpy()
            row = row[known]
            sort = np.argsort(row, kind="stable")
            row, which = row[sort], which[sort]
            cuts = np.searchsorted(row, np.arange(len(query.dictionary) + 1))
            for q in range(len(query.dictionary)):
                lists = which[cuts[q] : cuts[q + 1]]
                if not len(lists):
                    continue
                found, total = best_sums(starts, doc, parts, lists, most, len(ids), k, floors[q], slack)
                total = np.round(total, digits)
                best = np.lexsort((found, -total))[:k]
                out.append((np.full(len(best), q), ids[found[best]], total[best]))
        if not out:
            return pa.table({"query_id": left["query_id"].slice(0, 0), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": query.dictionary.take(pa.array(q)), "doc_id": d, "score": s})

    def best(first: bool, floors: DataFrame) -> DataFrame:
        of_shard = (F.col("s") == 0) if first else (F.col("s") > 0)
        known = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        left = known.select("query_id", "term", "floor", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("g"), among(shards).alias("s")).where(of_shard)
        right = held.select("term", "doc_id", "part", shard.alias("s")).where(of_shard).select("*", among(groups).alias("g"))
        return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(tile, f"query_id {kind}, doc_id long, score double")

    none = asked.select("query_id", F.lit(0.0).alias("floor")).limit(0)
    found = keep_table(best(True, none))
    floors = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "floor")
    return ranked(found.unionByName(best(False, floors)).withColumnRenamed("query_id", query_key), [query_key], "score", "doc_id", k)


def dense_top(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", rows: int = 16_384, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score (cosine, rounded), rank of each query's `k` best other rows.
    Queries and candidates are dealt into tiles of about `rows` by `rows`; a tile is one
    matrix product in one task, which hands on the k best of each query."""
    every = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    sizes = every.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    groups, shards = max(1, -(-sizes["q"] // rows)), max(1, -(-sizes["n"] // rows), int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    among = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = every.where("q").select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), among(shards).alias("s"))
    held = every.select("id", "v", among(groups).alias("g"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(shards)).cast("int").alias("s"))

    def unit(column) -> np.ndarray:
        made = np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 1))
        size = np.linalg.norm(made, axis=1, keepdims=True)
        return made / np.where(size > 0, size, np.nan)

    def tile(left, right):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, other = left["id"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(other, kind="stable")
            other, a, b = other[order], unit(left["v"].combine_chunks()), unit(right["v"].combine_chunks())[order]
            for at in range(0, len(ids), 512):
                score = np.round(a[at : at + 512] @ b.T, digits)
                score[(ids[at : at + 512, None] == other[None, :]) | np.isnan(score)] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if len(other) > k else np.full(len(score), -np.inf)
                row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                sort = np.lexsort((col, -score[row, col], row))
                row, col = row[sort], col[sort]
                first = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
                out.append((ids[at + row[first]], other[col[first]], score[row[first], col[first]]))
        q, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": q, "doc_id": d, "score": s})

    found = asked.groupBy("g", "s").cogroup(held.groupBy("g", "s")).applyInArrow(tile, "query_id long, doc_id long, score double")
    return ranked(found, ["query_id"], "score", "doc_id", k)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / F.nullif(size(a) * size(b), F.lit(0.0))


def ranked(scores: DataFrame, by: list[str], score: str, tie: str, depth: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def fuse(branches: list[DataFrame], by: list[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: each branch has `by` and rank; the order of branches is free."""
    every = None
    for x in branches:
        part = x.select(*by, (1 / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*by).agg(F.sum("part").alias("rrf"))


def mmr(candidates: DataFrame, query_key: str, key: str, k: int, weight: float = 0.7) -> DataFrame:
    """Greedy choice of relevant yet different texts among a query's few candidates (those
    that a rank limit has left): weight x score less the rest x the largest Jaccard overlap
    with what is chosen, on words over two letters of the first 200 characters."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["score", key], ascending=[False, True]).to_dict("records")
        words = [frozenset(w for w in str(r["text"] or "")[:200].lower().split() if len(w) > 2) for r in rows]
        left, picked = list(range(len(rows))), []
        while left and len(picked) < k:
            value = [weight * rows[i]["score"] - (1 - weight) * max((len(words[i] & words[j]) / len(words[i] | words[j]) for j in picked if words[i] and words[j]), default=0.0) if picked else rows[i]["score"] for i in left]
            picked.append(left.pop(value.index(max(value))))
        out = frame.iloc[:0][[query_key, key]].copy()
        out[query_key], out[key] = [rows[i][query_key] for i in picked], [rows[i][key] for i in picked]
        out["position"] = range(1, len(picked) + 1)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy(query_key).applyInPandas(choose, f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, position long")


def round_robin(evidence: DataFrame, by: str, kind: str, order: list[Column], priority: list[str], limit: int | None = None) -> DataFrame:
    """One of each kind in turn, kinds in order of priority and then by name."""
    first = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col(kind)), F.lit(0)), F.lit(len(priority) + 1))
    w = Window.partitionBy(by, kind).orderBy(*order)
    turn = evidence.withColumns({"turn": F.row_number().over(w), "__first": first})
    made = turn.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("turn", "__first", kind))).drop("__first")
    return made if limit is None else made.where(F.col("position") <= limit)


def quotas(evidence: DataFrame, by: str, kind: str, order: list[Column], allowed: dict[str, int], other: int) -> DataFrame:
    """The first of each kind, as many as its quota."""
    quota = F.lit(other)
    for k, n in allowed.items():
        quota = F.when(F.col(kind) == k, n).otherwise(quota)
    return evidence.withColumn("rn", F.row_number().over(Window.partitionBy(by, kind).orderBy(*order))).where(F.col("rn") <= quota)


def trust_score(citation: Column, recency: Column, prior: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.60 * citation + 0.25 * recency + 0.15 * prior))


def boosted(score: Column, trust: Column) -> Column:
    return score * (1 + 0.2 * (F.coalesce(trust, F.lit(0.5)) - 0.5))


def within_budget(evidence: DataFrame, by: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The best rows whose running cost stays in the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return evidence.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
