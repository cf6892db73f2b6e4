r"""Benchmark decontamination: size-partitioned MinHash containment search, natively.

An item is contained in a document if at least `threshold` of its distinct word shingles
occur there. Words are lower-cased runs of letters and digits; shingles have `shingle`
words (an item with fewer words is one shingle of them all).

Items are partitioned by how many shingles they have, by powers of two. A partition with
at most u shingles per item keeps the m = u - ceil(threshold * u) + 1 least hashes of
each item's shingles, a bottom-m MinHash sketch. Whatever document holds the threshold's
share of the item's shingles holds at least one of any m of them, so probing the sketches
with every shingle hash of every document loses no pair, however long the document; a
document with fewer shingles than a partition's least item needs is not probed against it. A
candidate pair is then verified by the exact share of the item's shingles, compared as
text, in the whole document.

All of it is DataFrame functions. Sketches, items and the ids of documents with a candidate
go to every task only if they were measured and are small; otherwise their join shuffles and
Spark splits skew. So texts move only where candidates are too many to be sent around, and
are else read once more instead.

Null text: no words, so contained in nothing and containing nothing. Null ids: the row
takes no part. Rows that share an id count as the best of them. Repeated items: each is
reported. Very long texts: whole. Ties: a share of exactly `threshold` counts. Extra columns
are ignored. Either table empty: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.shared import keep_table

SHINGLE, THRESHOLD = 5, 0.8
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(col: str, size: int, make) -> Column:
    """make(i) for the start of every run of `size` elements of array `col`."""
    n = F.size(col) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), make))


def shingle_texts(col: str, size: int) -> Column:
    return _windows(col, size, lambda i: F.array_join(F.slice(F.col(col), i + 1, size), " "))


def shingle_hashes(col: str, size: int) -> Column:
    """From an array of word hashes."""
    return _windows(col, size, lambda i: F.xxhash64(*[F.get(F.col(col), i + k) for k in range(size)]))


def _sender(size: int, most: int):
    """Broadcasts what was measured and found small enough; leaves the rest to a shuffle."""
    return F.broadcast if size <= most else (lambda df: df)


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """items: item_id, size, shingles, hashes. (item_id, size, need, hash) of the sketches;
    need: as many shingles has a document that contains an item of the partition."""
    n = F.size("hashes")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
    keep = F.least(n, upper - F.ceil(F.lit(threshold) * upper - 1e-9).cast("int") + 1)
    need = F.ceil(F.lit(threshold) * (F.floor(upper / 2) + F.when(upper > 1, 1).otherwise(0)) - 1e-9)
    return items.select("item_id", "size", need.alias("need"), F.explode(F.slice(F.array_sort("hashes"), F.lit(1), keep)).alias("hash"))


def probes(hashed: DataFrame, size: int) -> DataFrame:
    """hashed: doc_id, h (array of word hashes). (doc_id, n, hash) of every run of `size` words;
    n: how many the document has. The array itself doesn't go along with each of its runs, and no
    condition makes the words be found twice: of too few words there are no runs."""
    counted = hashed.select("doc_id", (F.size("h") - size + 1).alias("n"), "h")
    return counted.select("doc_id", "n", F.explode(shingle_hashes("h", size)).alias("hash"))


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, containment of every pair that reaches the threshold."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    listed = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("w")).where("item_id is not null and size(w) > 0")
    listed = listed.withColumn("size", F.least(F.size("w"), F.lit(shingle))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    sizes = sorted(r["size"] for r in listed.select("size").distinct().collect())  # at most `shingle` numbers

    def by_size(make, col: str) -> Column:
        out = F.lit(None)
        for k in sizes:
            out = F.when(F.col("size") == k, make(col, k)).otherwise(out)
        return out

    if not sizes:
        return texts.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("containment")).limit(0)
    items = keep_table(listed.select("item_id", "size", F.array_distinct(by_size(shingle_texts, "w")).alias("shingles"), F.array_distinct(by_size(shingle_hashes, "h")).alias("hashes")))
    sketch = keep_table(sketches(items, threshold))
    size_of = items.agg(F.coalesce(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s) + 16)), F.lit(0)).alias("n"))
    send_sketch = _sender(sketch.count(), BROADCAST_ROWS)
    send_items = _sender(size_of.first()["n"], BROADCAST_BYTES)

    hashed = texts.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    found = None
    for k in sizes:
        hits = probes(hashed, k).join(send_sketch(sketch.where(F.col("size") == k).select("item_id", "need", "hash")), "hash").where("n >= need").select("doc_id", "item_id")
        found = hits if found is None else found.unionByName(hits)
    wanted = keep_table(found.groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids")))
    # whole texts move only if the documents with a candidate are too many to send around
    send_docs = _sender(wanted.agg(F.coalesce(F.sum(F.size("item_ids") + 4), F.lit(0)).alias("n")).first()["n"], 10 * BROADCAST_ROWS)
    held = texts.join(send_docs(wanted), "doc_id").select("doc_id", "item_ids", words(F.col("text")).alias("w"))
    pairs = None
    for k in sizes:
        own = held.select("doc_id", F.explode("item_ids").alias("item_id"), shingle_texts("w", k).alias("s"))
        own = own.join(send_items(items.where(F.col("size") == k).select("item_id", "shingles")), "item_id")
        own = own.select("doc_id", "item_id", (F.size(F.array_intersect("shingles", "s")) / F.size("shingles")).alias("containment"))
        pairs = own if pairs is None else pairs.unionByName(own)
    return pairs.where(F.col("containment") >= threshold).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that contain an item. Rows with a null id stay. Texts stay in place
    unless the ids that go are too many to send around."""
    bad = keep_table(contained(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(_sender(bad.count(), 10 * BROADCAST_ROWS)(bad), id_col, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


ORACLE = r"""
with d as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null
), b as (
  select item_id, w, least(len(w), 5) as k from (
    select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where item_id is not null
  ) where len(w) > 0
), bs as (
  select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as s from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from b)
), ks as (select distinct k from b
), ds as (
  select distinct doc_id, k, array_to_string(w[i : i + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks)
), n as (select item_id, count(*) as n from bs group by item_id)
select doc_id, item_id, count(*) / max(n.n) as containment
from ds join bs using (k, s) join n using (item_id)
group by doc_id, item_id having count(*) / max(n.n) >= 0.8
"""
