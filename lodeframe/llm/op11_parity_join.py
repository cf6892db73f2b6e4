"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Every shingle's hash names a bit of a
sketch, and the bits are added modulo two, so that two sketches differ in no more bits than
the sets have shingles that only one of them holds. Two sets of x and y shingles at the
threshold t differ in at most (x + y)(1 - t) / (1 + t) of them.

Sizes are cut into bands; a set near the upper edge of its band also stands in the next, so
that two sets that may link share a band. All sketches of a band have the same length, whose
segments of 64 bits outnumber the differences D allowed there: at least one segment agrees
(pigeonhole), and with D + 1 + s segments at least s + 1 do. Each set therefore leaves out its
s emptiest segments: of the segments that agree, the fullest is among neither set's s
emptiest, as both order them alike. What is left are keys of the band, the segment and its
bits, under which sets meet. A key holds some seven shingles on average; a document has a key
for nine of them.

Sets that meet are compared by size, by sketches of 512 bits and of two bits a shingle, whose
distance must stay within D, and what passes by the exact sets (`similar`).

Null text: empty. A text without words has no shingles and no links; one with fewer words than
a shingle has one shingle, all of them. Null id: the row takes no part. Repeated rows: each is
returned, in the same component; rows that share an id but not the text are different sets.
Very long texts: whole. Ties: a similarity of exactly `percent` links. Extra columns are
ignored. Empty table: no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import arrays as A
from lodeframe.llm.similar import similar_sets

#: A band ends at this many times its least size, or at the ratio of sizes that may link.
BAND = 1.2
#: One segment in so many more is left out.
SPARE = 4
WORD = "[^ \\t-\\r]"


def edges(most: int, percent: int) -> list[int]:
    """Where bands begin, up to the first that begins above `most`."""
    ratio, found = max(BAND, 100 / percent), [1]
    while found[-1] <= most:
        found.append(max(found[-1] + 1, int(np.ceil(ratio * found[-1]))))
    return found


def differences(size: int, percent: int) -> int:
    """In how many elements two sets of at most this size may differ at the threshold."""
    return 2 * size * (100 - percent) // (100 + percent)


def sketch(shingles: np.ndarray, segments: int) -> np.ndarray:
    """64 bits for each segment: how many shingles fall on each bit, modulo two."""
    at = ((shingles >> np.uint64(32)) * np.uint64(64 * segments)) >> np.uint64(32)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * segments) & 1, bitorder="little").view(np.uint64)


def sketch_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set in its band, and in the next if a set there may link with it."""
    n = len(shingles)
    begin = edges(n, percent)
    begin.append(max(begin[-1] + 1, int(np.ceil(max(BAND, 100 / percent) * begin[-1]))))
    own = bisect_right(begin, n) - 1
    found = [np.zeros(0, np.uint64)]
    for band in (own, own + 1) if 100 * n >= percent * begin[own + 1] else (own,):
        most = differences(begin[band + 1] - 1, percent)
        if most:  # else only equal sets link
            segments = most + 1 + most // SPARE
            bits = sketch(shingles, segments)
            keys = A.mix(bits ^ A.mix(np.arange(segments, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40))))
            found.append(keys[np.lexsort((keys, -np.bitwise_count(bits).astype(np.int64)))[: most + 1]])
    return np.concatenate(found)


def similar_ngrams(docs: DataFrame, percent: int = 90, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    found = similar_sets(chosen.where(worded), percent, shingle, lambda s: sketch_keys(s, percent))
    empty = chosen.where(~worded).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id").unionByName(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_ngrams(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) end as s
  from w
), d as (
  select s, min(doc_id) as node, len(s) as n from s where len(s) > 0 group by s
), t as (
  select node, n, unnest(s) as x from d
), p as (
  select a.node as a, b.node as b from t a join t b on a.x = b.x and a.node <> b.node and 100 * b.n >= 90 * a.n and 100 * a.n >= 90 * b.n
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r as (
  select a as node, a as seen from p union select r.node, p.b from r join p on p.a = r.seen
), c as (
  select node, min(seen) as component from r group by node
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.component, d.node, s.doc_id) as component_id
from s left join d on s.s = d.s left join c on c.node = d.node
"""
