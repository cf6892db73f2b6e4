"""Dedup of byte strings that documents share, from a difference-cover sample of suffixes.

This keeps the cover sample of a blockwise suffix-array construction and leaves out its byte
order: suffixes are named, not sorted (README has the figures that rule the order out). The
cover sample (positions 3, 6, 7, 12, 14 modulo 21, 30 bytes each) is named first; names that
occur once rule out every suffix near them. What is left is named by a hash of the first
`length` bytes, sent to buckets by ranges of names, and matched bucket by bucket, each name
with the first block that has it, so memory is bounded by a bucket, never by the corpus.

Null text: empty. Very long texts: whole, in a block of their own. Null id: the row takes no part. Rows that share an id do not judge
each other; each is returned. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.blocks import Blocks
from lodeframe.llm.cover import Rule, covered, runs_of, table_of

SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TYPES = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": _SPAN, "kept": pa.binary()}


def suffix_dedup(docs: DataFrame, length: int = 50, modulus: int = 21, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs, end exclusive), kept (the
    other bytes)."""
    return covered(Blocks(docs, id_col, text_col, block_bytes), Rule(length, modulus, words=False), _finish, SCHEMA)


def _finish(texts, units, removed) -> pa.Table:
    out = {k: [] for k in _TYPES}
    for d in range(len(texts)):
        at = slice(texts.offs[d], texts.offs[d + 1])
        gone, raw = removed[at], texts.buf[at]
        any_gone = gone.any()
        spans = [{"start": a, "end": b} for a, b in zip(*map(np.ndarray.tolist, runs_of(gone)), strict=True)] if any_gone else []
        out["doc_id"].append(int(texts.ids[d]))
        out["n_bytes"].append(len(raw))
        out["n_removed"].append(int(gone.sum()))
        out["spans"].append(spans)
        out["kept"].append((raw[~gone] if any_gone else raw).tobytes())
    return table_of(out, _TYPES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents where doc_id is not null
), win as (select doc_id, i, substring(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d)
), lead as (select s, min(doc_id) as first from win group by s
), bad as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from win join lead using (s) where first < doc_id
), run as (select doc_id, i, sum(case when i <= before + 50 then 0 else 1 end) over (partition by doc_id order by i rows unbounded preceding) as run from bad
), gone as (select doc_id, min(i) as a, max(i) + 50 as b from run group by doc_id, run
), part as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from gone
), kept as (select doc_id, count(*) as spans, cast(sum(b - a) as bigint) as removed, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head, max(b) as stop from part join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(stop, 0) + 1))) as kept_sha256
from d left join kept using (doc_id)
"""
