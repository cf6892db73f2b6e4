"""Substring dedup by words: difference-cover anchors, then extension.

``substring_dedup`` removes from every text each word covered by a window of `length`
words that also starts in a document with a smaller id. Words are maximal runs
without ASCII white space, compared unchanged. Anchors of 7 words at the positions
1, 2, 4 modulo 7 suffice for windows of 13 (see ``cover``).

Null text: no words. Very long texts: whole, in a block of their own. Null id: the row takes no part. Rows that share an id do not
judge each other; each is returned. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.blocks import Blocks
from lodeframe.llm.cover import Rule, covered, runs_of, table_of

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TYPES = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": _SPAN, "kept": pa.string()}


def substring_dedup(docs: DataFrame, length: int = 13, modulus: int = 7, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, spans (of removed words, end exclusive), kept (the
    other words joined by one space)."""
    return covered(Blocks(docs, id_col, text_col, block_bytes), Rule(length, modulus, words=True), _finish, SCHEMA)


def _finish(texts, units, removed) -> pa.Table:
    out = {k: [] for k in _TYPES}
    for d in range(len(texts)):
        words, gone = texts.text(d).split(), removed[units.offs[d] : units.offs[d + 1]]
        if gone.any():
            keep = [words[k] for k in np.flatnonzero(~gone).tolist()]
            spans = [{"start": a, "end": b} for a, b in zip(*map(np.ndarray.tolist, runs_of(gone)), strict=True)]
        else:
            keep, spans = words, []
        out["doc_id"].append(int(texts.ids[d]))
        out["n_words"].append(len(words))
        out["n_removed"].append(int(gone.sum()))
        out["spans"].append(spans)
        out["kept"].append(b" ".join(keep))
    out["kept"] = pa.array(out["kept"], pa.binary()).cast(pa.string())
    return table_of(out, _TYPES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null
), win as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)
), lead as (select s, min(doc_id) as first from win group by s
), gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join lead using (s) where first < doc_id
), word as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d
), kept as (select doc_id, string_agg(word, ' ' order by p) as kept from word anti join gone using (doc_id, p) group by doc_id
), n as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id) left join n using (doc_id)
"""
