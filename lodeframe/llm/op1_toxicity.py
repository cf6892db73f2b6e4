"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words, and pairs with one
word between, as 48-bit hashes of lower-cased words without punctuation; each counts once
however often it occurs. FTRL keeps a sum of gradients z and of squared gradients n for
each coordinate, so that rates fall per coordinate, and L1 leaves all but clearly useful
weights at zero.

Training takes about `max_rows` labelled documents, chosen by a share of hashes of the id,
dealt over shards of about `shard_rows`. A shard is written once as one row of a table. Each
shard runs FTRL over its documents, and hands on the coordinates whose weight isn't zero;
their z are averaged over the shards that have the coordinate at all (one whose weight is
zero there counts as z = 0), their n over those that handed it on, and start the next round.
The weights at the end are few, so they go to every task with the scoring function.

Null text: empty. An empty text gets the score of the bias. Null id: scored, never used
for training. Labels that are null are ignored; a label row for which no document exists
is, too. Repeated rows: each is scored. Extra columns are ignored. Empty table: no rows;
no labels: all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import arrays as A
from lodeframe.llm.blocks import small_batches
from lodeframe.llm.shared import about, keep_table, spare, tidy

MAX_ROWS, SHARD_ROWS, ROUNDS, PASSES = 40_000, 2_000, 3, 3
#: Rate, rate offset, L1, L2, per coordinate.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
KEY_BITS = 48
_DROP = np.uint64(64 - KEY_BITS)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and document of every feature, repeats included."""
    words, at = A.word_hashes(buf, offs, lower=True, gaps=A.NOT_ALNUM)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    keys, docs = [words], [doc]
    for gap, factor in ((1, A.BASE), (2, A.STEP)):
        same = doc[gap:] == doc[:-gap]
        keys.append(A.mix(words[:-gap][same] * np.uint64(factor) + words[gap:][same]))
        docs.append(doc[gap:][same])
    return np.concatenate(keys) >> _DROP, np.concatenate(docs)


def distinct(keys: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each document, sorted, one document after the other, and how many
    each has."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[new], np.bincount(doc[new], minlength=docs).astype(np.int64)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)


def ftrl_pass(docs: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One pass over documents (arrays of coordinates); z and n are updated in place."""
    for at, y in zip(docs, labels, strict=True):
        zs, ns = z[at], n[at]
        w = weights(zs, ns)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        grown = ns + g * g
        z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
        n[at] = grown


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


#: The key of the bias, which every document has.
BIAS = np.uint64(0)


def fit(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and weights. use: a condition on the labels' doc_id."""
    ids = F.col(id_col).cast("long")
    known = labels.select(ids.alias("id"), F.col(label).cast("double").alias("label")).where("id is not null and label is not null").where(use)
    chosen = keep_table(about(known, max_rows, F.col("id")))
    shards = max(1, round(chosen.count() / shard_rows))
    # about max_rows rows of two numbers
    texts = docs.select(ids.alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "label")

    def extract(batches):
        found, counts, y = [], [], []  # arrays of a slice, not of a document: many small ones leave memory in pieces
        for rb in batches:
            buf, offs = joined(rb.column(1))
            for first, last in A.slices(offs):
                keys, doc = features(buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
                kept, count = distinct(keys, doc, last - first)
                found.append(kept)
                counts.append(count)
            y += rb.column(2).to_pylist()
        if not found:
            return
        every = np.concatenate(([BIAS], *found))
        every.sort()  # in place; the bias, zero, stays first
        new = np.ones(len(every), bool)
        new[2:] = every[2:] != every[1:-1]
        every = every[new]
        places = []
        while found:
            at = np.searchsorted(every[1:], found.pop(0)).astype(np.int32) + np.int32(1)
            count = counts[len(places)]
            places.append(np.insert(at, np.cumsum(count) - count, np.int32(0)))  # the bias comes first in each
        blobs = [A.squeeze(every), np.concatenate(places).tobytes(), (np.concatenate(counts) + 1).tobytes(), np.array(y, float).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["keys", "places", "sizes", "labels"])

    dealt = small_batches(texts).repartition(shards, "id").sortWithinPartitions("id", "label", "text")
    # not compressed: codecs keep buffers of a row's size, 16 MB, outside the heap
    rows = keep_table(dealt.mapInArrow(tidy(extract), "keys binary, places binary, sizes binary, labels binary"), compression="none")
    keys, z, n = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for _ in range(ROUNDS):
        start = (keys, z, n)

        def train(batches):
            for rb in batches:
                for row in range(rb.num_rows):
                    packed, places, sizes, y = (rb.column(k)[row].as_buffer() for k in range(4))  # not copied
                    every = A.unsqueeze(packed)
                    docs = np.split(np.frombuffer(places, np.int32), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
                    z, n = np.zeros(len(every)), np.zeros(len(every))
                    known = A.find(start[0], every)
                    z[known[known >= 0]], n[known[known >= 0]] = start[1][known >= 0], start[2][known >= 0]
                    for _ in range(PASSES):
                        ftrl_pass(docs, np.frombuffer(y), z, n)
                    kept = np.flatnonzero(np.abs(z) > L1)  # where the weight isn't zero
                    yield pa.RecordBatch.from_arrays([pa.array(every[kept].astype(np.int64)), pa.array(z[kept]), pa.array(n[kept])], ["key", "z", "n"])

        # the model, not data: few coordinates pass L1
        found = rows.mapInArrow(tidy(train), "key long, z double, n double").groupBy("key").agg(F.sum("z").alias("z"), F.avg("n").alias("n")).toPandas().sort_values("key")
        keys, z, n = found["key"].to_numpy().astype(np.uint64), found["z"].to_numpy(float), found["n"].to_numpy(float)
        passed = keys

        def seen(batches):
            for rb in batches:
                flags = [A.find(passed, A.unsqueeze(blob)) >= 0 for blob in rb.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())], ["flags"])

        # a bit for each shard and coordinate of the model
        flags = [np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(keys)) for r in rows.select("keys").mapInArrow(tidy(seen), "flags binary").collect()]
        z /= np.maximum(1, np.sum(flags, axis=0, dtype=np.int64)) if flags else 1
        kept = np.abs(z) > L1
        keys, z, n = keys[kept], z[kept], n[kept]
    return keys, weights(z, n)


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """docs, and the probability of label 1 in a new column `name` (in place of one so named)."""
    docs, (keys, weight) = docs.drop(name), model
    whole = spare("whole_text", docs)
    schema = docs.schema.add(name, "double")

    def run(batches):
        member = A.Membership(keys, KEY_BITS)
        bias = float(weight[A.find(np.array([BIAS]), keys)].sum()) if len(keys) and keys[0] == BIAS else 0.0
        for rb in batches:
            buf, offs = joined(rb.column(rb.num_columns - 1))
            total = np.full(rb.num_rows, bias)
            for a, b in A.slices(offs):
                key, doc = features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                at, which = member.hits(key)
                pairs = np.unique(doc[at] * len(keys) + which) if len(at) else np.zeros(0, np.int64)
                np.add.at(total, a + pairs // max(1, len(keys)), weight[pairs % max(1, len(keys))])
            p = 1 / (1 + np.exp(-np.clip(total, -500, 500))) if len(keys) else np.zeros(rb.num_rows)
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(p)], [*rb.schema.names[:-1], name])

    return small_batches(docs).withColumn(whole, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(tidy(run), schema)


def fold(modulus: int, remainder: int, col: str) -> Column:
    """Whether crc32(id as text) has this remainder."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus == remainder


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, ~fold(5, 0, "id"))
    scored = score_texts(docs.select("doc_id", "text"), model, name="score")
    return scored.select("doc_id", fold(5, 0, "doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
