"""LM scoring: a Katz back-off bigram model over all documents.

Tokens are the words of the text with A-Z lower-cased, then one end token; histories
begin with a start symbol. The model learns from the training documents, and every
document is scored:

    P(w | v) = d(c(v,w)) c(v,w) / c(v)    if the bigram was seen
             = a(v) P(w)                  otherwise, or P(w) if v was never seen
    P(w)     = (c(w) + 1) / (N + V + 1)

d is the Good-Turing discount for counts up to `top` (absolute discounting by 0.5 where
the counts of counts don't give discounts in (0, 1)), and a(v) is the mass the seen
bigrams of v leave, over the unigram mass of the words not seen after v. Both sums are
kept as integers: sum of c(w) + 1 over seen w, and the number of seen w with each count
up to `top`. So P(. | v) sums to one exactly but for the final division. Where all of
v's counts exceed `top`, its counts are divided by c(v) + 1 so that some mass is left.

The count tables are partitioned by key range (the buckets of ``blocks``): unigrams,
bigrams, and back-off sums by history. A block of documents looks its distinct keys up
in each and then scores its tokens recursively, bigram to unigram. The first block that
holds a bigram adds it to its history's sums, so no history's bigrams are ever gathered.
Keys have twice the bits of the number of tokens: less than one expected clash.

Null text: empty, so one end token. Very long texts: whole, in a block of their own. Null id: the row takes no part. Rows that share an
id, and equal texts, are each counted and scored. Extra columns are ignored. Empty
table: no rows. No training documents: N = V = 0 and every token has probability one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import arrays as A
from lodeframe.llm.blocks import Blocks, Texts

END, START = A.mix(np.array([0xE17D, 0x57A7], np.uint64))
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def crc_fold(modulus: int, left_out: int) -> Callable[[int], bool]:
    """Tells which ids are held out: those whose crc32 as text has this remainder."""
    return lambda i: zlib.crc32(str(i).encode()) % modulus == left_out


def katz_scores(docs: DataFrame, held_out: Callable[[int], bool] = crc_fold(7, 2), top: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known (tokens with a training
    count), train_tokens, base_score (add-one unigrams) and score, both log10."""
    blocks = Blocks(docs, id_col, text_col, block_bytes)
    buckets, bits = blocks.n, min(64, max(40, 2 * (blocks.bytes // 8).bit_length()))

    def lists(x: Tokens, keys: np.ndarray):
        at = A.bucket_bounds(keys, buckets, bits)
        return [slice(int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]

    # Every block asks every bucket, so that each block gets all buckets' totals.
    def ask_counts(texts, second: bool):
        x = Tokens(texts, held_out, bits)
        keys, counts = x.counted(second)
        for k, s in enumerate(lists(x, keys)):
            yield k, A.squeeze(keys[s]), squeeze_ints(counts[s])

    def unigrams(rows):
        keys, total, at, _ = gathered(rows)
        words = total[keys != np.uint64(int(START) >> (64 - bits))]
        tail = np.array([words.sum(), (words > 0).sum()], np.int64).tobytes()
        for (block, _, _), s in zip(rows, at, strict=True):
            yield block, squeeze_ints(total[s]), tail

    def bigrams(rows):
        _, total, at, first = gathered(rows)
        tail = np.array([(total == r).sum() for r in range(1, top + 2)], np.int64).tobytes()
        for n, ((block, _, _), s) in enumerate(zip(rows, at, strict=True)):
            yield block, squeeze_ints(total[s] * 2 + (first[s] == n)), tail

    def ask_sums(block, texts, rows):
        x = Tokens(texts, held_out, bits)
        keys, inverse = x.distinct(second=False)
        counts, pairs, _, _ = x.replies(rows, buckets)
        _, own = x.distinct(second=True)
        # one place of each distinct bigram of which this block is the first
        place = np.full(len(pairs), -1, np.int64)
        place[own] = np.arange(len(own))
        place = place[(pairs & 1 == 1) & (pairs > 1)]
        seen = pairs[own[place]] >> 1
        history, word = inverse[x.history[place]], inverse[place]
        sums = np.zeros((top + 1, len(keys)), np.int64)
        np.add.at(sums[0], history, counts[word] + 1)
        for r in range(1, top + 1):
            np.add.at(sums[r], history[seen == r], 1)
        for k, s in enumerate(lists(x, keys)):
            yield k, A.squeeze(keys[s]), squeeze_ints(sums[:, s])

    def add_sums(rows):
        keys = [A.unsqueeze(b) for _, b, _ in rows]
        every = np.unique(np.concatenate(keys))
        at = [np.searchsorted(every, k) for k in keys]
        total = np.zeros((top + 1, len(every)), np.int64)
        for s, (_, _, sums) in zip(at, rows, strict=True):
            total[:, s] += unsqueeze_ints(sums).reshape(top + 1, -1)
        for (block, _, _), s in zip(rows, at, strict=True):
            yield block, squeeze_ints(total[:, s]), b""

    def score(block, texts, rows):
        x = Tokens(texts, held_out, bits)
        keys, inverse = x.distinct(second=False)
        counts, pairs, (n, v), of_counts = x.replies(rows, buckets)
        sums = [unsqueeze_ints(body).reshape(top + 1, -1) for bucket, body, _ in rows if bucket >= 2 * buckets]
        sums = np.concatenate(sums, axis=1) if sums else np.zeros((top + 1, 0), np.int64)
        discount = discounts(of_counts, top)
        unigram = (counts + 1) / (n + v + 1)
        left = (sums[1:] * (np.arange(1, top + 1) * (1 - discount[1:]))[:, None]).sum(axis=0)
        none = left <= 0
        base = np.where(none, counts + 1.0, counts)
        with np.errstate(divide="ignore", invalid="ignore"):
            backoff = np.where(counts > 0, np.where(none, 1.0, left) / base / (1 - sums[0] / (n + v + 1)), 1.0)
        _, own = x.distinct(second=True)
        seen, history, word = pairs[own] >> 1, inverse[x.history], inverse[: x.n]
        factor = discount[np.minimum(seen, top + 1) % (top + 1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(seen > 0, np.where(none[history], 1.0, factor) * seen / base[history], backoff[history] * unigram[word])
        starts = x.offs[:-1]
        add = lambda values: np.add.reduceat(values, starts) if len(starts) else np.zeros(0)
        columns = [texts.ids, x.held, np.diff(x.offs), add((counts[word] > 0).astype(np.int64)), np.full(len(texts), n), add(np.log10(unigram[word])), add(np.log10(p))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    def shifted(frame: DataFrame, by: int) -> DataFrame:
        return frame.withColumn("bucket", (F.col("bucket") + by).cast("int"))

    one = blocks.answer(blocks.ask(blocks.packed, lambda t: ask_counts(t, False)), unigrams)
    two = blocks.answer(blocks.ask(blocks.packed, lambda t: ask_counts(t, True)), bigrams)
    both = one.unionByName(shifted(two, buckets))
    three = blocks.answer(blocks.ask_again(both, ask_sums), add_sums)
    return blocks.with_answers(both.unionByName(shifted(three, 2 * buckets)), score, SCHEMA)


def discounts(of_counts: np.ndarray, top: int) -> np.ndarray:
    """The factor for each count up to `top`; index 0 stands for any larger count."""
    out = np.ones(top + 1)
    n = [0.0, *map(float, of_counts)]
    good = all(x > 0 for x in n[1 : top + 2])
    if good:
        tail = (top + 1) * n[top + 1] / n[1]
        for r in range(1, top + 1):
            out[r] = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail < 1 else 0
        good = bool(((out[1:] > 0) & (out[1:] < 1)).all())
    if not good:
        out[1:] = [(r - 0.5) / r for r in range(1, top + 1)]
    return out


class Tokens:
    """A block's tokens: keys, the place of each one's history, offsets by document."""

    def __init__(self, texts: Texts, held_out: Callable[[int], bool], bits: int):
        hashes, offs = A.word_hashes(texts.buf, texts.offs, lower=True)
        docs, self.drop = len(texts), np.uint64(64 - bits)
        self.offs = offs + np.arange(docs + 1)
        self.n = n = int(self.offs[-1])
        tokens = np.full(n + 1, START, np.uint64)  # the last one is the start symbol
        ends = self.offs[1:] - 1
        inner = np.ones(n, bool)
        inner[ends] = False
        tokens[:n][inner] = hashes
        tokens[ends] = END
        self.history = np.arange(-1, n - 1)
        self.history[self.offs[:-1]] = n
        self.tokens = tokens
        self.held = np.array([held_out(i) for i in texts.ids.tolist()], bool)
        self.train = np.repeat(~self.held, np.diff(self.offs))

    def keys(self, second: bool) -> np.ndarray:
        """Of each place; the unigrams end with the start symbol."""
        if not second:
            return self.tokens >> self.drop
        return A.mix(self.tokens[self.history] * np.uint64(A.BASE) + self.tokens[: self.n]) >> self.drop

    def distinct(self, second: bool) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.keys(second), return_inverse=True)

    def counted(self, second: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often training has them. The start symbol
        counts as often as training has documents."""
        keys = self.keys(second)
        train = self.train if second else np.append(self.train, False)
        if self.drop:  # sort with the flag in a spare bit
            tagged = np.sort((keys << np.uint64(1)) | train.astype(np.uint64))
            keys, train = tagged >> np.uint64(1), (tagged & np.uint64(1)).astype(np.int64)
        else:
            order = np.argsort(keys, kind="stable")
            keys, train = keys[order], train[order].astype(np.int64)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        counts = np.add.reduceat(train, first) if len(first) else np.zeros(0, np.int64)
        if not second:
            counts[keys[first] == START >> self.drop] += int((~self.held).sum())
        return keys[first], counts

    def replies(self, rows, buckets: int):
        """Unigram counts, 2 x bigram counts + owned, (N, V), counts of counts."""
        one = [r for r in rows if r[0] < buckets]
        two = [r for r in rows if buckets <= r[0] < 2 * buckets]
        ints = lambda found: np.concatenate([np.zeros(0, np.int64), *(unsqueeze_ints(body) for _, body, _ in found)])
        add = lambda found: sum(np.frombuffer(tail, np.int64) for _, _, tail in found)
        return ints(one), ints(two), add(one), add(two)


def gathered(rows):
    """Keys of a bucket, their total counts, where each block's keys are, and the first block."""
    keys = [A.unsqueeze(b) for _, b, _ in rows]
    every, first = np.unique(np.concatenate(keys), return_index=True)
    at = [np.searchsorted(every, k) for k in keys]
    total = np.zeros(len(every), np.int64)
    for s, (_, _, counts) in zip(at, rows, strict=True):
        total[s] += unsqueeze_ints(counts)
    return every, total, at, np.searchsorted(np.cumsum([len(k) for k in keys]), first, "right")


def squeeze_ints(values: np.ndarray) -> bytes:
    """Small integers mostly: bytes in planes, then zstd."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unsqueeze_ints(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    out = np.zeros((len(raw) // blob[0], 8), np.uint8)
    out[:, : blob[0]] = raw.reshape(blob[0], -1).T
    return out.view(np.int64).ravel()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
