"""Documents in blocks, for operators that compare every document with all others.

A block is a contiguous range of doc_id holding about ``block_bytes`` of text. The
texts travel once, compressed, in one exchange by block that every later step of the
same query reuses. A *round* then goes: each block asks about its distinct keys, cut
by key range into one small binary row per bucket; a bucket, which sees a key at most
once from each block however hot the key is, answers each block; the block reads its
answers beside its texts. No key's occurrences are ever gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import arrays as A

#: Blocks grow with the square root of the corpus between these bounds, so that the rows of
#: a round, one for each block and bucket, grow no faster than the corpus.
LEAST_BYTES, MOST_BYTES, SQUARE = 8 << 20, 256 << 20, 80_000
#: A text weighs one more for each so many bytes when blocks are cut.
WEIGHT = 4096
#: A map task hands on its texts when it holds this much.
HELD_BYTES = 24 << 20
PACKED = "block int, ids binary, sizes binary, texts binary"
ASKED = "bucket int, block int, body binary, extra binary"
#: The Arrow batches of whole texts are kept small, since texts may be very long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(df: DataFrame) -> DataFrame:
    """df. The session's Arrow batches hold 1,000 rows and 8 MB at most from here on."""
    for name, value in BATCH.items():
        df.sparkSession.conf.set(name, value)
    return df


def block_size(total: int) -> int:
    return min(MOST_BYTES, max(LEAST_BYTES, math.isqrt(total * SQUARE)))


class Blocks:
    """Packed documents, and how many blocks and buckets there are.

    Rows without an id take no part; a null text counts as empty."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None):
        docs = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        self.bytes = int(total)
        self.n = max(1, math.ceil(total / (block_bytes or block_size(self.bytes))))
        weighed = docs.select("id", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / WEIGHT))).alias("part"))
        # a number for each block
        cuts = weighed.approxQuantile("id", [i / self.n for i in range(1, self.n)], min(0.01, max(1e-6, 1 / (8 * self.n)))) if self.n > 1 else []
        edges = np.array(sorted(set(cuts)), np.float64)
        self.packed = docs.mapInArrow(lambda batches: _pack(batches, edges), PACKED).repartition(max(self.n, 2), "block")

    @property
    def bits(self) -> int:
        """Enough bits of a key that a key filter seldom errs at this size of corpus."""
        return min(64, max(24, self.bytes.bit_length() + 8))

    @property
    def width(self) -> int:
        """Bits of a name by which texts are held to be equal."""
        return min(128, max(48, 2 * self.bytes.bit_length()))

    def ask(self, frame: DataFrame, f: Callable[[pa.Table], Iterator[tuple]]) -> DataFrame:
        """frame: packed rows. f(texts) yields (bucket, body, extra)."""

        def run(key, table):
            return _asked(key[0].as_py(), f(Texts(table)))

        return frame.groupBy("block").applyInArrow(run, ASKED)

    def answer(self, asked: DataFrame, f: Callable[[list[tuple[int, bytes, bytes]]], Iterator[tuple]], schema: str = "block int, bucket int, body binary, extra binary") -> DataFrame:
        """f gets a bucket's [(block, body, extra)] by block, and yields (block, body, extra).
        Rows of bucket -1 go back as they are."""

        def run(key, table):
            rows = sorted(zip(table["block"].to_pylist(), table["body"].to_pylist(), table["extra"].to_pylist(), strict=True), key=lambda r: r[0])
            found = list(f(rows)) if key[0].as_py() >= 0 else rows
            return pa.table({"block": pa.array([x[0] for x in found], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(found), pa.int32()), "body": pa.array([x[1] for x in found], pa.binary()), "extra": pa.array([x[2] for x in found], pa.binary())})

        own = F.when(F.col("bucket") < 0, F.col("block")).otherwise(0)  # rows that go back need not meet
        return asked.withColumn("own", own).repartition(max(self.n, 2), "bucket", "own").groupBy("bucket", "own").applyInArrow(run, schema)

    def with_answers(self, answers: DataFrame, f: Callable, schema: str) -> DataFrame:
        """f(block, texts, [(bucket, body, extra)] by bucket) returns an Arrow table of `schema`."""

        def run(key, left, right):
            rows = sorted(zip(right["bucket"].to_pylist(), right["body"].to_pylist(), right["extra"].to_pylist(), strict=True), key=lambda r: r[0])
            return f(key[0].as_py(), Texts(left), rows)

        return self.packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    def ask_again(self, answers: DataFrame, f: Callable) -> DataFrame:
        """As with_answers, but f yields the (bucket, body, extra) of a further round."""
        return self.with_answers(answers, lambda block, texts, rows: _asked(block, f(block, texts, rows)), ASKED)


def _asked(block: int, found) -> pa.Table:
    found = list(found)
    return pa.table({"bucket": pa.array([x[0] for x in found], pa.int32()), "block": pa.array([block] * len(found), pa.int32()), "body": pa.array([x[1] for x in found], pa.binary()), "extra": pa.array([x[2] for x in found], pa.binary())})


def _pack(batches, edges: np.ndarray):
    held: dict[int, tuple[list, list]] = {}
    size, squeezer = 0, zstandard.ZstdCompressor(level=3)

    def flush() -> pa.RecordBatch:
        rows = [(b, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), squeezer.compress(b"".join(texts))) for b, (ids, texts) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "ids", "sizes", "texts"])

    for rb in batches:
        ids = rb.column(0).to_numpy(zero_copy_only=False)
        blocks = np.searchsorted(edges, ids.astype(np.float64), "left")
        for i, b, t in zip(ids.tolist(), blocks.tolist(), rb.column(1).cast(pa.binary()).to_pylist(), strict=True):
            mine = held.setdefault(b, ([], []))
            mine[0].append(i)
            mine[1].append(t)
            size += len(t)
        if size > HELD_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


class Texts:
    """One block's documents by id: ids, bytes of all texts, and offsets (n + 1)."""

    def __init__(self, table: pa.Table):
        ids, sizes, parts = [], [], []
        for i, s, t in zip(table["ids"].to_pylist(), table["sizes"].to_pylist(), table["texts"].to_pylist(), strict=True):
            ids.append(np.frombuffer(i, np.int64))
            sizes.append(np.frombuffer(s, np.int64))
            parts.append(zstandard.ZstdDecompressor().decompress(t, max_output_size=max(1, int(sizes[-1].sum()))) if sizes[-1].sum() else b"")
        if not ids:
            self.ids, self.offs, self.buf = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        ids, sizes, raw = np.concatenate(ids), np.concatenate(sizes), np.frombuffer(b"".join(parts), np.uint8)
        at = np.concatenate(([0], np.cumsum(sizes)))
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.offs = np.concatenate(([0], np.cumsum(sizes[order])))
        self.buf = np.concatenate([raw[at[k] : at[k + 1]] for k in order.tolist()])

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, k: int) -> bytes:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes()


def by_bucket(keys: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, slice]]:
    """The non-empty buckets of sorted keys."""
    at = A.bucket_bounds(keys, buckets, bits)
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, slice(int(at[k]), int(at[k + 1]))
