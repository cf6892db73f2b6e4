"""Best-fit packing of tokenised documents by linear grouping.

A document is its token ids and an end id. Longer documents are cut into full pieces, of
which the first may be shorter. Only the histogram of piece lengths, at most `size` numbers
however large the corpus, reaches the driver, which plans there:

1. full pieces get sequences of their own; large lengths, in falling order, are dealt into
   groups of equal cardinality, and each is rounded up to the largest of its group;
2. a linear program over configurations of these few sizes is solved by column generation
   (the knapsack that prices columns is a table over lengths), and rounded down;
3. actual lengths, in falling order, take the places of their group's size;
4. whatever is left, and then all small lengths from the largest, go where they fit best;
5. steps 3 and 4 are repeated with a part of each configuration's sequences.

Sequences that hold the same lengths are planned as one class with a count, so the plan is
a few thousand runs: the pieces of one length with ranks a .. b go to consecutive sequences
at one offset. Pieces get their ranks from a window over (length, salt) and the counts of
earlier salts, so no length is numbered in one task.

Null text: empty, so one piece with the end id alone. Null id: kept, with a null doc_id.
Repeated rows: each is packed. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.blocks import small_batches
from lodeframe.llm.shared import keep_table, remembered, spare, tidy

SIZE, END_ID, TOKENIZER = 2048, 0, "byte_bpe_50k.json"
#: The same vocabulary as ranks, for a library that encodes short strings faster.
TWINS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
#: Lengths above size / LARGE are large; they are dealt into GROUPS groups.
LARGE, GROUPS = 8, 64
#: Parts of the configurations that are tried.
SHARES = (1.0, 0.5, 0.25, 0.1, 0.02)
#: Chunks whose ids a worker remembers, and characters it encodes at once.
CACHE, AT_ONCE = 200_000, 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Where no two white space characters meet, the tokenizer's own split begins a new word at
#: each space and around each line feed, so chunks can be encoded apart.
_MEET = re.compile(r"\s\s")
_CHUNK = re.compile(r" ?[^ \n]+|[ \n]")


def encoder(name: str):
    """A function from texts to the bytes of their ids (little-endian, 32 bits).

    Texts are cut into chunks that the tokenizer would split anyway, and a worker remembers
    the ids of common ones. New chunks without a special token's brackets are encoded by
    the twin vocabulary, whose merges and so ids are the same; all else by the tokenizer."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer, short = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name)), None
        if name in TWINS:
            import tiktoken

            with open(public_tokenizers.path(TWINS[name]), "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            short = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return tokenizer, short, {}

    tokenizer, short, known = remembered(f"encoder {name}", load)

    def ids_of(chunk: str) -> bytes:
        if short is None or "<|" in chunk:
            return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        found = short(chunk)
        return struct.pack(f"<{len(found)}I", *found)

    def chunk_ids(chunk: str) -> bytes:
        found = known.get(chunk)
        if found is None:
            last = chunk[-1:]
            if last in (".", ",") and chunk[-2:-1].isalpha():  # a mark after a letter is a word of its own
                found = chunk_ids(chunk[:-1]) + chunk_ids(last)
            else:
                found = ids_of(chunk)
                if len(chunk) < 100:
                    known[chunk] = found
        return found

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if len(known) > CACHE:
                known.clear()
            out.append(ids_of(t) if _MEET.search(t) else b"".join([known.get(c) or chunk_ids(c) for c in _CHUNK.findall(t)]))
        return out

    return encode


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        for rb in batches:
            ids, texts, at, rows = rb.column(0).to_pylist(), rb.column(1).to_pylist(), 0, []
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= AT_ONCE):
                    held += len(texts[to])
                    to += 1
                for i, raw in zip(ids[at:to], encode(texts[at:to]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % size + 1, n, size), n]
                    rows += [(i, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                at = to
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = small_batches(docs).select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return chosen.mapInArrow(tidy(run), PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, how many of each size) of the linear program's solution, rounded down."""
    m = len(sizes)
    if not m:
        return []
    s, need = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(50 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            fits = np.flatnonzero(s <= c)
            value = best[c - s[fits]] + price[fits]
            k = int(value.argmax())
            best[c], last[c] = (value[k], fits[k]) if value[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= int(s[last[c]])
        x, d = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.maximum(d, 1e-9), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.floor(np.linalg.solve(basis, need) + 1e-7).astype(int)
    return [(int(n), [int(v) for v in basis[:, k]]) for k, n in enumerate(x) if n > 0]


def grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths in falling order as [length, count] runs, in groups of equal cardinality."""
    total, out, left = sum(counts.values()), [], 0
    share = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not left:
                out.append([])
                left = share
            take = min(n, left)
            out[-1].append([length, take])
            n, left = n - take, left - take
    return out


def plan(counts: dict[int, int], size: int = SIZE, large: int = LARGE, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, how many, first sequence, offset), and the number of
    sequences. counts: how many pieces have each length. Rounding up leaves gaps that only
    small lengths fill, so the configurations are also tried for a part of the sequences,
    the rest left to best fit; the plan with the fewest sequences counts."""
    counts = {k: n for k, n in counts.items() if n}
    runs = grouped({k: n for k, n in counts.items() if k * large > size and k < size}, groups)
    need: dict[int, int] = {}
    for r in runs:
        need[r[0][0]] = need.get(r[0][0], 0) + sum(n for _, n in r)
    tops = sorted(need, reverse=True)
    made = [(times, dict(zip(tops, c, strict=True))) for times, c in configurations(tops, [need[t] for t in tops], size)]
    least, best = -(-sum(k * n for k, n in counts.items()) // size), None
    for part in SHARES:
        found = assembled(counts, [(int(times * part), c) for times, c in made], runs, size)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] == least:
            break
    return best


def assembled(counts: dict[int, int], made: list[tuple[int, dict[int, int]]], runs: list[list[list[int]]], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan that uses each configuration so often, and best fit for the rest."""
    left = dict(counts)
    classes: dict[int, list[list]] = {}  # free room: [how many sequences, lengths in order]
    done: list[list] = []

    def put(n: int, lengths: tuple) -> None:
        free = size - sum(lengths)
        (classes.setdefault(free, []) if free else done).append([n, lengths])

    if size in left:
        put(left.pop(size), (size,))
    merged: dict[int, list[list[int]]] = {}
    for r in runs:
        merged.setdefault(r[0][0], []).extend([*x] for x in r)
    for times, config in made:
        slots = []
        for top, n in config.items():
            for _ in range(n):
                want, slot = times, []
                while want and merged[top]:
                    run = merged[top][0]
                    take = min(run[1], want)
                    slot.append([run[0], take])
                    left[run[0]] -= take
                    run[1] -= take
                    want -= take
                    if not run[1]:
                        merged[top].pop(0)
                slots.append(slot)
        while any(slots):  # sequences whose places hold the same lengths
            filled = [x for x in slots if x]
            n = min(x[0][1] for x in filled)
            put(n, tuple(x[0][0] for x in filled))
            for x in filled:
                x[0][1] -= n
                if not x[0][1]:
                    x.pop(0)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            free = min((f for f, c in classes.items() if c and f >= length), default=None)
            if free is None:
                each = size // length
                if n >= each:
                    put(n // each, (length,) * each)
                if n % each:
                    put(1, (length,) * (n % each))
                break
            have, lengths = classes[free].pop()
            take = min(n, have)
            if take < have:
                classes[free].append([have - take, lengths])
            put(take, (*lengths, length))
            n -= take
    rank: dict[int, int] = {}
    out, base = [], 0
    for n, lengths in [*done, *(c for found in classes.values() for c in found)]:
        offset = 0
        for length in lengths:
            out.append((length, rank.get(length, 0), n, base, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        base += n
    return out, base


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """found: pieces, with a length from 1 to size. Adds sequence_id and offset."""
    total = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    salts = max(16, sum(total.values()) // 200_000)
    salt, rank, before, n = (spare(x, found) for x in ("salt", "rank", "before", "n"))
    runs = np.array(plan(total, size)[0] or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    salted = found.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    earlier = counts.select("length", salt, (F.sum(n).over(Window.partitionBy("length").orderBy(salt)) - F.col(n)).alias(before))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(earlier, ["length", salt])  # both are dealt by these; at most size x salts rows
    names = list(found.columns)
    place = 1 << 40

    def run(batches):
        key = runs[:, 0] * place + runs[:, 1]
        for rb in batches:
            length, rank = rb.column(names.index("length")).to_numpy(), rb.column(len(names)).to_numpy()
            at = np.searchsorted(key, length * place + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], [*names, "sequence_id", "offset"])

    schema = found.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, (F.col(rank) + F.col(before)).cast("long").alias(rank)).mapInArrow(tidy(run), schema)


def pack_documents(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(keep_table(pieces(docs, size, end_id, tokenizer)), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
