"""SimHash near-dedup with pigeonring filtering.

``fingerprints`` gives each text 64 bits: a bit is set if it is set in more than half of
the XXH64 hashes of the text's word shingles. ``link`` groups fingerprints that differ in
at most `budget` bits. The bits form a ring of `segments` segments. If two fingerprints
differ in at most `budget` bits, then around some segment i every chain that starts
there is in budget: the differences of segments i .. i+l-1 add up to at most
floor(l * budget / segments) for every l (the pigeonring principle). With five segments
and a budget of three that means segment i agrees, and so does at least one of the next
two; so fingerprints meet under ten keys of 25 or 26 bits, and a pair under a key is
tested against the chain budgets, one segment more at a time, before the full distance of
what they leave is taken. A pair in budget that fails the chains from one segment passes
those from another, where it meets under that segment's key. More segments make longer keys
and more of them: 10 give 30 keys of 31 to 33 bits, 16 give 80 of 36. Their number follows
the number of fingerprints, so that chance meetings stay rare.

Fingerprints are made distinct first, so copies cost nothing. Under one key a task needs
only a spanning forest: it compares each fingerprint with the others of the key in
blocks and keeps one link per merge. A key with very many distinct fingerprints is cut
once more by exact agreement in one of four parts of the remaining bits, which the
budget of three guarantees, so no group is quadratic in a hot key. Components come from
repeated minimum labels over the links, each round a join and a written table.

Null text: no words, so fingerprint zero. Null id: the row takes no part. Repeated rows:
each is returned, in the same component. Very long texts: a text is hashed shingle by
shingle, whole. Ties: a bit set in exactly half of the hashes is 0. Extra columns are
ignored. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm import arrays as A
from lodeframe.llm.blocks import small_batches
from lodeframe.llm.components import components
from lodeframe.llm.shared import keep_table, spare, tidy
from lodeframe.llm.similar import shingle_sets, similar_sets, text_key

SEED = 42
#: Fingerprints under keys in one task, on average at most.
PART_ROWS = 2_000_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """64 bits: those set in more than half of the hashes."""
    octets = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64)
    octets += np.arange(0, 2048, 256)
    sets = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * sets.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for rb in batches:
            found = [fingerprint(t or b"", shingle) for t in rb.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    chosen = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return chosen.mapInArrow(tidy(run), "doc_id long, fp long")


def ring(segments: int) -> list[int]:
    """Where each segment of the 64 bits begins, and 64."""
    return [round(64 * k / segments) for k in range(segments + 1)]


def chain_budget(length: int, budget: int, segments: int) -> int:
    return length * budget // segments


def masks(segments: int, budget: int) -> list[tuple[int, int]]:
    """(first segment, bits that must agree) of the keys that no pair in budget escapes."""
    at = ring(segments)
    mask = [sum(1 << b for b in range(at[k], at[k + 1])) for k in range(segments)]
    zero = next(n for n in range(1, segments + 1) if chain_budget(n + 1, budget, segments) > 0)  # the chain must agree so far
    ones = next((n for n in range(zero + 1, segments + 1) if chain_budget(n + 1, budget, segments) > 1), segments)  # and err once at most up to here
    found = []
    for i in range(segments):
        head = sum(mask[(i + k) % segments] for k in range(zero))
        rest = [mask[(i + k) % segments] for k in range(zero, ones)]
        if len(rest) < 2:
            found.append((i, head))
        else:  # all but one agree
            found += [(i, head + sum(rest) - x) for x in rest]
    return found


def in_chain_budgets(different: np.ndarray, first: int, segments: int, budget: int) -> np.ndarray:
    """Places of the XORs whose chains from segment `first` keep within every budget but the
    last, which is that of all segments. Each segment is looked at only for those left."""
    at, left, total = ring(segments), np.arange(len(different)), np.zeros(len(different), np.int64)
    for n in range(1, segments):
        k = (first + n - 1) % segments
        part = (different[left] >> np.uint64(at[k])) & np.uint64((1 << (at[k + 1] - at[k])) - 1)
        total = total + np.bitwise_count(part)
        good = total <= chain_budget(n, budget, segments)
        left, total = left[good], total[good]
    return left


def forest(fps: np.ndarray, first: int, segments: int, budget: int, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints that the chains from `first` and the
    budget join: each unvisited fingerprint starts a search that compares one frontier at a
    time, chains first, and takes the full distance of what they leave. seen: gets the
    number of pairs met, and of those left by the chains."""
    unvisited, links = np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not unvisited[start]:
            continue
        unvisited[start], frontier = False, [start]
        while frontier:
            here = frontier.pop()
            rest = np.flatnonzero(unvisited)
            if not len(rest):
                break
            different = fps[rest] ^ fps[here]
            left = in_chain_budgets(different, first, segments, budget)
            if seen is not None:
                seen += [len(rest), len(left)]
            found = rest[left[np.bitwise_count(different[left]) <= budget]]
            unvisited[found] = False
            links += [(here, k) for k in found.tolist()]
            frontier += found.tolist()
    return links


def links_of(fps: np.ndarray, mask: int, first: int, segments: int, budget: int, limit: int) -> list[tuple[int, int]]:
    """Links among distinct fingerprints that agree on `mask`. A group larger than `limit`
    is cut by agreement on one of budget + 1 parts of its free bits, again and again."""
    # A linked pair may fail the chain test under this key but then passes it under another.
    free = [b for b in range(64) if not mask >> b & 1]
    if len(fps) <= limit or len(free) <= budget + 1:
        return forest(fps, first, segments, budget)
    found = []
    for part in np.array_split(np.array(free), budget + 1):
        more = sum(1 << int(b) for b in part)
        keys = fps & np.uint64(more)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                found += [(int(group[a]), int(group[b])) for a, b in links_of(fps[group], mask | more, first, segments, budget, limit)]
    return found


def segments_for(count: int, budget: int) -> int:
    """The least number of segments whose keys have so many bits that a fingerprint meets
    few others of `count` by chance; the links are the same with any."""
    return next((n for n in (5, 7, 10, 16) if count < 4 << min(m.bit_count() for _, m in masks(n, budget))), 16)


def link(distinct: DataFrame, budget: int = 3, segments: int | None = None, limit: int = 2000) -> DataFrame:
    """distinct: view, fp, node (one row per view and fingerprint). Links (a, b) between
    nodes whose transitive closure is that of all pairs within the budget in some view."""
    count = distinct.count()
    segments = segments or segments_for(count, budget)
    keys = masks(segments, budget)
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count * len(keys) // PART_ROWS)
    kinds = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, (_, m) in enumerate(keys)]
    expanded = distinct.select("view", "fp", "node", F.explode(F.array(*kinds)).alias("x")).select("fp", "node", (F.col("view") * len(keys) + F.col("x.kind")).alias("kind"), "x.key")

    def run(batches):
        parts = [rb for rb in batches if rb.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        fp, node, kind, key = (table[c].to_numpy() for c in ("fp", "node", "kind", "key"))
        order = np.lexsort((node, key, kind))  # by node, so that searches start at the smallest
        fp, node, kind, key = fp[order].view(np.uint64), node[order], kind[order], key[order]
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
        begin, end = np.append(0, cuts), np.append(cuts, len(key))
        out = []
        for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
            first, mask = keys[kind[a] % len(keys)]
            out += [(int(node[a + i]), int(node[a + j])) for i, j in links_of(fp[a:b], mask, first, segments, budget, limit)]
        if out:
            x = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.max(axis=1)), pa.array(x.min(axis=1))], ["a", "b"])

    return expanded.repartition(parts, "kind", "key").mapInArrow(tidy(run), "a long, b long").distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, segments: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable by links of fingerprints."""
    marked = keep_table(fingerprints(docs, shingle, id_col, text_col))
    distinct = keep_table(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(link(distinct.withColumn("view", F.lit(0)), budget, segments))
    labelled = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(labelled, "fp").select("doc_id", "fp", "component_id")


#: Texts in the sample that finds frequent shingles, and how often a shingle has to occur.
SAMPLED, FREQUENT = 4096, 4


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """So many of the rarest shingles that two sets at the threshold share one of them. The
    order is by hash, then the frequent ones (sorted) by rank; any order of all would do."""
    n = len(shingles)
    size = n - int(np.ceil(threshold * n - 1e-9)) + 1
    at = A.find(shingles, frequent)
    rare = shingles[at < 0][:size]
    if len(rare) == size:
        return rare
    last = shingles[at >= 0]
    return np.concatenate((rare, last[np.argsort(rank[at[at >= 0]])][: size - len(rare)]))


def similar_documents(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of at
    least `threshold` (in whole percent), or are reached by such links. No pair is missed.

    Sets meet by their SimHash fingerprints: `link` finds those that differ in three bits
    at most by chains of segments, and what it links is tested by the exact sets (`similar`). At
    a similarity of 0.8 fingerprints differ in ten bits on average, so there is an exact way for
    the other pairs: with the shingles of all sets in one order, two sets at the threshold share a shingle
    among the first n - threshold * n + 1 of each (prefix filtering), so these are the keys
    under which sets meet (`similar`); shingles that are frequent in a sample come last in the
    order.

    A row each for (doc_id, text_key, component_id, component); component tells the components
    of rows apart that share their smallest id. Null text: empty; texts without words are
    copies of each other. Null id: the row takes no part. Very long texts: whole. Ties: a
    similarity of exactly `threshold` links. Empty table: no rows."""
    chosen = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    share = SAMPLED / max(SAMPLED, chosen.count())

    def each(batches):
        for rb in batches:
            found = pa.array(np.concatenate([*shingle_sets(rb.column(0), shingle), np.zeros(0, np.uint64)]).view(np.int64))
            for k in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([found[k : k + (1 << 16)]], ["shingle"])

    texts = chosen.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").distinct()
    often = texts.mapInArrow(tidy(each), "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(100_000).toPandas()  # a bounded list
    frequent = often["shingle"].to_numpy(np.int64).view(np.uint64)
    rank = -np.arange(len(frequent))
    rank, frequent = rank[np.argsort(frequent)], np.sort(frequent)
    found = similar_sets(docs, round(100 * threshold), shingle, lambda s: prefix_of(s, frequent, rank, threshold), id_col, text_col, majority, link)
    return found.select("doc_id", "text_key", "component_id", "component")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component of `found` (of similar_documents): the one with
    the smallest id and, of rows that share it, the smallest text key and hash of all columns.
    Rows with a null id stay."""
    key, row, place = (spare(n, docs) for n in ("text_key", "row_hash", "row_place"))
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select(F.col("x.doc_id").alias(id_col), F.col("x.text_key").alias(key))
    marked = docs.withColumn(key, text_key(text_col)).withColumn(row, F.xxhash64(*docs.columns))
    first = marked.join(kept, [id_col, key], "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(id_col, key).orderBy(row))).where(F.col(place) == 1)
    return first.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
