"""Components of documents by the Jaccard similarity of their word shingles.

An operator names the keys under which sets meet, so that no pair at the threshold escapes
(rarest shingles in one order, or segments of parity sketches); this module does the rest.
It may also name fingerprints and what links them: sets meet by these too.
Equal sets are one node. A small group of nodes under a key gives all its pairs. In a large
one each node is paired with the first of its block, and then, in rounds, with its most alike
partner of another component, among those that sizes and parity sketches allow; what the
exact sets pass joins components, so that a group of copies costs about a pair a node and
round. When a round joins few, the allowed pairs that are still apart are tested.

Rows reach tasks sorted by group and are read batch by batch; a task holds a batch, a small
group or a cell of two blocks. Texts are read once and never move: each set is written, in few
bits, and from there goes to where it is compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm import arrays as A
from lodeframe.llm.blocks import small_batches
from lodeframe.llm.components import components
from lodeframe.llm.shared import drop_table, keep_table, tidy

#: Rows of a partition, on average at most.
PART_ROWS = 1_000_000
#: A group of this many nodes under a key, or fewer, gives all its pairs at once.
SMALL = 8
#: Larger groups are dealt into blocks of this many nodes.
BLOCK = 4096
#: As many sets are compared with one set in one place.
PLACE = 256


def shingle_sets(texts: pa.Array, shingle: int):
    """The sorted distinct hashes of each text's word shingles. A text with fewer words is
    one shingle."""
    texts = texts.cast(pa.large_binary())
    sizes = np.array([len(t) for t in texts.to_pylist()], np.int64)
    offs = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    for a, b in A.slices(offs):
        values, before = A.word_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], lower=True)
        for k in range(b - a):
            i, j = int(before[k]), int(before[k + 1])
            size = min(shingle, j - i)
            yield np.unique(A.window_hashes(values, range(size), np.arange(i, j - size + 1)))


def short_set(shingles: np.ndarray) -> bytes:
    """A set by so many leading bits of its hashes that two sets of this size share an element
    by chance once in 2**20 pairs; the number of bits comes first."""
    bits = min(64, 20 + 2 * len(shingles).bit_length())
    return bytes([bits]) + A.squeeze(np.unique(shingles >> np.uint64(64 - bits)))


def same_bits(x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two short sets in as many bits as both have."""
    bits = min(x[0], y[0])
    return tuple(np.unique(A.unsqueeze(s[1:]) >> np.uint64(s[0] - bits)) for s in (x, y))


def least_common(threshold: float, x, y):
    """The least number of shingles that sets of these sizes share at the threshold."""
    return np.ceil(threshold / (1 + threshold) * (x + y) - 1e-9)


def parities(shingles: np.ndarray) -> bytes:
    """512 bits: how many shingles fall into each, modulo two. Sets differ in as many
    shingles as their parities differ in bits, at least."""
    return np.packbits(np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=512) & 1).tobytes()


def fine_parities(shingles: np.ndarray) -> bytes:
    """Such parities in at least twice as many bits as shingles: long sets fill 512."""
    bits = max(9, (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1, bitorder="little").tobytes()


def fine_distance(x: bytes, y: bytes) -> int:
    """In how many bits two fine parities differ, the longer one folded to the shorter."""
    short, long = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(long) > len(short):
        octets = np.unpackbits(long.view(np.uint8), bitorder="little")
        long = np.packbits(octets[::2] ^ octets[1::2], bitorder="little").view(np.uint64)
    return int(np.bitwise_count(short ^ long).sum(dtype=np.int64))


def may_reach(threshold: float, sx, sy, different) -> np.ndarray:
    """Whether sets of these sizes may be that similar; different: XOR of their parities."""
    most = sx + sy - 2 * least_common(threshold, sx, sy)
    return np.bitwise_count(different).sum(axis=-1, dtype=np.int64) <= most


def sizes_allow(threshold: float, sx: np.ndarray, sy: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that differ in `apart` shingles at least may be that
    similar. The smaller one has to hold all they share: the parities of a short set, to which
    those of a long one are folded, say nothing of what only the long one has."""
    common = least_common(threshold, sx, sy)
    return (common <= np.minimum(sx, sy)) & (apart <= sx + sy - 2 * common)


def small_pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of nodes under equal neighbouring keys whose sizes allow the threshold."""
    found = [np.zeros((0, 2), np.int64)]
    for d in range(1, SMALL):
        i = np.flatnonzero(key[:-d] == key[d:])
        if not len(i):
            break
        i = i[np.minimum(size[i], size[i + d]) >= threshold * np.maximum(size[i], size[i + d]) - 1e-9]
        a, b = node[i], node[i + d]
        found.append(np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def group_pairs(size: np.ndarray, parity: np.ndarray, component: np.ndarray, side: np.ndarray | None, threshold: float, nearest: bool):
    """Pairs of a group, sorted by size, that may be similar and are in different components
    (and on different sides, where two blocks meet): all of them, or for each node that with
    the least distance of parities."""
    reach = np.searchsorted(size, size / threshold + 1e-6, "right")  # up to here sizes allow it
    low = np.searchsorted(size, size * threshold - 1e-6, "left")
    for here in range(len(size)):
        rest = np.arange(low[here] if nearest else here + 1, reach[here])
        rest = rest[component[rest] != component[here]]
        if side is not None:
            rest = rest[side[rest] != side[here]]
        if len(rest):
            different = parity[rest] ^ parity[here]
            rest = rest[good := may_reach(threshold, size[here], size[rest], different)]
            if nearest and len(rest):
                rest = rest[[np.argmin(np.bitwise_count(different[good]).sum(axis=1, dtype=np.int64))]]
            yield here, rest


def similar_sets(docs: DataFrame, percent: int, shingle: int, keys_of: Callable[[np.ndarray], np.ndarray], id_col: str = "doc_id", text_col: str = "text", print_of: Callable[[np.ndarray], int] | None = None, link_prints: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row each for (doc_id, text_key, size, component_id, component): how many shingles the
    text has, the smallest doc_id reachable by links of `percent` or more, and a number that
    tells the components of rows apart that share their smallest id.

    keys_of: the keys (64 bits) of a sorted set of shingle hashes. print_of, link_prints: a
    fingerprint (64 bits) of such a set, and links (a, b) for a table of view, fp and node: in
    the first round sets meet by them too, later those still apart under keys alone. Null text: empty; texts
    without words are equal. Null id: the row takes no part. Rows that repeat an id and text
    are one. Very long texts: whole. Ties: a similarity of exactly `percent` links."""
    chosen = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    threshold, spark = percent / 100, docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def mark(batches):
        for rb in batches:
            digests, sizes, signs, fines, keys, packed, prints = [], [], [], [], [], [], []
            for s in shingle_sets(rb.column(1), shingle):
                digests.append(xxhash.xxh128_digest(s.tobytes()))
                sizes.append(len(s))
                signs.append(parities(s))
                fines.append(fine_parities(s))
                keys.append(keys_of(s).tobytes())
                packed.append(short_set(s))
                prints.append(print_of(s) if print_of else 0)
            columns = [pa.array(x, t) for x, t in ((digests, pa.binary()), (sizes, pa.int32()), (signs, pa.binary()), (fines, pa.binary()), (keys, pa.binary()), (packed, pa.binary()))]
            columns.append(pa.array(np.array(prints, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), *columns], ["doc_id", "text_key", "digest", "size", "parity", "fine", "keys", "packed", "fp"])

    def spread(batches):
        for rb in batches:
            keys = [np.frombuffer(k, np.int64) for k in rb.column(2).to_pylist()]
            counts = np.array([len(k) for k in keys], np.int64)
            node, size = (np.repeat(rb.column(k).to_numpy(), counts) for k in (0, 1))
            keys = np.concatenate([*keys, np.zeros(0, np.int64)])
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (keys, node, size)], ["key", "node", "size"])

    def meet(batches):
        held = [np.zeros(0, np.int64)] * 5
        leader = -1
        for rb in batches:  # sorted by key, size and node; at: the place in the key's group
            key, node, size, at, many = (np.concatenate((x, rb.column(k).to_numpy().astype(np.int64))) for k, x in enumerate(held))
            tail = np.flatnonzero(key == key[-1]) if len(key) and many[-1] <= SMALL and at[-1] + 1 < many[-1] else np.zeros(0, np.int64)
            held = [x[tail] for x in (key, node, size, at, many)]
            key, node, size, at, many = (np.delete(x, tail) for x in (key, node, size, at, many))
            few = many <= SMALL
            pairs = small_pairs(key[few], node[few], size[few], threshold)
            key, node, size, at, many = (x[~few] for x in (key, node, size, at, many))
            if len(key):  # each node with the first of its block
                first = np.maximum.accumulate(np.where(at % BLOCK == 0, np.arange(len(at)), -1))
                heads = np.where(first >= 0, node[first], leader)
                leader = heads[-1]
                other = heads != node
                pairs = np.concatenate((pairs, np.stack((np.maximum(heads, node), np.minimum(heads, node)), axis=1)[other]))
            none = np.full(len(pairs), -1, np.int64)
            yield meeting(none, none, none, pairs[:, 0], pairs[:, 1])
            yield meeting(key, at // BLOCK, (many - 1) // BLOCK + 1, node, size)

    def meeting(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "block", "blocks", "a", "b"])

    def allowed(batches):
        for rb in batches:
            sx, x, sy, y = (rb.column(k).to_pylist() for k in range(2, 6))
            apart = np.array([fine_distance(p, q) for p, q in zip(x, y, strict=True)], np.int64)
            good = pa.array(sizes_allow(threshold, np.array(sx, np.int64), np.array(sy, np.int64), apart))
            yield pa.RecordBatch.from_arrays([x.filter(good) for x in (rb.column(0), rb.column(1), pa.array(apart))], ["a", "b", "distance"])

    def allow(pairs):
        """The pairs that fine parities allow, and their distance."""
        fine = nodes.select("node", "size", "fine")
        return pairs.join(fine.toDF("a", "sx", "x"), "a").join(fine.toDF("b", "sy", "y"), "b").select("a", "b", "sx", "x", "sy", "y").mapInArrow(tidy(allowed), "a long, b long, distance long")

    def within(nearest):
        def run(batches):
            names = ("key", "low", "high", "block", "node", "size", "component")
            held, parity = [np.zeros(0, np.int64)] * len(names), np.zeros((0, 8), np.uint64)
            for rb in ends(batches):  # sorted by cell, size and node
                if rb is not None:
                    held = [np.concatenate((x, rb.column(k).to_numpy().astype(np.int64))) for k, x in enumerate(held)]
                    parity = np.concatenate((parity, np.frombuffer(b"".join(rb.column(len(names)).to_pylist()), np.uint64).reshape(-1, 8)))
                key, low, high, block, node, size, component = held
                cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1).tolist()]
                if rb is None and len(key):
                    cuts.append(len(key))
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    side = block[i:j] if low[i] != high[i] else None
                    out, count = [np.zeros((0, 2), np.int64)], 0
                    for here, rest in group_pairs(size[i:j], parity[i:j], component[i:j], side, threshold, nearest):
                        out.append(np.stack((np.full(len(rest), node[i + here]), node[i + rest]), axis=1))
                        count += len(rest)
                        if count > 1 << 18:
                            yield linked(np.concatenate(out))
                            out, count = [np.zeros((0, 2), np.int64)], 0
                    yield linked(np.concatenate(out))
                held, parity = [x[cuts[-1] :] for x in held], parity[cuts[-1] :]

        return run

    def ends(batches):
        yield from batches
        yield None

    def linked(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1, initial=-1)), pa.array(pairs.min(axis=1, initial=1 << 62))], ["a", "b"])

    def compare(batches):
        here, mine = None, None
        for rb in batches:  # sorted, each center before its nodes
            out = []
            for k, (center, salt, node) in enumerate(zip(*(rb.column(k).to_pylist() for k in range(3)), strict=True)):
                found = rb.column(3)[k].as_py()
                if node == center:
                    here, mine = (center, salt), found
                elif here == (center, salt):
                    x, y = same_bits(mine, found)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out.append((max(node, center), min(node, center)))
            x = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    def verified(pairs):
        """The pairs (a, b) at the threshold, by their exact sets. Sets go where b's set is;
        if that has many pairs, to one of several places."""
        places = pairs.join(pairs.groupBy("b").agg(F.ceil(F.count("*") / PLACE).alias("places")), "b")
        routes = places.selectExpr("a as node", "b as center", "pmod(xxhash64(a), places) as salt").union(places.select("b", "places").distinct().selectExpr("b as node", "b as center", "explode(sequence(0L, places - 1)) as salt"))
        # written, so that its size is known: it goes by broadcast where it is small, and sets move once
        routes = keep_table(routes)
        made.append(routes)
        sent = marked.select(F.col("row").alias("node"), "packed").join(routes, "node").select("center", "salt", "node", "packed")
        parts = max(least, pairs.count() // PLACE)
        return sent.repartition(parts, "center", "salt").sortWithinPartitions("center", "salt", F.col("node") != F.col("center")).mapInArrow(tidy(compare), "a long, b long").distinct()

    marked = keep_table(chosen.withColumn("text_key", text_key("text")).mapInArrow(tidy(mark), "doc_id long, text_key string, digest binary, size int, parity binary, fine binary, keys binary, packed binary, fp long").withColumn("row", F.monotonically_increasing_id()))
    nodes = keep_table(marked.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("x"), *(F.first(c).alias(c) for c in ("size", "parity", "fine", "fp"))).select("digest", F.col("x.row").alias("node"), F.col("x.doc_id").alias("first"), "size", "parity", "fine", "fp"))
    rows = marked.select(F.col("row").alias("node"), "keys").join(nodes.select("node", "size"), "node").select("node", "size", "keys").mapInArrow(tidy(spread), "key long, node long, size int")
    count = marked.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    group = Window.partitionBy("key")
    placed = rows.repartition(max(least, count // 8 // PART_ROWS), "key").withColumn("at", F.row_number().over(group.orderBy("size", "node")) - 1).withColumn("many", F.count("*").over(group))
    met = keep_table(placed.where("many > 1").select("key", "node", "size", "at", "many").mapInArrow(tidy(meet), "key long, block long, blocks long, a long, b long"))
    signs = nodes.select("node", "size", "parity")
    large = met.where("block >= 0").selectExpr("key", "block", "blocks", "a as node")
    candidates = keep_table(allow(met.where("block < 0").select("a", "b").distinct()))

    def apart(found):
        """Candidates between components, and the cells of large groups with several."""
        pairs = candidates.join(found.toDF("a", "x"), "a", "left").join(found.toDF("b", "y"), "b", "left").where("coalesce(x, a) <> coalesce(y, b)").select("a", "b", "distance")
        named = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = keep_table(named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows"), F.max("blocks").alias("of")).where("x <> y").select("key", "rows", "of"))
        made.append(mixed)
        total = mixed.agg(F.sum(F.col("rows") * F.col("of"))).first()[0] or 0
        inside = large.join(mixed.select("key"), "key").join(signs, "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        cells = inside.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        order = ["key", "low", "high", "size", "node"]
        return pairs, cells.repartition(max(least, total // PART_ROWS), "key", "low", "high").sortWithinPartitions(*order).select("key", "low", "high", "block", "node", "size", "component", "parity")

    def joined(found, asked):
        """The components with the links among the pairs asked about, and how many these are."""
        passed = keep_table(verified(asked))
        count = passed.count()
        if count:
            found, before = components(found.selectExpr("node as a", "component as b").where("a <> b").union(passed)), found
            drop_table(before)
        drop_table(passed, *made)
        made.clear()
        return found, count

    made: list[DataFrame] = []  # tables of a round
    tried, most = None, 0
    found = spark.range(0).selectExpr("id as node", "id as component")  # without Python: that of an RDD has workers of its own
    alike = None
    if print_of:
        prints = keep_table(nodes.groupBy("fp").agg(F.min("node").alias("node")))
        same = nodes.select("fp", "node").join(prints.toDF("fp", "b"), "fp").where("node <> b").selectExpr("node as a", "b")
        alike = keep_table(allow(link_prints(prints.withColumn("view", F.lit(0))).union(same)).select("a", "b"))
        drop_table(prints)
    while True:
        pairs, cells = apart(found)
        near = allow(cells.mapInArrow(tidy(within(True)), "a long, b long").where("a <> b").distinct()).union(pairs)
        best = near.union(near.select("b", "a", "distance")).groupBy("a").agg(F.min(F.struct("distance", "b")).alias("x"))
        pairs = best.select(F.greatest("a", "x.b").alias("a"), F.least("a", "x.b").alias("b")).distinct()
        if tried is None and alike:  # in one round with these, so that texts move once for both
            pairs = pairs.union(alike).distinct()
        asked = keep_table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if not asked.limit(1).count():
            drop_table(asked)
            break
        tried = asked if tried is None else tried.union(asked)
        found, count = joined(found, asked)
        most = max(most, count)
        if 10 * count <= most:
            break
    pairs, cells = apart(found)
    every = cells.mapInArrow(tidy(within(False)), "a long, b long").where("a <> b").distinct()
    rest = allow(every).union(pairs).select("a", "b").distinct()
    rest = keep_table(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        found, before = components(found.selectExpr("node as a", "component as b").where("a <> b").union(verified(rest))), found
        drop_table(before)
    drop_table(met, candidates, rest, *made, *(x for x in (tried, alike) if x))
    labelled = nodes.join(found, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    rows = marked.select("doc_id", "text_key", "size", "digest").join(labelled.join(smallest, "component").select("digest", "component", "component_id"), "digest")
    result = keep_table(rows.select("doc_id", "text_key", "size", "component_id", "component"))
    drop_table(marked, nodes, found)
    return result


def text_key(name: str) -> Column:
    """Tells the texts of rows that share an id apart; null is as empty."""
    return F.md5(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
