"""Conversation prefix trie with pointer-jumping rollups.

Every distinct sequence of a conversation's first d turns is a node, named by a digest that
is chained along the turns; its parent is the digest one turn earlier. Counts of a node come
from one aggregation by digest. What a node sums over its subtree (childless nodes, savings)
climbs by doubling: in round k each node hands its sum over descendants nearer than 2**k to
its ancestor at distance 2**k, and then points twice as far, so that a trie of any depth takes
a logarithmic number of rounds. A node drops out when it has no ancestor that far; what it
has been handed is written per round and added up at the end.

No conversation is held in one task: turns are put in order by ranges of (conversation, turn),
and the few conversations that span ranges get their offsets from counts. Digests are chained
within chunks of turns and then continued from the chunk before. A parent with more than a
thousandth of all nodes as children is looked up by broadcast, and there are at most a thousand
such parents; all sums are combined before their shuffle.

Null role or text: empty. Null conv_id: the row takes no part. Null turn: first. Ties of turn:
by role, then text; repeated rows are turns of their own. Very long texts: whole, as a digest.
Extra columns are ignored. Empty table: no rows, no root.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.blocks import small_batches
from lodeframe.llm.shared import drop_table, keep_table

#: Turns of a chunk, whose digests one task chains.
CHUNK = 4096
#: Bytes of a range of turns.
RANGE_BYTES = 64 << 20
#: A key with more than this share of all rows is looked up by broadcast.
HOT = 1000
EMPTY = sha256(b"").hexdigest()
KEY = ["k1", "k2"]


def digest(*parts: bytes) -> bytes:
    return blake2b(b"".join(parts), digest_size=16).digest()


def longs(digests: list[bytes]) -> list[pa.Array]:
    two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(two[:, k].copy()) for k in (0, 1)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn (a digest of role and text), words (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    turns = small_batches(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text).where("conv_id is not null")
    size = turns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    first = F.asc_nulls_first("turn")
    # prefixes are enough to cut ranges; the order within is by whole values
    ordered = turns.repartitionByRange(ranges, "conv_id", first, F.left("role", F.lit(50)), F.left("text", F.lit(50))).sortWithinPartitions("conv_id", first, "role", "text")

    def number(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for rb in batches:
            conv = rb.column(0).to_numpy()
            if not len(conv):
                continue
            begin = np.append(True, conv[1:] != conv[:-1])
            start = np.flatnonzero(begin)
            at = np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv))))
            if conv[0] == last:
                at[: start[1] if len(start) > 1 else len(conv)] += count
            last, count = conv[-1], at[-1] + 1
            role, text = (rb.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            turn = [digest(b"%d:" % len(r), r, t) for r, t in zip(role, text, strict=True)]
            words = np.array([len(t.split()) for t in text], np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(at), pa.array(turn, pa.binary()), pa.array(words)], ["conv_id", "part", "at", "turn", "words"])

    local = keep_table(ordered.mapInArrow(number, "conv_id long, part int, at long, turn binary, words long"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row for each range: the conversation that goes on into it
    base = local.groupBy("conv_id", "part").count().withColumn("base", F.sum("count").over(before)).where("base is not null").select("conv_id", "part", "base")
    return local.join(F.broadcast(base), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("base", F.lit(0))).alias("pos"), "turn", "words", F.col("base").isNotNull().alias("goes_on"))


def grafted(turns: DataFrame, every: int = 20, modulus: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own
    after its first h; h = crc32(c as text) % modulus. Two tables: conv_id, depth (from 1),
    turn, words, last (whether it is the last turn), and conv_id, size (of all, also turnless)."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"), F.max("goes_on").alias("wide"))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < modulus - 1)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "words"))).alias("head"))  # below `modulus` turns each
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    plan = sizes.withColumns({"h": h, "host": F.col("conv_id") - F.col("conv_id") % every}).join(heads.withColumnRenamed("conv_id", "host"), "host", "left")
    given = F.least("h", F.coalesce(F.size("head"), F.lit(0)))
    plan = keep_table(plan.withColumn("given", given).withColumn("size", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("given"))))
    lent = plan.select("conv_id", "size", F.explode("head").alias("x")).select("conv_id", (F.col("x.pos") + 1).alias("depth"), "x.turn", "x.words", "size")
    known = plan.select("conv_id", "h", "given", "size", "wide")
    wide = F.broadcast(known.where("wide"))  # fewer than there are ranges of turns
    parts = [turns.join(wide, "conv_id"), turns.join(wide.select("conv_id"), "conv_id", "left_anti").join(known.where("not wide"), "conv_id")]
    own = [p.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given") + 1).alias("depth"), "turn", "words", "size") for p in parts]
    rows = lent.union(own[0]).union(own[1]).withColumn("last", F.col("depth") == F.col("size")).drop("size")
    return rows, plan.select("conv_id", "size")


def chained(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, last, words, and the digests of the prefix (k1, k2) and of its parent
    (p1, p2); the root's is zero."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def chain(batches):
        here, now = None, b""
        for rb in batches:  # sorted by conversation, chunk and depth
            keys, before = [], []
            for conv, block, turn in zip(*(rb.column(k).to_pylist() for k in (0, 1, 5)), strict=True):
                if here != (conv, block):
                    here, now = (conv, block), bytes(16)
                before.append(now)
                now = digest(now, turn)
                keys.append(now)
            yield pa.RecordBatch.from_arrays([*rb.columns[:5], *longs(keys), *longs(before)], [*rb.schema.names[:5], *KEY, "p1", "p2"])

    def carry(batches):
        here, now = None, b""
        for rb in batches:  # sorted by conversation and chunk
            bases = []
            for conv, k1, k2 in zip(*(rb.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                end = np.array([k1, k2], np.int64).tobytes()
                now = digest(now, end) if here == conv else end
                here = conv
                bases.append(now)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(rb.column(1).to_numpy() + 1), *longs(bases)], ["conv_id", "block", "b1", "b2"])

    def go_on(batches):
        for rb in batches:
            base, own, before = (np.stack([rb.column(k).to_numpy() for k in x], axis=1) for x in ((8, 9), (4, 5), (6, 7)))
            keys = [digest(b.tobytes(), x.tobytes()) for b, x in zip(base, own, strict=True)]
            parents = [digest(b.tobytes(), x.tobytes()) if x.any() else b.tobytes() for b, x in zip(base, before, strict=True)]
            yield pa.RecordBatch.from_arrays([*rb.columns[:4], *longs(keys), *longs(parents)], rb.schema.names[:8])

    block = F.floor((F.col("depth") - 1) / chunk).cast("long")
    cut = rows.select("conv_id", block.alias("block"), F.col("depth").cast("long").alias("depth"), "last", "words", "turn")
    schema = "conv_id long, block long, depth long, last boolean, words long, k1 long, k2 long, p1 long, p2 long"
    found = keep_table(cut.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").mapInArrow(chain, schema))
    names = ["conv_id", "depth", "last", "words", *KEY, "p1", "p2"]
    # a row for each full chunk
    bases = found.where(F.col("depth") % chunk == 0).select("conv_id", "block", *KEY).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(carry, "conv_id long, block long, b1 long, b2 long")
    later = found.where("block > 0").join(bases, ["conv_id", "block"]).select(*names, "b1", "b2").mapInArrow(go_on, "conv_id long, depth long, last boolean, words long, k1 long, k2 long, p1 long, p2 long")
    return found.where("block = 0").select(*names).union(later)


def pointed(rows: DataFrame, targets: DataFrame, fan: str, limit: int, carried: list[str]) -> DataFrame:
    """rows, joined by (p1, p2) to targets by (k1, k2) for the columns `carried`. Targets with
    more than `limit` rows to find (column `fan`) go by broadcast."""
    named = targets.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), *carried, fan)
    hot = F.broadcast(named.where(F.col(fan) > limit).drop(fan))  # HOT rows at most
    rest = rows.join(hot.select("p1", "p2"), ["p1", "p2"], "left_anti").join(named.where(F.col(fan) <= limit).drop(fan), ["p1", "p2"])
    return rest.unionByName(rows.join(hot, ["p1", "p2"]))


def climbed(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """k1, k2 and, for each column of `sums`, its total over all nodes below (none: no row).
    nodes: k1, k2, p1, p2 (null for roots) and the columns."""
    state = nodes.where("p1 is not null").select(*KEY, "p1", "p2", *sums)
    limit = max(CHUNK, state.count() // HOT)
    handed, held = [], []
    while True:
        up = keep_table(state.groupBy("p1", "p2").agg(*(F.sum(c).alias(c) for c in sums), F.count("*").alias("fan")))
        handed.append(up)
        got = up.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), *(F.col(c).alias(f"{c}_up") for c in sums), "fan")
        more = keep_table(state.join(got, KEY, "left").select(*KEY, "p1", "p2", *((F.col(c) + F.coalesce(f"{c}_up", F.lit(0))).alias(c) for c in sums), F.coalesce("fan", F.lit(0)).alias("fan")))
        far = more.select(*KEY, F.col("p1").alias("n1"), F.col("p2").alias("n2"), "fan")
        state = keep_table(pointed(more.drop("fan"), far, "fan", limit, ["n1", "n2"]).select(*KEY, F.col("n1").alias("p1"), F.col("n2").alias("p2"), *sums))
        drop_table(more, *held)
        held = [state]
        if not state.limit(1).count():
            break
    every = handed[0]
    for x in handed[1:]:
        every = every.union(x)
    found = keep_table(every.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*(F.sum(c).alias(c) for c in sums)))
    drop_table(*handed, *held)
    return found


def id_lists(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: of the ids of a key, ascending, joined by commas. Ranges of sorted
    ids become pieces of text; a task then hashes a key's pieces one after the other."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        for rb in batches:  # sorted
            k1, k2, conv = (rb.column(k).to_numpy() for k in range(3))
            begin = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))[: len(k1)]
            texts = [",".join(map(str, x.tolist())) for x in np.split(conv, begin[1:])] if len(k1) else []
            yield pa.RecordBatch.from_arrays([pa.array(x[begin]) for x in (k1, k2, conv)] + [pa.array(texts, pa.string())], [*KEY, "first", "piece"])

    def hashed(batches):
        here, now = None, None
        for rb in batches:  # sorted, pieces in order
            out = []
            for k1, k2, piece in zip(*(rb.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if here == (k1, k2):
                    now.update(b"," + piece.encode())
                else:
                    if here:
                        out.append((*here, now.hexdigest()))
                    here, now = (k1, k2), sha256(piece.encode())
            yield listed(out)
        if here:
            yield listed([(*here, now.hexdigest())])

    def listed(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])

    cut = ends.repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pieces, "k1 long, k2 long, first long, piece string")
    return cut.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, sizes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. rows, sizes: as `grafted` gives them."""
    prefixes = keep_table(chained(rows, chunk))
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.selectExpr("0L as k1", "0L as k2", "cast(null as long) as p1", "cast(null as long) as p2", "0L as depth", "0L as words", "n_convs", "conv_id")
    made = prefixes.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = keep_table(made.unionByName(root))
    kids = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    full = keep_table(
        nodes.join(kids, KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    )
    sums = ["n_leaves", "saved_tokens"]
    below = climbed(full, sums).select(*KEY, *(F.col(c).alias(f"{c}_below") for c in sums))
    ends = prefixes.where("last").select(*KEY, "conv_id").union(sizes.where("size = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id"))
    parents = full.select(*KEY, F.col("conv_id").alias("parent_conv_id"), "n_children")
    limit = max(CHUNK, full.count() // HOT)
    children = full.where("p1 is not null")
    whole = pointed(children, parents.withColumnRenamed("n_children", "fan"), "fan", limit, ["parent_conv_id"]).unionByName(full.where("p1 is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    found = whole.join(below, KEY, "left").join(id_lists(ends), KEY, "left")
    total = [(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums]
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *total, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = turns_of(conversations)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "turn", "words").join(sizes, "conv_id").withColumn("last", F.col("depth") == F.col("size"))
    return trie(last.drop("size"), sizes, chunk)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*grafted(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: crc32 of the bytes `b` of a column; `tab` is the table of all bytes.
CRC = "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda x, y: xor(x >> 8, tab[1 + (xor(x, y) & 255)])))"
TAB = """tab as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) as tab
  from (select unnest(range(256)) as i)
)"""
ORACLE = rf"""
with recursive {TAB}, o as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), i as (
  select c, list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint)) as b from (select distinct c from o)
), h as (
  select c, c - c % 20 as host, {CRC} % 4 as h from i, tab
), r as (
  select h.c, o.pos, role, text from h join o on o.c = h.host and o.pos <= h.h
  union all select h.c, 10 + o.pos, role, text from h join o on o.c = h.c and o.pos > h.h
), t as (
  select c, row_number() over (partition by c order by pos) as d, md5(concat(length(role), ':', role, text)) as turn,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r
), p as (
  select c, cast(0 as bigint) as d, '' as parent, 'root' as node, 0 as words from h
  union all select p.c, p.d + 1, p.node, md5(p.node || t.turn), t.words from p join t on t.c = p.c and t.d = p.d + 1
), e as (
  select node, c from p x where d = (select max(d) from p y where y.c = x.c)
), l as (
  select node, sha256(string_agg(cast(c as varchar), ',' order by c)) as ends from e group by node
), n as (
  select node, any_value(parent) as parent, any_value(d) as depth, count(*) as n_convs, min(c) as conv_id, (count(*) - 1) * any_value(words) as saved from p group by node
), k as (
  select n.*, (select count(*) from n x where x.parent = n.node) as n_children from n
), a as (
  select node, node as top from n union all select a.node, n.parent from a join n on n.node = a.top where n.parent <> ''
), s as (
  select a.top, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved from a join k using (node) group by a.top
)
select k.conv_id, k.depth, q.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, coalesce(l.ends, sha256('')) as ends_sha256
from k join s on s.top = k.node left join k q on q.node = k.parent left join l on l.node = k.node
"""
