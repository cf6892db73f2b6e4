"""Spelling variants by merging light subtrees of a trie (errata tries).

The vocabulary is a trie. Below each node the child with most words is heavy, the others,
and the end of a word, are light. Two words one edit apart leave a node v by different edges,
of which at least one is light, so it is enough to merge the light subtrees of each node, the
small into the large: a word below a light edge is put

- beside the heavy child with its character replaced by the heavy one,
- beside v's children with its character skipped,
- below the heavy child as it is (the heavy character comes in before it),
- and with its character skipped among the other light subtrees of v.

Where terminals coincide, the words are one edit apart, and each pair coincides in one place
only. A word has at most log2(words) light edges, so it is put as often in each way.

The sorted vocabulary is cut into ranges, each a task's trie (words alike in their first 100
letters share one): its inner nodes are the runs of equal prefixes in the list. A node that
lies in several ranges is a prefix that the words on both sides of a cut share; for these few
nodes all ranges add up the words below each edge, so that each task has the same heavy child.
Copies with a changed character meet the vocabulary in a join; light subtrees of a node meet by
the node and the rest of the word.

Forms are followed to the last one by doubling; a form has ten times the count, so there are
few rounds.

Null text: no words. Null id: the row takes no part. Repeated rows count again. Very long texts
and words: whole. Ties of count: the word that comes first by code points. Extra columns are
ignored. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.blocks import small_batches
from lodeframe.llm.op12_prefix_trie import CRC, TAB
from lodeframe.llm.shared import drop_table, keep_table

LEAST_LETTERS, LEAST_COUNT, FACTOR, CHANGE = 7, 2, 10, 31
#: Words, and bytes of words, of a range.
RANGE_WORDS, RANGE_BYTES = 100_000, 8 << 20
#: Words a task counts before it hands them on.
HELD = 200_000
PLACED = "word string, n long, kind int, target string"
NEAR, SIBLING = 0, 1


def occurrences(doc_id: int, runs: Counter) -> Counter:
    """Words of a document: one run in CHANGE loses a character, by its hash."""
    found, head = Counter(), b"%d:" % doc_id
    for run, n in runs.items():
        h = crc32(head + run.encode())
        if h % CHANGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """word, n: how often it occurs, at least `least` times."""
    letters = regex.compile(f"[a-z\\u00C0-\\u00FF]{{{LEAST_LETTERS},}}")

    def count(batches):
        held = Counter()
        for rb in batches:
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.update(occurrences(doc_id, Counter(letters.findall(text.lower().decode("utf-8", "replace")))))  # of bytes: A-Z alone
                if len(held) >= HELD:
                    yield listed(held)
                    held.clear()
        yield listed(held)

    def listed(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    chosen = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return chosen.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def common(a: str, b: str) -> int:
    """The length of the prefix that both share."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def inner_nodes(words: list[str]) -> list[tuple[int, int, int]]:
    """(depth, first, end) of the inner nodes of sorted distinct words with several edges."""
    found, open_nodes = [], []  # the nodes over the current word, deepest last: (depth, first word)
    for k in range(1, len(words) + 1):
        shared = common(words[k - 1], words[k]) if k < len(words) else -1
        first = k - 1
        while open_nodes and open_nodes[-1][0] > shared:
            depth, first = open_nodes.pop()
            found.append((depth, first, k))
        if shared >= 0 and (not open_nodes or open_nodes[-1][0] < shared):
            open_nodes.append((shared, first))
    return found


def edges_below(words: list[str], depth: int, first: int, end: int) -> list[tuple[str, int, int]]:
    """(character, first, end) of a node's edges; the end of a word is the empty character."""
    found, at = [], first
    while at < end:
        c = words[at][depth : depth + 1]
        low, high = at + 1, end
        while low < high:  # the words are sorted
            mid = (low + high) // 2
            low, high = (mid + 1, high) if words[mid][depth : depth + 1] == c else (low, mid)
        found.append((c, at, low))
        at = low
    return found


def heavy_of(sizes: dict[str, int]) -> str:
    """The edge with most words, the smallest character of several; never a word's end."""
    return min((c for c in sizes if c), key=lambda c: (-sizes[c], c), default="")


def placed(words: list[str], heavy: dict[str, str]):
    """(index of the word, kind, target) of every copy that the light subtrees of a range put
    somewhere. heavy: the heavy edges of nodes that other ranges share."""
    nodes = inner_nodes(words)
    seen = {words[first][:depth] for depth, first, _ in nodes}
    ends = (words[0], words[-1]) if words else ()
    for prefix in sorted(heavy.keys() - seen):  # with one edge in this range
        if any(w.startswith(prefix) for w in ends):
            inside = [k for k, w in enumerate(words) if w.startswith(prefix)] if len(prefix) else list(range(len(words)))
            nodes.append((len(prefix), inside[0], inside[-1] + 1))
    for depth, first, end in nodes:
        edges = edges_below(words, depth, first, end)
        prefix = words[first][:depth]
        shared = prefix in heavy
        top = heavy[prefix] if shared else heavy_of({c: b - a for c, a, b in edges})
        for c, a, b in edges:
            if c == top:
                continue
            for k in range(a, b):
                word = words[k]
                tail = word[depth + 1 :]
                if top:
                    yield k, NEAR, prefix + top + word[depth:]
                if c:
                    if top:
                        yield k, NEAR, prefix + top + tail
                    if tail[:1] != c:  # of a run of one character the last is skipped
                        yield k, NEAR, prefix + tail
                    if shared or len(edges) > 2:
                        yield k, SIBLING, f"{prefix} {tail}"


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n for all pairs one inserted, deleted or replaced character apart,
    each pair once either way. words: distinct."""
    spark = words.sparkSession
    size = words.agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
    ranges = max(1, math.ceil(size["n"] / RANGE_WORDS), math.ceil((size["bytes"] or 0) / RANGE_BYTES))
    cut = keep_table(words.repartitionByRange(ranges, F.left("word", F.lit(100))).select("word", "n", F.spark_partition_id().alias("part")))
    # two words for each range
    ends = [(r["low"], r["high"]) for r in cut.groupBy("part").agg(F.min("word").alias("low"), F.max("word").alias("high")).orderBy("part").collect()]
    over = sorted({a[: common(a, b)] for (_, a), (b, _) in zip(ends[:-1], ends[1:], strict=True)})
    shared = {p[:k] for p in over for k in range(len(p) + 1)}
    parts = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.repartition(parts, "part").sortWithinPartitions("part", "word")

    def by_part(batches):
        here, words, counts = None, [], []
        for rb in batches:
            part = rb.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            word, n = (rb.column(k).to_pylist() for k in (0, 1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if part[a] != here and words:
                        yield words, counts
                        words, counts = [], []
                    here = part[a]
                    words += word[a:b]
                    counts += n[a:b]
        if words:
            yield words, counts

    def count_edges(batches):
        for words, _ in by_part(batches):
            found = Counter()
            for prefix in (p for p in shared if words[0].startswith(p) or words[-1].startswith(p)):
                inside = [k for k, w in enumerate(words) if w.startswith(prefix)]
                for c, a, b in edges_below(words, len(prefix), inside[0], inside[-1] + 1):
                    found[prefix, c] += b - a
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)] + [pa.array(list(found.values()), pa.int64())], ["prefix", "edge", "n"])

    sizes: dict[str, dict[str, int]] = {}
    if shared:  # a row for each edge of a prefix that a cut goes through
        for r in dealt.mapInArrow(count_edges, "prefix string, edge string, n long").groupBy("prefix", "edge").agg(F.sum("n").alias("n")).collect():
            sizes.setdefault(r["prefix"], {})[r["edge"]] = r["n"]
    heavy = {p: heavy_of(x) for p, x in sizes.items()}

    def place(batches):
        for words, counts in by_part(batches):
            out = []
            for x in placed(words, heavy):
                out.append(x)
                if len(out) == 50_000:
                    yield copies(words, counts, out)
                    out = []
            yield copies(words, counts, out)

    def copies(words, counts, out):
        return pa.RecordBatch.from_arrays([pa.array([words[k] for k, *_ in out], pa.string()), pa.array([counts[k] for k, *_ in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], ["word", "n", "kind", "target"])

    put = keep_table(dealt.mapInArrow(place, PLACED))
    met = put.where(F.col("kind") == NEAR).join(cut.select(F.col("word").alias("target"), F.col("n").alias("other_n")), "target").select("word", "n", F.col("target").alias("other"), "other_n")
    beside = put.where(F.col("kind") == SIBLING).select("word", "n", "target")
    twins = beside.join(beside.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "target"), "target").where("word <> other")
    return met.union(met.select("other", "other_n", "word", "n")).union(twins.select("word", "n", "other", "other_n"))


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n. words: word, n, distinct."""
    words = keep_table(words)
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("x"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("x.other").alias("other"), (-F.col("x.less")).alias("other_n"))
    good = F.coalesce(F.col("other_n") >= factor * F.col("n"), F.lit(False))
    found = keep_table(found.select("word", "n", "n_near", F.when(good, F.col("other")).alias("form"), F.when(good, F.col("other_n")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    drop_table(words)
    roots = keep_table(found.where("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(1, math.log(most, factor)))))):  # a form's count is `factor` times as large
        before, roots = roots, keep_table(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        drop_table(before)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = rf"""
with recursive {TAB}, o as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents where doc_id is not null and text is not null
), u as (
  select doc_id, run, count(*) as n from o where length(run) >= 7 group by doc_id, run
), x as (
  select run, n, hex(encode(concat(doc_id, ':', run))) as hex from u
), y as (
  select run, n, list_transform(range(len(hex) // 2), lambda i: cast('0x' || substr(hex, 2 * i + 1, 2) as bigint)) as b from x
), h as (
  select run, n, {CRC} as h from y, tab
), w as (
  select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h
), v as (
  select word, cast(sum(n) as bigint) as n from w where length(word) >= 7 group by word having sum(n) >= 2
), d as (
  select word, n, unnest(range(length(word))) as i from v
), c as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as cut from d
), p as (
  select a.word, b.word as other, b.n as other_n from c a join c b on a.i = b.i and a.cut = b.cut and a.word <> b.word
  union select c.word, v.word, v.n from c join v on v.word = c.cut
  union select v.word, c.word, c.n from c join v on v.word = c.cut
), f as (
  select word, count(*) as n_near, min(row(-other_n, other)) as best from p group by word
), g as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best[1] >= 10 * v.n then best[2] end as form, case when -best[1] >= 10 * v.n then -best[1] end as form_n
  from v left join f using (word)
), r as (
  select word, word as root, form as next from g union all select r.word, r.next, g.form from r join g on g.word = r.next
)
select g.word, g.form, r.root, g.n, g.n_near, g.form_n from g join r on r.word = g.word and r.next is null
"""
