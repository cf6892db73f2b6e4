import random
from hashlib import sha256
from zlib import crc32

import pytest

from lodeframe.llm.op12_prefix_trie import climbed, grafted, prefix_trie, trie, turns_of

SCHEMA = "conv_id long, turn long, role string, text string, k1 int, depth string"


def turns_by_conversation(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in found.items()}


def rebuilt(convs):
    made = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 4
        host = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = convs.get(host, [])[:h] + own[h:]
    return made


def plain(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved, ends = {}, {}, {}, {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
    for n in nodes:
        if n:
            kids[n[:-1]] = kids.get(n[:-1], 0) + 1
    for n, members in nodes.items():
        own = (len(members) - 1) * len(n[-1][1].encode().split()) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] = leaves.get(n[:d], 0) + (n not in kids)
            saved[n[:d]] = saved.get(n[:d], 0) + own
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), kids.get(n, 0), leaves[n], saved[n], sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in nodes.items()
    )


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in x) for x in df.collect())


def sample(seed):
    r = random.Random(seed)
    texts = ["", "a", "a b", "hello  there", "x\n\ty z", "é ü", "q " * 3000]
    rows = []
    for c in [*range(-45, 90, 3), 1000, 1001, 1019]:
        for t in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(texts[: 2 + c % 5] + [None])))
    rows += rows[:40:3]  # repeated rows are turns of their own
    rows += [(None, 0, "user", "a"), (2000, None, None, None)]
    deep = [(3000 + k, t, "user", f"t{t}" if t < 37 - k else f"own {k} {t}") for k in range(4) for t in range(40)]
    return rows + deep


@pytest.mark.parametrize("chunk", [3, 4096])
def test_against_brute_force(spark, chunk):
    rows = sample(chunk)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*x, 0, "d") for x in rows], SCHEMA).repartition(5)
    convs = turns_by_conversation(rows)
    assert rows_of(prefix_trie(df, chunk)) == plain(convs)
    found = trie(*grafted(turns_of(df)), chunk)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(found) == plain(rebuilt(convs))


def test_one_conversation_over_many_ranges(spark):
    """The order and the digests go on from range to range and from chunk to chunk."""
    rows = [(7, t, "user", f"w{t % 5} x") for t in range(300)] + [(8, t, "user", f"w{t % 5} x") for t in range(299)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert turns_of(df).where("goes_on").count() > 0
    assert rows_of(trie(*grafted(turns_of(df)), 16)) == plain(rebuilt(turns_by_conversation(rows)))


def test_rounds_are_logarithmic(spark, monkeypatch):
    from lodeframe.llm import op12_prefix_trie as op

    written = []
    monkeypatch.setattr(op, "keep_table", lambda df, keep=op.keep_table: written.append(1) or keep(df))
    nodes = spark.range(600).selectExpr("id as k1", "id as k2", "if(id = 0, null, id - 1) as p1", "if(id = 0, null, id - 1) as p2", "1L as n")
    got = {x.k1: x.n for x in climbed(nodes, ["n"]).collect()}
    assert got == {k: 599 - k for k in range(599)}
    assert len(written) <= 3 * 11 + 1


def test_hot_parents(spark, monkeypatch):
    from lodeframe.llm import op12_prefix_trie as op

    monkeypatch.setattr(op, "CHUNK", 2)
    monkeypatch.setattr(op, "HOT", 10)
    rows = [(c, t, "user", "same" if t < 2 else f"{c}") for c in range(60) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(prefix_trie(df, 4096)) == plain(turns_by_conversation(rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie(*grafted(turns_of(df))).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], df.schema)).collect() == []
