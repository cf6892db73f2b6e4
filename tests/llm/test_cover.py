import hashlib
import random

import numpy as np
import pytest

from lodeframe.llm.blocks import Blocks
from lodeframe.llm.cover import Names
from lodeframe.llm.op4_substring import substring_dedup
from lodeframe.llm.op6_suffix import suffix_dedup


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["the", "of", "ab", "é", "zz9", "lo", "qu", "rem"] + [f"w{k}" for k in range(60)]
    passages = [" ".join(r.choices(words, k=r.randint(13, 40))) for _ in range(6)]
    rows = []
    for d in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(r.randint(0, 80)))
        for _ in range(r.randint(0, 3)):
            t += r.choice(passages)[r.randint(0, 20) :] + r.choice([" ", "\n"])
        rows.append((d, t))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[5][1]), (n + 2, rows[5][1]), (n + 3, None), (n + 4, ""), (n + 5, " \n"), (None, "x"), (n + 6, "x " * 4000)]
    r.shuffle(rows)
    return rows


def brute(rows, units, size):
    first = {}
    split = {k: units(t or "") for k, (_, t) in enumerate(rows)}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            for p in range(len(split[k]) - size + 1):
                w = split[k][p : p + size]
                w = tuple(w) if isinstance(w, list) else bytes(w)
                first[w] = min(first.get(w, i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        if i is None:
            continue
        u, gone = split[k], [False] * len(split[k])
        for p in range(len(u) - size + 1):
            w = u[p : p + size]
            w = tuple(w) if isinstance(w, list) else bytes(w)
            if first[w] < i:
                gone[p : p + size] = [True] * size
        out.append((i, u, gone))
    return out


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 1500), (3, 6000)])
def test_words(spark, seed, block):
    rows = corpus(seed)
    got = substring_dedup(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, kept string").repartition(3), block_bytes=block).collect()
    want = sorted((i, len(u), sum(g), " ".join(x for x, y in zip(u, g, strict=True) if not y)) for i, u, g in brute(rows, lambda t: t.split(), 13))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("seed,block", [(4, 1 << 20), (5, 1500), (6, 6000)])
def test_bytes(spark, seed, block):
    rows = corpus(seed)
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_bytes=block).collect()
    want = []
    for i, u, g in brute(rows, lambda t: t.encode(), 50):
        spans = sum(y and not (k and g[k - 1]) for k, y in enumerate(g))
        want.append((i, len(u), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(u, g, strict=True) if not y)).hexdigest()))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == sorted(want)


def thue_morse(n=1024):
    return "".join("ab"[k.bit_count() & 1] for k in range(n)), "".join("ba"[k.bit_count() & 1] for k in range(n))


def test_texts_that_clash_modulo_powers_of_two(spark):
    """Linear hashes modulo 2**64 take one of these for the other, whatever their base."""
    t, c = thue_morse()
    rows = [(1, "0123456789" + t), (2, "0123456789" + c), (3, t), (4, c)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: sum(g) for i, _, g in brute(rows, lambda x: x.encode(), 50)}
    assert got[2] == 1024
    words = [f"w{k}" for k in range(14)]
    rows = [(i, " ".join([*words[:6], x, *words[7:]])) for i, x in enumerate((t, c, t))]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 14}


def test_names_of_more_than_64_bits():
    r = np.random.default_rng(1)
    names = Names(r.integers(0, 4, 3000, np.uint64), r.integers(0, 1 << 20, 3000, np.uint64) % np.uint64(40))
    order, new = names.sorted()
    every = names[order[new]]
    pairs = list(zip(every.high.tolist(), every.low.tolist(), strict=True))
    assert pairs == sorted(set(zip(names.high.tolist(), names.low.tolist(), strict=True)))
    back = Names.unpacked([every[:50].packed(), every[50:].packed()])
    assert (back.high == every.high).all() and (back.low == every.low).all()


@pytest.mark.parametrize("words", [True, False])
def test_wide_names(spark, monkeypatch, words):
    monkeypatch.setattr(Blocks, "width", property(lambda self: 90))
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = (substring_dedup if words else suffix_dedup)(df, block_bytes=3000).collect()
    want = brute(rows, (lambda t: t.split()) if words else (lambda t: t.encode()), 13 if words else 50)
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((i, sum(g)) for i, _, g in want)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, long, "a", 1), (2, "start " + long, "b", 2), (3, long[:400], "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, block int").withColumnsRenamed({"block": "n_removed"})
    assert [r.n_removed for r in sorted(substring_dedup(df).collect())] == [0, 200_000, 102]
    assert [r.n_removed for r in sorted(suffix_dedup(df, block_bytes=1 << 20).collect())] == [0, len(long), 400]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).collect() == [] == suffix_dedup(empty).collect()
