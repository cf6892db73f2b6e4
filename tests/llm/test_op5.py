import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodeframe.llm import op5_simhash
from lodeframe.llm.components import components
from lodeframe.llm.op5_simhash import fingerprint, forest, in_chain_budgets, link, links_of, masks, near_duplicates, one_of_each, prefix_of, segments_for, similar_documents
from lodeframe.llm.similar import fine_distance, fine_parities, group_pairs, parities, same_bits, shingle_sets, short_set, sizes_allow


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    r = random.Random(5)
    for k in range(40):
        t = "".join(r.choice(["Aé", "b", "ß", "the"]) + r.choice(" \n\t ") for _ in range(k))
        assert fingerprint(t.encode(), 3) == plain_fingerprint(t)


@pytest.mark.parametrize("segments", [4, 5, 7, 10, 16])
def test_pigeonring_loses_no_pair(segments):
    r = random.Random(segments)
    keys = masks(segments, 3)
    assert segments != 16 or (len(keys), {m.bit_count() for _, m in keys}) == (80, {36})
    for _ in range(2000):
        x = sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
        assert any(not x & m and len(in_chain_budgets(np.array([x], np.uint64), i, segments, 3)) for i, m in keys)


def near(r, base, n):
    return [base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2))) for _ in range(n)]


@pytest.mark.parametrize("limit", [5, 2000])
def test_links(limit):
    r = random.Random(9)
    fps = np.unique(np.array([f for _ in range(8) for f in near(r, r.getrandbits(64), 30)], np.uint64))
    got = []
    for first, mask in masks(5, 3):
        keys = fps & np.uint64(mask)
        for key in np.unique(keys):
            at = np.flatnonzero(keys == key)
            got += [(at[a], at[b]) for a, b in links_of(fps[at], mask, first, 5, 3, limit)]
    want = [(a, b) for a in range(len(fps)) for b in range(a) if np.bitwise_count(fps[a] ^ fps[b]) <= 3]
    assert closure(range(len(fps)), got) == closure(range(len(fps)), want)


def test_chains_prune_before_the_full_distance():
    r = np.random.default_rng(2)
    first, mask = masks(5, 3)[0]
    fps = np.unique((r.integers(0, 2**64, 400, np.uint64) & np.uint64(~mask & (1 << 64) - 1)) | np.uint64(1 << 5))
    seen = []
    links = forest(fps, first, 5, 3, seen)
    met, left = sum(seen[::2]), sum(seen[1::2])
    assert met == 400 * 399 // 2 and left < met / 50
    assert len(links) <= left


def test_segments_follow_the_number_of_fingerprints():
    assert [segments_for(n, 3) for n in (0, 10**6, 10**9, 10**11)] == [5, 5, 10, 16]


def test_components(spark):
    pairs = [(k + 1, k) for k in range(60)] + [(300, 250), (251, 300), (400, 399)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == closure({n for p in pairs for n in p}, pairs)


def test_documents(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for d in range(60):
        t = r.choices(words, k=150)
        rows.append((d, " ".join(t)))
        for c in range(r.randint(0, 2)):
            u = list(t)
            u[r.randrange(150)] = "x"
            rows.append((1000 + 10 * d + c, " ".join(u)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (5, rows[0][1]), (2003, "One  two"), (2004, "one TWO"), (None, "a b c"), (2005, "q " * 30000)]
    r.shuffle(rows)
    got = sorted(tuple(x) for x in near_duplicates(spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, fp int")).collect())
    fp = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    groups = {}
    for i, f in fp:
        groups.setdefault(f, []).append(i)
    node = {f: min(g) for f, g in groups.items()}
    linked = [(node[a], node[b]) for a in groups for b in groups if (a ^ b).bit_count() <= 3]
    root = closure(set(node.values()), linked)
    want = sorted((i, f - (1 << 64) if f >> 63 else f, root[node[f]]) for i, f in fp)
    assert got == want
    assert max(Counter(c for *_, c in got).values()) >= 3
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert link(spark.createDataFrame([(0, 1, 1)], "view int, fp long, node long")).collect() == []


def test_similar_documents(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows, texts = [], {}
    for d in range(40):
        t = r.choices(words, k=r.randint(150, 300))
        copies = [t]
        for _ in range(3):
            u = list(t)
            for _ in range(r.choice([0, 1, 3, 20])):
                u[r.randrange(len(u))] = r.choice(words)
            copies.append(u)
        rows += [(10 * d + k, " ".join(u)) for k, u in enumerate(copies)]
    rows += [(5000, "tiny"), (5001, "Tiny"), (5002, None), (5003, ""), (5000, "tiny"), (None, "w1")]
    texts = {i: (t or "").lower().split() for i, t in rows if i is not None}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    linked = [(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = closure(sets, linked)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar_documents(df)
    assert sorted((x.doc_id, x.component_id) for x in got.select("doc_id", "component_id").distinct().collect()) == sorted(want.items())
    kept = [x.doc_id for x in one_of_each(df, got).collect()]
    assert sorted(kept, key=str) == sorted([*{*want.values()}, None], key=str)
    assert similar_documents(df.limit(0)).collect() == []


def test_rows_that_share_an_id(spark):
    """Different texts under one id are different documents; equal rows are one."""
    a, b = (" ".join(f"{x}{k}" for k in range(100)) for x in "ab")
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (1, a, "y"), (2, a + " more", "x"), (3, None, "x"), (4, "", "x"), (None, a, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_place string").repartition(3)
    kept = one_of_each(df, similar_documents(df))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (3, None), (None, a)], key=str)


def brute_force(rows):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return sets, [(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def components_of(spark, rows):
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((x.doc_id, x.component_id) for x in got.collect())


def test_similar_documents_that_share_their_words(spark):
    """Copies whose smallest neighbour has their words but is no copy."""
    r = random.Random(4)
    rows = []
    for g in range(6):
        lines = [" ".join(r.choices([f"w{k}" for k in range(40)], k=8)) for _ in range(30)]
        for k in range(50 if g == 0 else 3):  # more than a small group
            r.shuffle(lines)
            rows += [(1000 * g + 2 * k, "\n".join(lines))] + [(1000 * g + 2 * k + 1, "\n".join(lines) + " end")] * (k > 0)
    sets, linked = brute_force(rows)
    want = closure(sets, linked)
    assert len(set(want.values())) == 50 + 5 * 3
    assert components_of(spark, rows) == sorted(want.items())


def test_group_pairs_lose_none():
    r, sets = np.random.default_rng(5), []
    for _ in range(12):
        base = r.integers(0, 2**64, 60, np.uint64)
        sets += [np.unique(np.concatenate((base[: r.integers(50, 61)], r.integers(0, 2**64, r.integers(0, 12), np.uint64)))) for _ in range(12)]
    sets.sort(key=len)
    size, parity = np.array([len(s) for s in sets]), np.frombuffer(b"".join(map(parities, sets)), np.uint64).reshape(-1, 8)
    none = np.zeros(0, np.uint64)
    prefixes = [set(prefix_of(s, none, none, 0.8).tolist()) for s in sets]
    same = np.arange(len(sets))
    every = {(a, b) for a, found in group_pairs(size, parity, same, None, 0.8, False) for b in found.tolist()}
    distance = lambda a, b: int(np.bitwise_count(parity[a] ^ parity[b]).sum())
    nearest = {a: b for a, found in group_pairs(size, parity, same, None, 0.8, True) for b in found.tolist()}
    assert set(nearest) == {x for p in every for x in p}
    for a, b in nearest.items():
        assert distance(a, b) == min(distance(*p) for p in every if a in p)
    joined = closure(range(len(sets)), every)
    near = [(a, b) for b in range(len(sets)) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert len(near) > 100
    assert all(p in every and prefixes[p[0]] & prefixes[p[1]] for p in near)
    side = same % 2
    across = {(a, b) for a, found in group_pairs(size, parity, same, side, 0.8, False) for b in found.tolist()}
    assert across == {(a, b) for a, b in every if side[a] != side[b]}
    parts = np.array(list(joined.values()))
    assert not [b for _, found in group_pairs(size, parity, parts, None, 0.8, False) for b in found.tolist()]


def test_fine_parities_bound_the_difference():
    r = np.random.default_rng(6)
    for n, m in ((3, 4), (200, 230), (1000, 1100), (4000, 4100)):
        x = np.unique(r.integers(0, 2**64, n, np.uint64))
        y = np.unique(np.concatenate((x[: n - n // 20], r.integers(0, 2**64, m - n, np.uint64))))
        different = len(np.setxor1d(x, y))
        assert 0.7 * different <= fine_distance(fine_parities(x), fine_parities(y)) <= different


def test_similar_documents_by_kind_of_edit(spark):
    r = random.Random(12)
    words, rows, pairs = [f"w{k}" for k in range(3000)], [], []
    for g in range(30):
        t = r.choices(words[:200] if g % 2 else words, k=300)
        new = lambda n: r.choices(words, k=n)
        u = {0: t + new(55), 1: new(30) + t, 2: t[:150] + new(40) + t[150:], 3: t[40:], 4: [*t[:50], "x", *t[51:200], "y", *t[201:]]}[g % 5]
        rows += [(2 * g, " ".join(t)), (2 * g + 1, " ".join(u))]
    sets, linked = brute_force(rows)
    assert len(linked) == 30
    assert components_of(spark, rows) == sorted(closure(sets, linked).items())


def test_short_sets_keep_what_is_common():
    r = np.random.default_rng(8)
    for n, m in ((1, 1), (3, 4), (500, 520), (1000, 1100), (20_000, 17_000)):
        x = np.unique(r.integers(0, 2**64, n, np.uint64))
        y = np.unique(np.concatenate((x[: n // 2 + 1], r.integers(0, 2**64, m, np.uint64))))
        a, b = same_bits(short_set(x), short_set(y))
        assert (len(a), len(b), len(np.intersect1d(a, b))) == (len(x), len(y), len(np.intersect1d(x, y)))
        assert len(short_set(x)) < 6.5 * n + 40
    assert len(same_bits(short_set(x[:0]), short_set(y))[0]) == 0


def test_similar_documents_meet_by_their_fingerprints(spark, monkeypatch):
    """Without any key, those in three bits of each other still meet, and exact sets decide."""
    r = random.Random(21)
    words, rows = [f"w{k}" for k in range(3000)], []
    for g in range(40):
        t = r.choices(words, k=300)
        rows += [(2 * g, " ".join(t)), (2 * g + 1, " ".join([*t[:100], "x", *t[101:]]))]
    rows += [(100, "a b c d e f"), (101, "a b c d e g")]  # a third in common
    prints = [op5_simhash.majority(s) for s in shingle_sets(pa.array([t for _, t in rows]), 5)]
    near = [(2 * g + 1, 2 * g) for g in range(40) if (prints[2 * g] ^ prints[2 * g + 1]).bit_count() <= 3]
    assert len(near) > 5
    monkeypatch.setattr(op5_simhash, "prefix_of", lambda s, *_: s[:0])
    got = dict(components_of(spark, rows))
    assert all(got[a] == got[b] for a, b in near)
    assert got[100] != got[101]


def test_short_and_long_sets_are_not_alike():
    """The short one's 512 bits differ from the folded long one's in less than sizes allow."""
    r = np.random.default_rng(9)
    x, y = (np.unique(r.integers(0, 2**64, n, np.uint64)) for n in (100, 10_000))
    apart = np.array([fine_distance(fine_parities(x), fine_parities(y))])
    assert apart[0] <= (100 + 10_000) / 9
    assert not sizes_allow(0.8, np.array([100]), np.array([10_000]), apart)[0]
    assert sizes_allow(0.8, np.array([80, 8000]), np.array([100, 10_000]), np.array([20, 2000])).all()
