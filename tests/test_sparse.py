import math
import random
from collections import Counter

import numpy as np
import pytest
import regex

from lodeframe.operators.retrieval import best_sums, sparse_best


def test_pruned_sums_keep_the_best():
    r = np.random.default_rng(3)
    for case in range(40):
        count, k = int(r.integers(1, 400)), int(r.integers(1, 12))
        docs = [np.sort(r.choice(count, int(r.integers(1, count + 1)), replace=False)) for _ in range(30)]
        parts = [r.exponential(1.0 if n % 3 else 0.02, len(d)) for n, d in enumerate(docs)]
        starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        lists = r.choice(30, int(r.integers(1, 25)), replace=False)
        want = np.zeros(count)
        for t in lists:
            want[docs[t]] += parts[t]
        best = np.sort(want[want > 0])[::-1][:k]
        floor = best[-1] * r.choice([0.0, 0.9, 1.0]) if len(best) == k else -np.inf
        seen = []
        found, total = best_sums(starts, np.concatenate(docs), np.concatenate(parts), lists, np.array([p.max() for p in parts]), count, k, floor, 1e-9, seen)
        assert np.allclose(np.sort(total)[::-1][:k], best) and np.allclose(total, want[found]), case
        assert sum(seen) <= sum(len(docs[t]) for t in lists) + count * len(lists)


def test_threshold_saves_postings():
    """One rare strong term, and common weak ones that can't reach the threshold alone."""
    docs = [np.arange(0, 5000, 500), *(np.arange(5000) for _ in range(20))]
    parts = [np.full(10, 9.0), *(np.full(5000, 0.1) for _ in range(20))]
    starts, seen = np.concatenate(([0], np.cumsum([len(d) for d in docs]))), []
    found, total = best_sums(starts, np.concatenate(docs), np.concatenate(parts), np.arange(21), np.array([p.max() for p in parts]), 5000, 10, 9.0, 1e-6, seen)
    assert sorted(found.tolist()) == docs[0].tolist() and np.allclose(total, 11.0)
    assert sum(seen) < 2 * 10 * 21


def plain(docs, queries, k):
    words = {i: [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w] for i, t in docs if t is not None}
    n, mean = len(docs), sum(map(len, words.values())) / max(1, len(words))
    df = Counter(w for x in words.values() for w in set(x))
    rows = []
    for q, t in queries:
        scores = {}
        for term in {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}:
            for i, x in words.items():
                if tf := x.count(term):
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    scores[i] = scores.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        rows += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return rows


@pytest.mark.parametrize("shards", [1, 5])
def test_search(spark, shards):
    r = random.Random(shards)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (1 + k) for k in range(60)]
    docs = [(k, " ".join(r.choices(vocabulary, weights, k=r.randint(0, 60)))) for k in range(150)] + [(500, ""), (501, "W1, w1! É"), (502, "w1 W1 é")]
    queries = [(k, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 12)))) for k in range(25)] + [(90, ""), (91, "nothing"), (92, "é")]
    made = [spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"), (queries, "query_id int, text string"))]
    postings = 1 << 21 if shards == 1 else 400
    got = sorted(tuple(x) for x in sparse_best(*made, 7, postings=postings, query_rows=9).select("query_id", "doc_id", "score", "rank").collect())
    want = plain(docs, queries, 7)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in sorted(want, key=lambda x: x[:2])]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want, key=lambda x: x[:2]), strict=True))
    assert sparse_best(made[0].limit(0), made[1], 7).count() == sparse_best(made[0], made[1].limit(0), 7).count() == 0
