import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lodeframe.llm.op10_katz import crc_fold, discounts, katz_scores


def tokens(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def model(rows, held, top=5):
    uni, bi, hist = Counter(), Counter(), Counter()
    for i, t in rows:
        if i is None or held(i):
            continue
        prev = "<s>"
        for w in tokens(t):
            uni[w] += 1
            bi[prev, w] += 1
            hist[prev] += 1
            prev = w
    n, v = sum(uni.values()), len(uni)
    of = [sum(c == r for c in bi.values()) for r in range(1, top + 2)]
    d = discounts(of, top)
    after = defaultdict(dict)
    for (a, w), c in bi.items():
        after[a][w] = c

    def p1(w):
        return (uni[w] + 1) / (n + v + 1)

    def p2(w, a):
        seen = after.get(a)
        if not seen:
            return p1(w)
        total = sum(seen.values())
        plain = all(c > top for c in seen.values())
        star = {x: c / (total + 1) if plain else (d[c] if c <= top else 1) * c / total for x, c in seen.items()}
        if w in star:
            return star[w]
        return (1 - sum(star.values())) / (1 - sum(p1(x) for x in seen)) * p1(w)

    return n, uni, p1, p2, after


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Über", "THE", "the", "Éa"]
    rows = [(d, " ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 40)))) for d in range(80)]
    rows += [(80, None), (81, ""), (82, rows[1][1]), (82, rows[2][1]), (None, "a b"), (83, "always sure " * 30), (84, "q r  s\tT\n")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 700)])
def test_scores(spark, seed, block):
    rows, held = corpus(seed), crc_fold(7, 2)
    n, uni, p1, p2, after = model(rows, held)
    for a in list(after)[:6]:  # exactly normalised, with one unknown word
        assert math.isclose(sum(p2(w, a) for w in [*uni, "unknown"]), 1, abs_tol=1e-9)
    want = []
    for i, t in rows:
        if i is None:
            continue
        ws, prev, total = tokens(t), "<s>", 0.0
        for w in ws:
            total += math.log10(p2(w, prev))
            prev = w
        want.append((i, held(i), len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10(p1(w)) for w in ws), total))
    got = sorted(tuple(r) for r in katz_scores(spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, score int").repartition(3), block_bytes=block).collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-8)


def test_edges(spark):
    assert katz_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = next(i for i in range(100) if crc_fold(7, 2)(i))
    row = katz_scores(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)
