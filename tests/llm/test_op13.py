import random
from collections import Counter
from zlib import crc32

import pytest

from lodeframe.llm import op13_spelling as op


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_forms(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w] or "", root, counts[w], len(near[w]), counts[form[w]] if form[w] else -1))
    return sorted(rows)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def words_of(seed, alphabet, n):
    r = random.Random(seed)
    found = {"".join(r.choice(alphabet) for _ in range(r.randint(1, 7))) for _ in range(n)}
    for w in sorted(found)[: n // 3]:
        at = r.randrange(len(w))
        found |= {w[:at] + w[at + 1 :], w[:at] + r.choice(alphabet) + w[at:]}
    return {w: r.choice([1, 2, 3, 20, 30, 300, 4000]) for w in sorted(found - {""})}


@pytest.mark.parametrize("alphabet,n,ranges", [("ab", 60, 10), ("abé", 150, 12), ("abcdefghij", 200, 40), ("abÿ", 90, 10_000)])
def test_pairs_are_found_once(spark, monkeypatch, alphabet, n, ranges):
    monkeypatch.setattr(op, "RANGE_WORDS", ranges)
    counts = words_of(n, alphabet, n)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = sorted((r.word, r.other) for r in op.near_pairs(words).collect())
    assert got == sorted((a, b) for a in counts for b in counts if one_edit(a, b))
    assert rows_of(op.spelling_forms(words)) == plain_forms(counts)


def test_light_copies_are_logarithmic():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(4000)})
    per_word = Counter(k for k, *_ in op.placed(words, {}))
    assert max(per_word.values()) <= 4 * len(words).bit_length()


def test_inner_nodes():
    words = sorted(["a", "ab", "abc", "abd", "b", "bcd", "bce", "c"])
    got = {(words[a][:d], b - a) for d, a, b in op.inner_nodes(words)}
    assert got == {("", 8), ("a", 4), ("ab", 3), ("b", 3), ("bc", 2)}
    assert op.inner_nodes(["only"]) == op.inner_nodes([]) == []
    assert [c for c, *_ in op.edges_below(words, 1, 0, 4)] == ["", "b"]


def plain_vocabulary(rows):
    counts = Counter()
    for i, t in rows:
        run = ""
        for c in (t or "") + " " if i is not None else "":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = crc32(f"{i}:{run}".encode())
                if h % 31 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= 7:
                    counts[run] += 1
                run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def test_documents(spark):
    r = random.Random(11)
    words = ["Separate", "seperate", "separated", "ÀÉîõü÷ß", "àÉîõü÷ß", "sixsix", "sevenses", "İstanbulx", "naïveté", "accommodation", "x" * 5000]
    rows = [(d, " ".join(r.choices(words, k=r.randint(0, 90))) + r.choice(["", "1", "-end", "ĀSeparate"])) for d in range(120)]
    rows += [(None, "separate separate"), (500, None), (501, ""), (7, rows[7][1]), (-3, "separate Separate")]
    df = spark.createDataFrame([(*x, 0, "w") for x in rows], "doc_id long, text string, n int, word string")
    want = plain_vocabulary(rows)
    found = op.vocabulary(df)
    assert {x.word: x.n for x in found.collect()} == want
    assert rows_of(op.spelling_forms(found)) == plain_forms(want)
    assert any(w != "separate" and row[2] == "separate" for w, *row in [(x[0], *x) for x in plain_forms(want)])


def test_chains_of_forms_and_empty_table(spark):
    counts = {"aaaaaaaa": 10**6, "aaaaaaab": 90_000, "aaaaaabb": 8000, "aaaaabbb": 700, "aaaabbbb": 60, "aaabbbbb": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r.root for r in op.spelling_forms(words).collect()} == {"aaaaaaaa"}
    assert op.spelling_forms(words.limit(0)).collect() == []
    assert op.vocabulary(spark.createDataFrame([], "doc_id long, text string")).collect() == []
