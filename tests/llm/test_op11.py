import random

import numpy as np
from pyspark.sql import functions as F

from lodeframe.llm.op11_parity_join import differences, edges, similar_ngrams, sketch, sketch_keys


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (1, 5, 40, 700, 5000):
        x = r.integers(0, 2**64, n, np.uint64)
        y = np.concatenate((x[: n - n // 9], r.integers(0, 2**64, n // 11 + 1, np.uint64)))
        different = len(np.setxor1d(x, y))
        for segments in (1, 3, 200):
            assert np.bitwise_count(sketch(x, segments) ^ sketch(y, segments)).sum() <= different


def test_pairs_at_the_threshold_share_a_key():
    """Also at the edges of bands, and with every difference the threshold allows."""
    r = np.random.default_rng(2)
    for percent in (70, 80, 90, 95):
        for n in [*range(2, 90), *(e + k for e in edges(3000, percent)[-8:] for k in (-1, 0, 1))]:
            x = np.unique(r.integers(0, 2**64, n, np.uint64))
            for smaller in {n, n - 1, -(-percent * n // 100), (n + -(-percent * n // 100)) // 2}:
                common = -(-percent * (n + smaller) // (100 + percent))  # the least at the threshold
                if not 0 < common <= smaller:
                    continue
                y = np.unique(np.concatenate((r.permutation(x)[:common], r.integers(0, 2**64, smaller - common, np.uint64))))
                if len(y) + n > 2 * common:
                    assert len(np.intersect1d(sketch_keys(x, percent), sketch_keys(y, percent))), (percent, n, smaller)


def test_keys_are_few():
    r = np.random.default_rng(3)
    for n in (100, 1000, 10_000):
        keys = sketch_keys(r.integers(0, 2**64, n, np.uint64), 90)
        assert len(keys) <= 2 * (differences(int(1.44 * n), 90) + 1)
    assert len(sketch_keys(np.arange(9, dtype=np.uint64), 95)) == 0


def plain(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
            sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        before = dict(root)
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return sorted((i, len(s), root[i]) for i, s in sets.items())


def test_documents(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(900)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "ONE two"), (7, "one two"), (8, "É x y"), (9, "é x y"), (None, "a b c d")]
    at = 100
    for g in range(14):
        t = r.choices(words, k=r.choice([8, 20, 21, 60, 250, 900]))
        for k in range(14 if g < 2 else 4):  # groups larger than a small one too
            u = list(t)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                u[r.randrange(len(u))] = r.choice(words)
            rows.append((at, " ".join(u + r.choices(words, k=r.choice([0, 0, 1, 3])))))
            at += 1
    chain = r.choices(words, k=120)  # neighbours link, ends do not
    for k in range(12):
        rows.append((at + k, " ".join(chain[3 * k :] + words[: 3 * k])))
    rows.append((5000, " ".join(r.choices(words, k=40_000))))
    rows.append((5001, rows[-1][1] + " more"))
    want = plain(rows)
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, size int")
    assert sorted(tuple(x) for x in similar_ngrams(df).collect()) == want
    assert len({c for *_, c in want}) < len(want) - 30


def test_repeats_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "q r s t"), (2, "a B c d")]
    got = similar_ngrams(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(x) for x in got.collect()) == [(1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert similar_ngrams(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def written_by_shuffles(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_stay_where_they_are(spark):
    """Also where ids are too many to be broadcast: sets move, which are small here."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), k -> concat_ws('', transform(sequence(1, 8), j -> sha2(concat_ws(':', id div 2, k, j, if(k = 60, id, 0)), 256))))) as text")
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        before = written_by_shuffles(spark)
        got = {r.doc_id: r.component_id for r in similar_ngrams(docs).collect()}
        moved = written_by_shuffles(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got == {k: k - k % 2 for k in range(400)}
    assert moved < size / 10, (moved, size)
