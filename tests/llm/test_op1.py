import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodeframe.llm import arrays as A
from lodeframe.llm import op1_toxicity
from lodeframe.llm.op1_toxicity import KEY_BITS, features, fit, fold, score_texts, weights


def corpus(n=1200, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefg", k=5)) for _ in range(400)]
    docs, labels = [], []
    for d in range(n):
        toxic = r.random() < 0.2
        t = r.choices(words, k=r.randint(20, 80))
        for w in r.sample(["Nasty!", "vile,", "rotten"], 2) if toxic else []:
            t.insert(r.randrange(len(t)), w)
        docs.append((d, " ".join(t)))
        labels.append((d, int(toxic)))
    return docs, labels


def plain_features(text):
    word = "".join(c if not c.isascii() or c.isalnum() else " " for c in text).split()
    word = ["".join(c.lower() if c.isascii() else c for c in w) for w in word]
    return len(set(word)) + len(set(zip(word, word[1:], strict=False))) + len(set(zip(word, word[2:], strict=False)))


def test_features():
    texts = ["", "One", "one, ONE two.one two", "é È b c d b c", "x " * 50]
    raw = [t.encode() for t in texts]
    key, doc = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        assert len(np.unique(key[doc == k])) == plain_features(t)
    assert int(key.max()) < 1 << KEY_BITS


def test_weights_are_sparse():
    assert weights(np.array([0.5, -3.0, 3.0]), np.ones(3)).tolist()[0] == 0
    assert A.unsqueeze(A.squeeze(np.array([], np.uint64))).size == 0


def test_held_out(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*x, "en") for x in docs] + [(5000, None, "x"), (5001, "", "y"), (None, "vile rotten nasty", "z"), (3, docs[3][1], "en")], "doc_id long, text string, key string")
    lab = spark.createDataFrame(labels + [(9999, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    model = fit(df, lab, ~fold(5, 0, "id"), shard_rows=300)
    assert 0 < len(model[0]) < 1000
    got = score_texts(df, model, name="score").collect()
    assert len(got) == len(docs) + 4
    truth = dict(labels)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 5000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.97
    blank = {r.doc_id: r.score for r in got if r.doc_id in (5000, 5001, None)}
    assert blank[5000] == blank[5001] < 0.5 < blank[None]
    assert {r.key for r in got} == {"en", "x", "y", "z"}


def test_one_shard_equals_plain_ftrl(spark, monkeypatch):
    """Against a dictionary-based FTRL, document by document."""
    monkeypatch.setattr(op1_toxicity, "ROUNDS", 1)
    docs, labels = corpus(300)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    keys, weight = fit(df, lab, F.lit(True), shard_rows=1000)
    z, n, truth = {}, {}, dict(labels)

    def plain_weight(f):
        big = abs(z.get(f, 0.0)) > op1_toxicity.L1
        return (np.sign(z[f]) * op1_toxicity.L1 - z[f]) / ((op1_toxicity.BETA + n[f] ** 0.5) / op1_toxicity.ALPHA + op1_toxicity.L2) if big else 0.0

    for _ in range(op1_toxicity.PASSES):
        for i, t in docs:
            found = [0, *np.unique(features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]).tolist()]
            w = {f: plain_weight(f) for f in found}
            g = 1 / (1 + np.exp(-sum(w.values()))) - truth[i]
            for f in found:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / op1_toxicity.ALPHA * w[f]
                n[f] = old + g * g
    want = {f: plain_weight(f) for f in z if plain_weight(f)}
    assert sorted(want) == keys.tolist() and len(want) >= 3
    assert np.allclose([want[k] for k in keys.tolist()], weight)


def test_a_coordinate_in_few_shards_keeps_its_weight(spark):
    """Texts about one subject share a shard's words with no other shard's."""
    docs, labels = corpus(1500)
    rare = [(i, t + " unseen awful") if y and i % 5 == 1 else (i, t) for (i, t), (_, y) in zip(docs, labels, strict=True)]
    keys, _ = fit(spark.createDataFrame(rare, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), shard_rows=100)
    nasty = features(np.frombuffer(b"nasty", np.uint8), np.array([0, 5]))[0]
    assert nasty[0] in keys


def test_clashing_names_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a nasty " * 100_000, "x", 1.0), (1, None, None, None)], "doc_id long, text string, whole_text string, score double")
    nasty = features(np.frombuffer(b"nasty", np.uint8), np.array([0, 5]))[0]
    got = score_texts(df, (nasty, np.array([1.0])), name="score")
    assert got.columns == ["doc_id", "text", "whole_text", "score"]
    assert sorted(round(r.score, 3) for r in got.collect()) == [0.5, 0.731]


def test_labels_that_disagree(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    fit(df, spark.createDataFrame([(1, 0), (1, 1), (1, None)], "doc_id long, toxic int"), F.lit(True))


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert [r.toxic_score for r in score_texts(docs, none).collect()] == [0.0]
    assert score_texts(docs.limit(0), none).collect() == []


def test_distinct_keys_of_documents():
    """A slice's features in one array, not one a document, and the coordinates handed on."""
    r = np.random.default_rng(1)
    doc, keys = r.integers(0, 40, 9000), r.integers(0, 300, 9000).astype(np.uint64)
    doc[doc == 7] = 8
    kept, count = op1_toxicity.distinct(keys, doc, 40)
    assert len(count) == 40 and count[7] == 0
    for d, mine in enumerate(np.split(kept, np.cumsum(count)[:-1])):
        assert np.array_equal(mine, np.unique(keys[doc == d]))
    z = np.append(r.normal(0, 4, 1000), [4.0, -4.0, np.nextafter(4, 5), 0.0])
    assert np.array_equal(np.flatnonzero(weights(z, z * z)), np.flatnonzero(np.abs(z) > op1_toxicity.L1))
