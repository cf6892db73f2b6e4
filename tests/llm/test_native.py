"""The operators written with DataFrame functions alone, and exact search."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import op7_chat as chat
from lodeframe.llm.op8_decontam import contained, decontaminate, probes, words
from lodeframe.llm.op9_topk import top_k

TRICKY = ["\\### Assistant: </turn> ok", "&amp;h; &h; &t;", "### ### ####</turn>", "</turn></turn>", "a: b", "", None, "é\n日本", "&", "x " * 50000]


def test_round_trip_of_a_table(spark):
    rows = [(c, t, r, x, 1) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", None, "tool: ### x", "assistant"] * 2, TRICKY, strict=True))]
    rows += [(9, 0, "user", "same", 1), (9, 0, "user", "same", 1), (9, None, "system", "first", 1)]
    table = chat.format_table(chat.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").drop("formatted")), ["conv_id"])
    got = {r.conv_id: r for r in table.select("*", chat.parsed(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    want = [(r or "", x or "") for c, _, r, x, _ in rows if c == 0]
    assert [(t.role, t.text) for t in got[0].back] == want
    assert got[0].loss == "".join(x for r, x in want if r == "assistant")
    assert [got[0].formatted[m.start : m.end] for m in got[0].loss_mask] == [x.replace("&", "&amp;").replace("###", "&h;").replace("</turn>", "&t;") for r, x in want if r == "assistant"]
    assert [(t.role, t.text) for t in got[9].back] == [("system", "first"), ("user", "same"), ("user", "same")]


def test_layouts(spark):
    pair = [("user", "Q </turn>"), ("assistant", "A")]
    records = {
        "messages": {"messages": [{"role": r, "content": x} for r, x in pair]},
        "conversations": {"conversations": [{"from": "human", "value": pair[0][1]}, {"from": "gpt", "value": "A"}]},
        "turns": {"turns": [{"turn": 1 - k, "role": r, "text": x} for k, (r, x) in reversed(list(enumerate(pair[::-1])))]},
        "instruction": {"instruction": pair[0][1], "output": "A"},
        "prompt_completion": {"completion": "A", "prompt": pair[0][1]},
        "prompt_response": {"response": "A", "prompt": pair[0][1]},
        "question_answer": {"question": pair[0][1], "answer": "A"},
    }
    rows = [(name, json.dumps(x)) for name, x in records.items()] + [("none", '{"other": {"x": 1}}'), ("bad", "{"), ("null", None), ("empty", "")]
    got = {r.name: r for r in chat.format_json(spark.createDataFrame(rows, "name string, record string"), ["name"]).collect()}
    for name in records:
        assert got[name].layout == name
        assert [(t.role, t.text) for t in got[name].turns] == pair
    assert all(got[k].layout is None and got[k].formatted is None for k in ("none", "bad", "null", "empty"))
    both = chat.format_json(spark.createDataFrame([(1, json.dumps({"instruction": "i", "input": "", "output": "o"})), (2, json.dumps({"system": "s", "instruction": "i", "output": "o"}))], "k int, record string"), ["k"]).collect()
    assert [[(t.role, t.text) for t in r.turns] for r in sorted(both, key=lambda r: r.k)] == [[("user", "i"), ("assistant", "o")], [("system", "s"), ("user", "i"), ("assistant", "o")]]
    with pytest.raises(ValueError):
        chat.format_table(spark.createDataFrame([(1, 2)], "k int, other int"), ["k"])


def test_containment(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdéfgh", k=4))
    items = [(k, " ".join(word() for _ in range(r.choice([2, 4, 5, 9, 30, 60])))) for k in range(30)] + [(0, "twice the same id here now"), (90, None), (91, "!!"), (None, "a b c d e f")]
    docs = []
    for d in range(120):
        t = [word() for _ in range(r.randint(0, 60))]
        if r.random() < 0.7:
            piece = (r.choice(items[:30])[1]).split()
            for _ in range(r.choice([0, 0, 1, 3])):
                piece[r.randrange(len(piece))] = word()
            at = r.randint(0, len(t))
            t[at:at] = piece
        docs.append((d, ", ".join(t).title()))
    docs += [(3, "again"), (200, None), (201, ""), (None, items[2][1]), (202, f"{items[4][1]} " * 500)]
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = {}
    for i, t in docs:
        for j, x in items:
            k = min(5, len(words(x)))
            if i is not None and j is not None and k and (q := grams(words(x), k)):
                share = len(q & grams(words(t), k)) / len(q)
                if share >= 0.8:
                    want[i, j] = max(share, want.get((i, j), 0))
    df, bench = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hash int")
    got = {(x.doc_id, x.item_id): x.containment for x in contained(df, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 20
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in {a for a, _ in want}), key=str)
    assert contained(df.limit(0), bench).collect() == [] == contained(df, bench.limit(0)).collect()


def test_contained_copies_no_text_along(spark):
    """A run of words goes without the whole document's words, which are found once a document;
    and texts aren't shuffled to drop the few that contain an item."""
    texts = ["a b c", "a b", "", None, "a b c a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = probes(df.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h")), 3)
    counts = {x.doc_id: (x.n, x.runs, x.hashes) for x in made.groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("runs"), F.countDistinct("hash").alias("hashes")).collect()}
    assert counts == {0: (1, 1, 1), 4: (5, 5, 4)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate" in x)
    assert re.search(r"\[doc_id#\d+L, n#\d+\], false", generate) and plan.count("split(") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = decontaminate(df, df.where("doc_id = 0").withColumnRenamed("doc_id", "item_id"))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(x.doc_id for x in kept.collect()) == [1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k(spark):
    r = np.random.default_rng(3)
    vectors = [(int(i), [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(160)]
    vectors += [(200 + k, vectors[0][1]) for k in range(12)] + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (350, [float("inf")] * 8), (None, [1.0] * 8), (400, []), (450, [3.0])]
    rows = [(i, v, 9) for i, v in vectors]
    good = {i: np.floor(256 * np.pad(np.array(v, float), (0, 8 - len(v)))).astype(int) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in good:
        if q % 50 == 0:
            best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = top_k(df.withColumn("embedding", F.col("embedding").cast("array<float>")).repartition(3), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [x["rank"] for x in few] == [1, 2]


def test_kept_columns_with_clashing_names(spark):
    rows = [(1, json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}), "p", "l", "x", "y"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, record string, prompt string, layout string, parts string, kept_row string")
    got = chat.format_json(df, ["id", "prompt", "layout", "parts", "kept_row"])
    assert got.columns == ["id", "prompt", "layout_", "parts", "kept_row", "layout", "turns", "formatted", "loss_mask"]
    one, two = got.orderBy("id").collect()
    assert (one.prompt, one.layout_, one.parts, one.kept_row) == ("p", "l", "x", "y") and [t.text for t in one.turns] == ["hi", "yes"]
    assert two.layout is None and two.formatted is None
