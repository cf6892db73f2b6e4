import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeframe.llm.op2_packing import encoder, pack_documents, plan

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\n\n", "\t", "é", "'s", "don't", "12", "!", "...", " ", "　", "\x1c", "日本", "<|endoftext|>", "x" * 150]), max_size=30))
def test_chunks_encode_as_whole_texts(parts):
    text = "".join(parts)
    tk = Tokenizer.from_file(public_tokenizers.path(NAME)) if not hasattr(test_chunks_encode_as_whole_texts, "tk") else test_chunks_encode_as_whole_texts.tk
    test_chunks_encode_as_whole_texts.tk = tk
    assert np.frombuffer(encoder(NAME)([text])[0], "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=30))
def test_plan_is_a_packing(counts):
    runs, n = plan(counts, size=64, large=8, groups=6)
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, many, base, offset in runs:
        for k in range(many):
            held[base + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in counts.items() if c}
    assert set(held) == set(range(n))
    for found in held.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64


def test_few_sequences():
    r = np.random.default_rng(4)
    lengths = np.concatenate([r.integers(1, 2049, 4000), r.integers(1, 200, 4000)])
    counts = dict(Counter(lengths.tolist()))
    assert plan(counts)[1] <= 1.01 * np.ceil(lengths.sum() / 2048)


def test_documents(spark, tokenizer):
    r = random.Random(1)
    rows = [(d, " ".join(r.choices(["alpha", "beta", "γάμμα", "x1", "\n"], k=r.randint(0, 900)))) for d in range(80)]
    rows += [(90, None), (91, ""), (92, "word " * 9000), (92, "word " * 9000), (93, rows[1][1]), (None, "a b")]
    got = pack_documents(spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, length int").repartition(3)).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(min(head, len(ids)), len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    held = defaultdict(list)
    for x in got:
        held[x.sequence_id].append((x.offset, x.length))
    for found in held.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.1 * sum(x.length for x in got) / 2048 + 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
