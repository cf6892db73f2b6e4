import numpy as np
import pyarrow as pa

from lodeframe.llm import op2_packing, shared
from lodeframe.llm.op5_simhash import similar_documents


def own_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024


def test_tasks_give_memory_back():
    """Freed arrays below one that stays are kept by the allocator, unless told."""
    stay = []

    def run(batches):
        for rb in batches:
            held = [np.ones(1000) for _ in range(20_000)]  # 160 MB
            stay.append(np.ones(1000))
            yield rb
            del held

    before = own_mb()
    assert len(list(shared.tidy(run)(iter([1])))) == 1
    assert own_mb() < before + 60
    list(run(iter([1])))
    assert own_mb() > before + 120


def test_a_worker_forgets_what_another_stage_needed(spark):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(8)], "doc_id long, text string").coalesce(1)
    assert op2_packing.pieces(docs).count() == 8

    def names(batches):
        for rb in batches:
            found = ",".join(sorted(shared._REMEMBERED))
            yield pa.RecordBatch.from_arrays([pa.array([found] * rb.num_rows)], ["names"])

    assert {r.names for r in docs.select("doc_id").mapInArrow(shared.tidy(names), "names string").collect()} == {""}


def test_remembered_once_a_stage():
    made = []
    for _ in range(3):
        assert shared.remembered("x", lambda: made.append(1) or 7) == 7
    shared.forget()
    assert "x" in shared._REMEMBERED and len(made) == 1
    shared._REMEMBERED["x"] = 5, 7
    shared.forget()
    assert "x" not in shared._REMEMBERED


def test_near_copies_start_without_a_python_rdd(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "a b c d e f g h i j " * 3 + "z" * (k % 2)) for k in range(6)], "doc_id long, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", None)  # its workers come besides those of mapInArrow
    assert {r.component_id for r in similar_documents(docs).collect()} == {0}
