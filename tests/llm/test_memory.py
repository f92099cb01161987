"""Workers hand freed memory back."""

from __future__ import annotations

import os
import pickle

import numpy as np
import pyarrow as pa

import corpus_pipeline

from farness.llm.common import BATCH_ROWS, slices
from farness.llm.decontamination import Overlap, SeedIndex, text_words
from farness.llm.op6 import vocabulary
from farness.llm.tokens import encoder


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_memory_freed_by_earlier_tasks_goes_back():
    # many small blocks stay with the C library when they are freed, below one that is still in use
    blocks = [np.ones(8_000, np.uint8) for _ in range(30_000)]
    last = np.ones(8_000, np.uint8)
    before = _resident()
    blocks.clear()
    texts = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30])], ["text"])
    assert [b.num_rows for b in slices(iter([texts]), 0, 20)] == [2, 1]
    assert before - _resident() > 150_000_000 and last.all()


def test_a_small_benchmark_makes_a_small_index():
    # every worker holds the index, beside what the stages after it hold
    index = SeedIndex([1, 2], [" ".join(f"w{k}" for k in range(n)) for n in (40, 7)], Overlap())
    assert len(pickle.dumps(index)) < 1 << 20
    hashes, bounds = text_words(pa.array(["x " + " ".join(f"w{k}" for k in range(40)), "y w1 w2", " ".join(f"w{k}" for k in range(7))]))
    assert {(doc, item) for doc, item, *_ in index.held(hashes, bounds)} == {(0, 0), (0, 1), (2, 1)}


def test_tasks_that_do_not_encode_drop_tokenizers():
    # idle workers would hold what packing remembers all through the stages of a later run
    texts = pa.RecordBatch.from_arrays([pa.array(["one two", None])], ["text"])
    encoder(vocabulary("byte_bpe_50k.json")).encode(texts.column(0))
    assert sum(b.num_rows for b in slices(iter([texts]), 0, encodes=True)) == 2 and encoder.cache_info().currsize == 1
    assert sum(b.num_rows for b in slices(iter([texts]), 0)) == 2 and encoder.cache_info().currsize == 0


def test_texts_of_the_pipeline_reach_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(0, 4 * BATCH_ROWS, 1, 1).selectExpr("id AS doc_id", "'text' AS text", "'en' AS lang", "'x' AS source", "4L AS n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get(key)
    try:
        corpus_pipeline.quality_rules(spark, docs, "")
        assert {r.n for r in docs.mapInArrow(sizes, "n long").collect()} == {BATCH_ROWS}
        spark.conf.set(key, "77")
        corpus_pipeline.quality_rules(spark, docs, "")
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)
