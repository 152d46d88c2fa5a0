from __future__ import annotations

import tracemalloc

import pyarrow as pa

from tallyforge.llm import lmscore


def test_working_memory_of_counting():
    """Large batches are taken in blocks whose arrays stay small."""
    texts = pa.array([" ".join(f"w{(i * 7919 + j * j) % 90000}" for j in range(400)) for i in range(4000)])
    tracemalloc.start()
    for _ in lmscore._counted(16)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 75, peak
