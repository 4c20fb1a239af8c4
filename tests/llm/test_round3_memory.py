"""Memory of the n-gram batches (pipeline, operator 2)."""

import tracemalloc

import numpy as np
import pyarrow as pa

from limnos.llm import ngram_counts


class _Task:
    get = classmethod(lambda cls: cls)
    partitionId = classmethod(lambda cls: 1)


class _Hot:
    value = (np.arange(0, 40_000, 4) * 500, np.ones(10_000, np.int64))


def test_a_batch_of_n_grams_stays_small(monkeypatch):
    """Before: 192 MB traced at the most; an executor holds one batch a core."""
    monkeypatch.setattr(ngram_counts, "TaskContext", _Task)
    text = " ".join(f"w{k % 997}x{k}" for k in range(3_000))
    texts = pa.array([text] * 64)
    ids = pa.array(range(64), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], names=["doc_id", "th", "text"])
    buckets, peaks = 20_000_000, []
    for run in (ngram_counts.occurrences(buckets, 1, _Hot), ngram_counts.count_batches(buckets, 1, False)):
        tracemalloc.start()
        rows = sum(x.num_rows for x in run(batch for _ in range(12)))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert rows > 100
    assert max(peaks) < 150, peaks
