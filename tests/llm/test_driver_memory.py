"""Memory of the process that fits a model."""

import numpy as np
import pytest

from inkwarden.llm import common, toxicity


def resident():
    with open("/proc/self/status") as lines:
        return next(int(x.split()[1]) for x in lines if x.startswith("VmRSS")) / 1000


def test_freed_arrays_leave_the_process():
    rows = [np.ones(2000) for _ in range(8000)]  # 128 MB
    last = np.ones(2000)  # stands behind them on the heap
    del rows
    common.release_memory()
    before = resident()
    more = [np.ones(2000) for _ in range(8000)]
    full = resident()
    del more
    common.release_memory()
    assert full - before > 100 and resident() - before < 40 and last.sum() == 2000


@pytest.mark.parametrize("toxic", [[0, 1, 1, 0], []])
def test_a_fit_gives_its_memory_back(spark, monkeypatch, toxic):
    calls = []
    monkeypatch.setattr(toxicity, "release_memory", lambda: calls.append(1))
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, label int")
    weights = toxicity.train(docs, labels)
    assert calls == [1] and (weights.bias is None) == (not toxic)
