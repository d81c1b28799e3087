"""What a worker keeps from task to task: helper tables don't grow with the texts it has seen, and what is freed goes back."""

import re

import numpy as np
import pyarrow as pa
import pytest

from palisade.llm import common


def test_hashing_long_columns_keeps_no_long_tables():
    rows = ["wörd " * 300_000, None, "", "x" * 600_000 + " wörd", " A b\nc "]
    whole = common.words(pa.array(rows), lower=True)
    parts = [common.words(pa.array([r], pa.string()), lower=True) for r in rows]
    assert np.array_equal(whole.hash, np.concatenate([p.hash for p in parts]))
    assert len(set(whole.hash[:300_000].tolist())) == 1 and whole.hash[-4] == whole.hash[0] and len(whole.hash) == 300_005
    assert sum(x.nbytes for x in common._POWERS) < 5_000_000


def test_freed_memory_goes_back_at_the_end_of_a_task():
    if not hasattr(common.ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    arrays = [np.ones(8000) for _ in range(3000)]  # small enough for the heap, whose end the last one holds
    arrays = arrays[-1:]
    before = held()
    assert sum(b.num_rows for b in common.slices(iter([pa.record_batch({"text": ["a", None]})]), column="text")) == 2
    assert before - held() > 90 and len(arrays) == 1
