"""Bounds on what a task holds."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from mentionforge.llm import divergence, near_dedup
from mentionforge.llm.packing import Index


def test_a_block_is_counted_in_steps(monkeypatch):
    """The postings of a block (3 million here) aren't all unfolded at once."""
    monkeypatch.setattr(divergence, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = ["w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(1000)]
    docs = pa.RecordBatch.from_pylist([{"text": " ".join(words[i % 7 :]), "lang": "x", "source": "s%d" % (i % 3)} for i in range(3000)])
    blocks = pa.Table.from_batches(list(divergence.chunk_counts(iter([docs])))).sort_by("chunk")
    cut = list(divergence.tokenise(iter(blocks.to_batches(10_000))))
    tracemalloc.start()
    try:
        counted = pa.Table.from_batches(list(divergence.count_terms(iter(cut))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {t: n for t, n in zip(counted["term"].to_pylist(), counted["docs"].to_pylist(), strict=True)} == {w: sum(k % 7 <= i for k in range(3000)) for i, w in enumerate(words)}
    assert peak < 100e6, peak


def test_used_documents_leave_the_index():
    """Documents that are used up aren't scored again and again; what the others score stays."""
    r = np.random.default_rng(3)
    docs = [np.append(r.integers(1, 70_000 if k % 9 == 0 else 300, 200), 0).astype(np.uint32) for k in range(60)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=70_001)
    index, fresh = (Index(docs, df, len(docs), 201.0) for _ in range(2))
    open_ = np.ones(60, bool)
    for used in (range(0, 20), range(20, 50), range(50, 59)):
        open_[list(used)] = False
        index.keep(open_)
        assert set(index.doc) <= set(np.flatnonzero(open_))
        for d in range(60):
            assert (index.scores(d)[open_] == fresh.scores(d)[open_]).all()


def test_a_block_of_components_gets_registers_in_slices():
    """Beside its sets (20 MB here) a block takes little."""
    r = np.random.default_rng(5)
    sets = [np.sort(r.integers(0, 1 << 63, 2500).astype(np.uint64)) for _ in range(1000)]
    sets[700] = np.sort(np.append(sets[3][:-5], sets[9][:5]))  # near a copy of another component's
    rows = [{"key": k // 500, "i": 0, "j": 0, "asks": k % 500 < 100, "node": k, "comp": k, "set": s.tobytes()} for k, s in enumerate(sets)]
    rows[700]["key"] = 0
    batch = pa.Table.from_pylist(sorted(rows, key=lambda x: x["key"])).combine_chunks().to_batches()[0]
    del rows
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(list(near_dedup.across(85)(iter([batch]))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == [(3, 700)]
    assert peak < 40e6, peak
