"""Vector search: a task's memory does not grow with queries times rows of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loomgraph.operators import chunks


def test_memory_of_many_queries():
    r = np.random.default_rng(1)
    q, v = r.standard_normal((4000, 8)), r.standard_normal((5000, 8)).round(1)
    ids = np.arange(4000) * 2
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "v"])
    tracemalloc.start()
    got = list(chunks._nearest(ids, q, 3, pa.int64())(iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all similarities at once are 160 MB an array
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    for i in (0, 1, 77, 3999):
        best = sorted((-s, n) for n, s in enumerate(sim[i]) if n != ids[i])[:3]
        assert [(b["id"], b["similarity"]) for g in got for b in g.to_pylist() if b["q"] == ids[i]] == [(n, -s) for s, n in best]
