"""The memory of a pair of blocks."""

import tracemalloc

import numpy as np

from skuweave.operators import knn


def test_a_block_is_multiplied_in_slices():
    rng = np.random.default_rng(1)
    m, ids, fine = rng.standard_normal((4096, 16)), np.arange(4096), np.ones(4096, bool)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    tracemalloc.start()
    got = knn.nearest(ids + 10_000, m, fine, ids, m, fine, 3, -1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6, "4,096 x 4,096 cosines at once are 134 MB"
    whole = np.round(m @ m.T, 12)
    assert [g[1].tolist() for g in got] == [np.argsort(-row, kind="stable")[:3].tolist() for row in whole]
