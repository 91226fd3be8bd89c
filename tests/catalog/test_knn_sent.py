"""What leaves and reaches the blocks of an exact search."""

import numpy as np

from skuweave.operators import knn


def test_few_rows_leave_and_vectors_stay_floats(spark):
    rows = [(i, "k", x.tolist()) for i, x in enumerate(np.random.default_rng(1).standard_normal((380, 8)))]
    df = spark.createDataFrame(rows, "id long, key string, embedding array<float>")
    found = knn.best(df.filter("id < 10"), df, 5, block_rows=100)
    assert found.count() == 10 * 5  # before: the best of four blocks
    assert "array<double>" not in found._jdf.queryExecution().optimizedPlan().toString()
    exact = np.array([r[2] for r in rows], np.float32).astype(float)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    cosines = exact[:10] @ exact.T
    cosines[np.arange(10), np.arange(10)] = -2
    assert {(r.q_id, r.c_id) for r in found.collect()} == {(q, c) for q in range(10) for c in np.argsort(-cosines[q])[:5].tolist()}
