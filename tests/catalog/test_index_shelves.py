"""What a search of the vector index shuffles: at most `refine` rows for each query and shelf, however many cells it probes."""

import numpy as np

from skuweave.operators import knn, vector_index
from skuweave.operators.vector_index import VectorIndex
from skuweave.shared import new_path


def test_rows_that_leave_a_shelf_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, "a" if i % 3 else None, x.tolist()) for i, x in enumerate(rng.standard_normal((1500, 16)))]
    df = spark.createDataFrame(rows, "id long, key string, embedding array<float>")
    monkeypatch.setattr(vector_index, "SHELF_ROWS", 400)
    monkeypatch.setattr(vector_index, "Q_ROWS", 20)
    index = VectorIndex(spark, new_path(spark, "index"), 4)
    index.fit(df, cells=40)
    index.append(df)
    asked = df.filter("id < 60")
    sent = {r.q_id: r["count"] for r in index.scored(asked, 12, 40).groupBy("q_id").count().collect()}
    assert all(n <= 12 * (3 if q % 3 else 2) for q, n in sent.items()) and len(sent) == 60  # before: all of 1,000 or 500 rows
    assert index.guesses(asked, 12, 40).groupBy("q_id").count().agg({"count": "max"}).first()[0] == 12
    exact = knn.knn_join(asked.filter("key is not null"), df.filter("key is not null"), 5)
    found = index.search(asked, 5, 200)
    want = {(r.q_id, r.c_id) for r in exact.collect()}
    got = {(r.q_id, r.c_id) for r in found.collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert {q % 3 == 0 for q, c in got if (q % 3 == 0) != (c % 3 == 0)} == set()  # keys do not mix, also that of null
    assert {q for q, _ in got} == set(range(60)) and all(q != c for q, c in got)
