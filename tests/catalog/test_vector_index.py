import numpy as np
import pytest

from skuweave.operators import knn
from skuweave.operators.vector_index import VectorIndex, _model
from skuweave.plans.catalog import Catalog
from skuweave.plans.queries import QUERIES
from skuweave.shared import new_path


def rows_of(spark, m, first=0, key=""):
    return spark.createDataFrame([(first + i, key, x.tolist()) for i, x in enumerate(m)], "id long, key string, embedding array<float>")


def recall(found, exact):
    want = {(r.q_id, r.c_id) for r in exact.collect()}
    return len(want & {(r.q_id, r.c_id) for r in found.collect()}) / len(want)


def test_recall_and_pruning_on_the_test_vectors(spark):
    """Vectors without any structure, the hardest case: 15 % of the pairs are multiplied at most."""
    df = Catalog(spark, "/root/testdata/sf0.1").features.selectExpr("product_id as id", "'' as key", "embedding")
    asked, n = df.filter("id % 20 = 0"), df.count()
    path = new_path(spark, "index")
    index = VectorIndex(spark, path, 4)
    index.fit(df)
    index.append(df)
    assert recall(index.search(asked, 10), knn.knn_join(asked, df, 10)) >= 0.9
    assert index.guesses(asked).count() <= 0.15 * n * asked.count()
    again = VectorIndex(spark, path, 4)  # as another run finds it
    assert recall(again.search(asked, 10), index.search(asked, 10)) == 1
    plan = index.guesses(asked)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x and "codes" in x]
    assert scans and all("embedding" not in x.split("ReadSchema")[1] for x in scans)  # vectors are not read to guess


def test_clusters_need_few_cells(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 32))
    m = centre[rng.integers(0, 40, 3000)] + 0.2 * rng.standard_normal((3000, 32))
    df = rows_of(spark, m)
    index = VectorIndex(spark, new_path(spark, "index"), 4)
    index.fit(df, sample_rows=1000)
    index.append(df)
    model, asked = _model(index.model), df.filter("id % 20 = 0")
    assert model.probes <= len(model.cells) / 4
    probes, refine = index.tune(df)  # the sample is a third of the rows
    assert (probes, refine) == (_model(index.model).probes, _model(index.model).refine) and probes <= len(model.cells) / 4 and refine < 600
    assert recall(index.search(asked, 10), knn.knn_join(asked, df, 10)) >= 0.9
    assert index.probed(asked).groupBy("q_id").count().agg({"count": "max"}).first()[0] <= model.probes


def test_appends_keys_copies_and_unusable_rows(spark, monkeypatch):
    from skuweave.operators import vector_index

    monkeypatch.setattr(vector_index, "BIN_ROWS", 50)
    rng = np.random.default_rng(4)
    first, second = rows_of(spark, rng.standard_normal((200, 8)), 0, "a"), rows_of(spark, rng.standard_normal((200, 8)), 1000, "b")
    copies = rows_of(spark, np.ones((300, 8)), 5000, "a")  # one vector, many bins
    odd = spark.createDataFrame([(9000, "a", None), (9001, "a", [1.0] * 7), (9002, "a", [float("nan")] * 8), (9003, None, [1.0] * 8), (9004, "a", [0.0] * 8)], "id long, key string, embedding array<float>")
    index = VectorIndex(spark, new_path(spark, "index"), 4)
    index.fit(first.unionByName(second))
    for part in (first, second, copies.unionByName(odd)):
        index.append(part)
    stats = {r.key: r for r in index.statistics().collect()}
    assert {k: r.vectors for k, r in stats.items()} == {"a": 501, "b": 200, None: 1} and stats["a"].bins >= 6
    got = index.search(first.filter("id < 20"), 5)
    assert {r.c_id for r in got.collect()} <= {*range(200), *range(5000, 5300), 9004} and got.filter("q_id = c_id").count() == 0
    near = {(r.q_id, r.c_id): r.cosine for r in got.collect()}
    exact = {(r.q_id, r.c_id): r.cosine for r in knn.knn_join(first.filter("id < 20"), first.unionByName(copies), 500).collect()}
    assert all(near[x] == pytest.approx(exact[x], abs=1e-6) for x in near.keys() & exact.keys())
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        index.fit(first)


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    row = QUERIES["approximate_knn_recall"](spark, sf).first()
    assert row.queries == 25 and row.recall_of_90_percent and row.cosines_are_exact
    assert QUERIES["vector_index_statistics"](spark, sf).first().vectors == 500
