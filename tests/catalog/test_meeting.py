"""Metadata scores in blocks: those of the rules, bounds above them, and no pair of a query and a row is shuffled."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skuweave.config import MatchConfig
from skuweave.operators import bounds, match, meeting

from . import plain
from .test_match import SCHEMA, rows

SKUS = ["", "A", "SKU-1", "SKU-12", "SKU-21X", "LONG-SKU-0001", "ÄÖ-1", "🂡-1", "SKU-1" * 60, "SKU-2" * 60]
PRICES = [None, -1.0, 0.0, 9.5, 10.0, 1e9, float("inf"), float("nan")]
SALES = [None, 0.0, 1.0, 5.0, 50.0, -4.0, -8.0]


def test_scores_in_blocks_are_those_of_the_rules(spark):
    got = meeting.sku_table(SKUS, SKUS)
    assert got.tolist() == [[plain.sku(a, b) for b in SKUS] for a in SKUS]
    from skuweave.functions import text as T

    numbers = spark.createDataFrame([(i, j, a, b) for (i, a), (j, b) in itertools.product(enumerate(PRICES), repeat=2)], "i int, j int, a double, b double")
    want = {(r.i, r.j): r.x for r in numbers.select("i", "j", T.price_similarity(F.col("a"), F.col("b")).alias("x")).collect()}
    x = np.array(PRICES, float)
    got = meeting.price_scores(x[:, None], x[None])
    assert all(got[at] == pytest.approx(w, nan_ok=True, abs=0) for at, w in want.items())
    numbers = spark.createDataFrame([(i, j, a, b) for (i, a), (j, b) in itertools.product(enumerate(SALES), repeat=2)], "i int, j int, a double, b double")
    want = {(r.i, r.j): r.x for r in numbers.select("i", "j", T.performance_similarity(F.col("a"), F.col("b")).alias("x")).collect()}
    x, none = np.array(SALES, float), np.array([s is None for s in SALES])
    got = meeting.sales_scores(x[:, None], none[:, None], x[None], none[None])
    assert all(got[at] == w for at, w in want.items())


def test_bounds_are_above_all_scores(spark):
    rnd, cfg = random.Random(4), MatchConfig()
    side = lambda n, p: pa.table({f"{p}_id": range(n), f"{p}_nsku": [rnd.choice([None, *SKUS]) for _ in range(n)], f"{p}_price": pa.array([rnd.choice(PRICES) for _ in range(n)], pa.float64()), f"{p}_sales": pa.array([rnd.choice(SALES) for _ in range(n)], pa.float64())})
    for _ in range(20):
        q, c = side(30, "q"), side(4, "c").append_column("c_m", pa.array([1] * 4))
        q = q.append_column("name_score", pa.array([80.0] * 30)).append_column("category_score", pa.array([100.0] * 30)).append_column("least", pa.array([-np.inf] * 30))
        found = meeting.found_in(q, c, cfg, 4)
        assert found.num_rows == 120
        rows = spark.createDataFrame(c.to_pylist(), "c_id long, c_nsku string, c_price double, c_sales double, c_m long").selectExpr("*", "'k' key", "'x' c_clean", "'k' c_ncategory")
        g = bounds.groups(rows).withColumns({"name_score": F.lit(80.0), "category_score": F.lit(100.0)}).toArrow()
        top = meeting.upper_bounds(q, g, cfg)[:, 0]
        assert all(top[i] >= s or np.isnan(s) and np.isinf(top[i]) for i, s in zip(found["q_id"].to_pylist(), found["similarity_score"].to_pylist(), strict=True))


def test_small_blocks_find_the_same(spark, monkeypatch):
    catalog, new = match.prepared(spark.createDataFrame(rows(90, 1), SCHEMA)), match.prepared(spark.createDataFrame(rows(30, 2, 1000), SCHEMA))
    cfg = MatchConfig(limit=7, distinct_names=True)
    want = match.top(match.metadata_scored(match.metadata_pairs(new, catalog, cfg), cfg), 0, 7)
    monkeypatch.setattr(meeting, "Q_BLOCK", 3)
    monkeypatch.setattr(meeting, "C_BLOCK", 4)
    best, met = match.metadata_best(new, catalog, cfg)
    columns = ["q_id", "c_id", "rank", "similarity_score"]
    assert isinstance(met, meeting.Met)
    assert sorted(map(tuple, best.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
