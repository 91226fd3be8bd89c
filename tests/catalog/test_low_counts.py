"""Counters of a run: pairs below a threshold are counted in blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skuweave.config import MatchConfig
from skuweave.operators import match, meeting

from .test_match import SCHEMA, rows

PRICES, SALES = [None, -1.0, 0.0, 7.0, 9.5, 10.0, 11.0, 1e31, float("nan"), float("inf")], [None, 0, -4, -8, 3, 5, 50]


def odd(n, seed, start=0, prices=PRICES):
    rnd = random.Random(seed)
    return [(*r[:7], rnd.choice(prices), rnd.choice(SALES)) for r in rows(n, seed, start)]


def counted(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("against_all", [False, True])
def test_counts_are_those_of_all_pairs(spark, monkeypatch, against_all):
    """Thresholds that scores are equal to; odd prices and sales; many blocks; the catalog holds copies and the queries, too."""
    cfg = MatchConfig(limit=0, distinct_names=True, match_against_all=against_all)
    new = spark.createDataFrame(odd(40, 2, 1000), SCHEMA)
    old = odd(90, 1)
    stock = spark.createDataFrame(old + [(r[0] + 500, *r[1:]) for r in old[:30]], SCHEMA).unionByName(new)
    a, b = match.prepared(new), match.prepared(stock)
    scored = match.metadata_scored(match.metadata_pairs(a, b, cfg, ("category", "sku", "product_name")), cfg)
    ties = [r[0] for r in scored.filter("similarity_score < 100").groupBy("similarity_score").count().orderBy("count", ascending=False).limit(1).collect()]
    for name, value in (("LOW_Q", (16, 16)), ("LOW_C", 9)):
        monkeypatch.setattr(meeting, name, value)
    columns = ["new_product_id", "total_candidates", "filtered_by_threshold"]
    want = {x: counted(match.run_counters(scored, x).select(columns)) for x in (*ties, 50.0)}
    with monkeypatch.context() as many:  # more pairs of names than are sent to tasks
        many.setattr(meeting, "NAMES", 0)
        rows_of_pairs = counted(match.metadata_counters(a, b, cfg, ties[0]))
    monkeypatch.setattr(match, "_paired", None)  # no pair is a row
    for x in want:
        assert counted(match.metadata_counters(a, b, cfg, x).select(columns)) == want[x]
    assert counted(match.metadata_counters(a, b, cfg, ties[0])) == rows_of_pairs


def test_slices_of_a_block(monkeypatch):
    """A block that is counted a few queries at a time."""
    rnd = random.Random(4)
    side = lambda n, x: {f"{x}_clean": rnd.choices("abc", k=n), f"{x}_nsku": rnd.choices([None, "", "SKU-1", "SKU-22", "S-3", "LONG-SKU-0001"], k=n), f"{x}_price": rnd.choices(PRICES, k=n), f"{x}_sales": [v if v is None else float(v) for v in rnd.choices(SALES, k=n)]}
    q = pa.table({"id": range(50), "key": ["k"] * 50, "category_score": rnd.choices([0.0, 100.0], k=50), **side(50, "q")})
    c = pa.table({"id": range(30), "c_m": rnd.choices([1, 2], k=30), **side(30, "c")})
    place = {x: i for i, x in enumerate("abc")}
    names = {"k": (place, place, np.array([[100, 20, 60], [20, 100, 30], [60, 30, 100.0]]))}
    whole = meeting.low_in(q, c, names, MatchConfig(), 40.0).sort_by("q_id")
    assert 0 < sum(whole["low"].to_pylist()) < 50 * sum(c["c_m"].to_pylist())
    for name, value in (("ELEMENTS", 64), ("ACROSS", 4), ("DOWN", 7)):
        monkeypatch.setattr(meeting, name, value)
    assert meeting.low_in(q, c, names, MatchConfig(), 40.0).sort_by("q_id") == whole
