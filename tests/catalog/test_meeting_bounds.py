"""Blocks score in full only the pairs whose bounds reach the best ones, and find what scoring all finds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skuweave.config import MatchConfig
from skuweave.operators import meeting

ODD_PRICES, ODD_SALES = [None, -1.0, 0.0, 9.5, 1e9, 1e-40, float("inf"), float("nan")], [None, 0.0, 1.0, -4.0, 1e300, float("inf")]


def side(rnd, n, p, odd):
    pick = lambda some, usual: rnd.choice(some) if rnd.random() < odd else usual()
    return pa.table({
        f"{p}_id": list(range(n)), f"{p}_nsku": [None if rnd.random() < 0.1 else f"BRAND-{rnd.randrange(25)}-{rnd.randrange(500)}" for _ in range(n)],
        f"{p}_price": pa.array([pick(ODD_PRICES, lambda: rnd.randrange(900, 10_000) / 10) for _ in range(n)], pa.float64()),
        f"{p}_sales": pa.array([pick(ODD_SALES, lambda: float(rnd.randrange(1, 100))) for _ in range(n)], pa.float64()),
    })


def block(odd, n, m, least=-np.inf):
    rnd = random.Random(7)
    q, c = side(rnd, n, "q", odd), side(rnd, m, "c", odd).append_column("c_m", pa.array([1] * m))
    for name, value in (("name_score", [rnd.choice([40.0, 100.0]) for _ in range(n)]), ("category_score", [100.0] * n), ("least", [least] * n)):
        q = q.append_column(name, pa.array(value))
    return q, c


@pytest.mark.parametrize("odd", [0.0, 0.1, 0.8])
@pytest.mark.parametrize("least", [-np.inf, 55.0])
def test_the_best_are_those_of_all(odd, least):
    (q, c), cfg, k = block(odd, 40, 400, least), MatchConfig(), 9
    every = meeting.found_in(q, c, cfg, 400).to_pylist()  # with no fewer than all there is nothing to leave out
    want = {}
    for r in sorted(every, key=lambda r: (r["q_id"], -np.inf if np.isnan(r["similarity_score"]) else -r["similarity_score"], r["c_id"])):
        want.setdefault(r["q_id"], []).append(repr(r))
    assert least > 0 or len(every) == 40 * 400
    got = meeting.found_in(q, c, cfg, k).to_pylist()
    assert [repr(r) for r in got] == [x for i in range(40) for x in want.get(i, [])[:k]]


def test_few_pairs_are_scored_in_full(monkeypatch):
    q, c = block(0.0, 100, 2000)
    scored, rule = [], meeting.price_scores
    monkeypatch.setattr(meeting, "price_scores", lambda a, b: scored.append(np.broadcast(a, b).size) or rule(a, b))
    assert meeting.found_in(q, c, MatchConfig(), 11).num_rows == 1100
    assert sum(scored) <= 100 * 2000 / 20  # before: all
