import random
from dataclasses import replace

import numpy as np
import pytest

from skuweave.config import MatchConfig
from skuweave.operators import kernels, knn, match
from skuweave.plans.catalog import Catalog

from .plain import metadata

SCHEMA = "id long, image_path string, category string, product_name string, sku string, is_historical boolean, created_at timestamp, price double, sales long"


def rows(n, seed, start=0):
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice(x)
    return [(start + i, "x.jpg", pick("mugs", "Mugs ", "plates", None, "n/a", ""), pick("Red Mug", "red mug!", "Blue plate of the sea", "the", None, "Mug red large 100", ""), pick(f"SKU-{i % 7}", f"sku-{i % 5}", None, "LONG-SKU-0001"), start == 0, None, pick(None, 0.0, 9.5, 10.0, 20.0), pick(None, 0, 5, 50)) for i in range(n)]


@pytest.mark.parametrize("distinct", [True, False, None])
def test_metadata_matches_plain_version(spark, distinct):
    catalog, new = rows(60, 1), rows(40, 2, 1000)
    cfg = MatchConfig(distinct_names=distinct)
    got = match.metadata_matches(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(catalog, SCHEMA), cfg).collect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = metadata([dict(zip(names, r, strict=True)) for r in new], [dict(zip(names, r, strict=True)) for r in catalog])
    key = lambda x: (x[0], x[1])
    mine = sorted(((r.new_product_id, r.matched_product_id, r.similarity_score) for r in got), key=key)
    assert [key(x) for x in mine] == [key(x) for x in sorted(want, key=key)]
    assert [x[2] for x in mine] == pytest.approx([x[2] for x in sorted(want, key=key)])


def test_threshold_drops_only_low_scores(spark):
    catalog, new = spark.createDataFrame(rows(60, 1), SCHEMA), spark.createDataFrame(rows(40, 2, 1000), SCHEMA)
    cfg = MatchConfig(limit=0)
    key = lambda df: {(r.new_product_id, r.matched_product_id) for r in df.collect()}
    everything = match.metadata_matches(new, catalog, cfg)
    assert key(match.metadata_matches(new, catalog, replace(cfg, threshold=60.0))) == key(everything.filter("similarity_score >= 60"))


def vectors(spark, n, start, seed):
    rng = np.random.default_rng(seed)
    base = rows(n, seed, start)
    return spark.createDataFrame([(*r, rng.standard_normal(8).tolist() if i % 9 else None) for i, r in enumerate(base)], SCHEMA + ", embedding array<double>")


def test_knn_is_exact_in_blocks(spark):
    catalog, new = vectors(spark, 60, 0, 3), vectors(spark, 40, 1000, 4)
    fine = [df.filter("embedding is not null") for df in (new, catalog)]
    cfg = MatchConfig(limit=5, min_threshold=0, uncategorized_factor=1.0)
    want = {(r.new_product_id, r.matched_product_id): r.similarity_score for r in match.visual_matches(*fine, cfg).collect()}
    got = {(r.q_id, r.c_id): r.score for r in knn.catalog_knn(*fine, cfg, block_rows=7).collect()}
    assert got == pytest.approx(want)


def test_hybrid_and_modes(spark):
    catalog, new = vectors(spark, 60, 0, 5), vectors(spark, 40, 1000, 6)
    cfg = MatchConfig(overfetch=None, limit=3)
    found, status, quarantine = match.match(new, catalog, cfg)
    modes = {r.mode for r in found.select("mode").distinct().collect()}
    assert modes == {"hybrid", "metadata"} and quarantine.count() == 0 and status.count() == 40
    hybrid = found.filter("mode = 'hybrid'").collect()
    assert all(r.similarity_score == pytest.approx(0.5 * r.visual_score + 0.5 * r.metadata_score) and r.similarity_score >= 30 for r in hybrid)
    _, status, quarantine = match.match(new, catalog, cfg, "visual")
    assert quarantine.count() == 5 and {r.error_code for r in quarantine.collect()} == {"MISSING_FEATURES"}
    summary = match.batch_summary(status).first()
    assert (summary.total, summary.failed) == (40, 5)


def test_empty_catalog(spark):
    new = spark.createDataFrame(rows(5, 2, 1000), SCHEMA)
    assert match.metadata_matches(new, new.filter("id < 0")).count() == 0


def test_config_checks():
    for bad in ({"threshold": 101}, {"limit": -1}, {"visual_weight": 0.9}):
        with pytest.raises(ValueError, match="must"):
            MatchConfig(**bad)


def test_knn_leaves_out_unusable_vectors(spark):
    kind = "id long, key string, embedding array<double>"
    odd = [(1, "a", [1.0, 0.0]), (2, "a", None), (3, "a", []), (4, "a", [float("nan"), 1.0]), (5, "a", [1.0, 0.0, 0.0]), (6, "a", [0.0, 0.0]), (7, "a", [1.0, 1.0]), (8, None, [1.0, 0.0]), (9, "a", [1.0, None])]
    df = spark.createDataFrame(odd, kind)
    got = {(r.q_id, r.c_id): r.cosine for r in knn.knn_join(df, df, 10).collect()}
    assert got == pytest.approx({(1, 6): 0, (6, 1): 0, (1, 7): 0.5**0.5, (7, 1): 0.5**0.5, (6, 7): 0, (7, 6): 0})


def test_candidate_pairs_are_joined_once(spark):
    catalog, new = spark.createDataFrame(rows(60, 1), SCHEMA), spark.createDataFrame(rows(40, 2, 1000), SCHEMA)
    plan = match.metadata_matches(new, catalog, MatchConfig(distinct_names=False))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_bounds_leave_out_no_match(spark):
    """Odd prices, sales and SKUs; limits and thresholds; against all pairs."""
    rnd = random.Random(9)
    odd = lambda n, first: [(*r[:5], r[5], r[6], rnd.choice([None, -1.0, 0.0, 9.5, 10.0, 11.0, float("nan")]), rnd.choice([None, 0, -4, -8, 5, 50])) for r in rows(n, first, first)]
    catalog, new = spark.createDataFrame(odd(150, 1), SCHEMA), spark.createDataFrame(odd(40, 1000), SCHEMA)
    for kind in ({"limit": 3}, {"limit": 10, "threshold": 55.0}, {"limit": 0, "threshold": 70.0}, {"limit": 5, "match_against_all": True}):
        got = [sorted(tuple(r) for r in match.metadata_matches(new, catalog, MatchConfig(distinct_names=d, **kind)).select("new_product_id", "matched_product_id", "rank", "similarity_score").collect()) for d in (True, False)]
        assert got[0] == got[1]


def test_fewer_pairs_are_formed(spark):
    c = Catalog(spark, "/root/testdata/sf0.1")
    sides = [match.prepared(c.with_latest(p)) for p in (c.new.filter("id % 100 = 0"), c.historical)]
    best, pruned = match.metadata_best(*sides, MatchConfig(limit=10))
    report = pruned.report().first()
    assert report.pairs >= 5 * report.formed >= 5 * report.seeded > 0 and best.count() == 10 * sides[0].count()


def described(spark, n, start, seed):
    rng = np.random.default_rng(seed)
    odd = lambda i, m: [None, [], [float("nan")] * m, [0.0] * m][i % 4] if i % 11 == 0 else rng.random(m if i % 13 else m + 1).tolist()
    return spark.createDataFrame([(*r, odd(i, 12), rng.standard_normal(7).tolist(), odd(i + 5, 12)) for i, r in enumerate(rows(n, seed, start))], SCHEMA + ", color array<double>, shape array<double>, texture array<double>")


@pytest.mark.parametrize("limit", [0, 4])
def test_descriptor_blocks_equal_all_pairs(spark, limit):
    catalog, new = described(spark, 120, 0, 3), described(spark, 50, 1000, 4)
    cfg = MatchConfig(limit=limit, min_threshold=20)
    scored = match.visual_scored(match.candidate_pairs(new, catalog, cfg), cfg).filter("error_code is null")
    want = {(r.q_id, r.c_id): r.similarity_score for r in match.top(match.penalized(scored, cfg), cfg.floor, cfg.limit).collect()}
    got = {(r.new_product_id, r.matched_product_id): r.similarity_score for r in match.visual_matches(new, catalog, cfg, embeddings=False).collect()}
    assert got == pytest.approx(want) and want
    if limit:
        few = kernels.best(*match._split(new, catalog, cfg), limit, block_rows=1000)
        assert few.agg({"asked": "avg"}).first()[0] < 0.8 * catalog.count() / 3


def test_categories_that_mean_none_are_not_penalized(spark):
    """A row without category loses a tenth; one whose category is `n/a` shares its key and does not."""
    vector = lambda x: [float(x), 1.0]
    catalog = spark.createDataFrame([(i, "", None if i < 5 else "n/a", "x", "s", True, None, vector(2 if i < 5 else 2.1)) for i in range(10)], SCHEMA.split(", price")[0] + ", embedding array<double>")
    new = spark.createDataFrame([(100, "", "mugs", "x", "s", False, None, vector(2))], catalog.schema)
    got = match.visual_matches(new, catalog, MatchConfig(limit=5)).collect()
    assert {r.matched_product_id for r in got} == {5, 6, 7, 8, 9}


def test_hybrid_arms_meet_in_narrow_rows(spark):
    """The candidates' columns join what the ranking leaves, not every match of both arms."""
    catalog, new = vectors(spark, 60, 0, 5), vectors(spark, 40, 1000, 6)
    plan = match.hybrid_matches(new, catalog, MatchConfig(limit=3))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    met = next(i for i, x in enumerate(plan) if "Join FullOuter" in x)
    ranked = max(i for i, x in enumerate(plan[:met]) if "Window [" in x)
    assert ranked < met and not any("product_name" in x for x in plan[ranked:met])
