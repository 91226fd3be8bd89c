import random

import pytest
from pyspark.sql import functions as F

from skuweave.config import MatchConfig
from skuweave.operators import match, reports
from skuweave.sources import sinks
from skuweave.streaming.arrivals import current_matches, last_of_each


def test_the_last_of_equal_ids_whatever_the_partitions(spark):
    rows = [(i % 5, t, f"name {i % 3}", [float(i % 2)]) for i, t in enumerate([3, 1, 3, 2, 9, 3, 1, 2, 3, 9])] + [(None, 1, "x", None)]
    df = spark.createDataFrame(rows, "id long, at int, name string, v array<double>")
    got = [sorted(map(tuple, last_of_each(df.repartition(n), "at").collect()), key=str) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and {(r[0], r[1]) for r in got[0]} == {(0, 3), (1, 1), (2, 3), (3, 3), (4, 9), (None, 1)}
    assert last_of_each(df, "at").columns == df.columns


def test_later_arrivals_replace_matches(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame(list(x), "new_product_id long, matched_product_id long, mode string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    for number, found, came in ((0, [(1, 5, "m"), (2, 6, "m")], (1, 2, 3)), (9, [(1, 7, "m")], (1,)), (10, [(3, 8, "m")], (2, 3)), (9, [(1, 7, "m")], (1,))):
        sinks.matches(rows(*found), path, f"batch-{number}")
        sinks.arrivals(ids(*came), f"{path}-arrivals", number)
    assert sorted((r.new_product_id, r.matched_product_id) for r in current_matches(spark, path).collect()) == [(1, 7), (3, 8)]  # 2 came again and matched nothing


def test_quality_counters_equal_counts_of_pairs(spark):
    rnd = random.Random(6)
    vector = lambda: rnd.choice([None, [], [1.0, float("nan")], [float("inf"), 0.0], [1.0, 2.0], [1.0, 2.0], [3.0]])
    rows = lambda n, first: [(first + i, rnd.choice(["mugs", "Mugs", "plates", None, "n/a", "Unknown", ""]), rnd.choice([None, "x"]), rnd.choice(["", "s"]), vector()) for i in range(n)]
    schema = "id long, category string, product_name string, sku string, embedding array<double>"
    catalog, new = spark.createDataFrame(rows(80, 0), schema), spark.createDataFrame(rows(25, 1000), schema)
    new = new.filter("embedding is not null and size(embedding) = 2 and not exists(embedding, x -> isnan(x) or abs(x) = double('inf'))")
    pairs = match.embedding_scored(match.candidate_pairs(new, catalog, MatchConfig()), MatchConfig())
    hit = lambda *codes: F.count_if(F.coalesce(F.col("error_code"), F.lit("")).isin(*codes))
    want = pairs.groupBy("q_id").agg(F.count("*"), hit("MISSING_FEATURES", "EMPTY_FEATURES"), hit("NAN_FEATURES", "INF_FEATURES"), hit("FEATURE_DIMENSION_MISMATCH"), F.count_if(F.expr("c_product_name is null or c_sku = ''")), F.count_if(F.lower("c_category").isin("n/a", "unknown")), F.count_if(F.col("error_code").isNull()))
    got = match.quality_counters(new, catalog).select("new_product_id", "total_candidates", "missing_features", "corrupted_features", "computation_errors", "missing_metadata", "invalid_categories", "successful")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 3


@pytest.mark.parametrize("parts", [1, 4])
def test_warnings_of_repeated_skus(spark, parts):
    rows = [(i, sku, "1", "2024-01-01:2") for i, sku in enumerate(["a", "a", "b", "", "", None, "a", "", "c"])]
    df = spark.createDataFrame(rows, "row long, sku string, price string, price_history string").repartition(parts)
    assert sorted((r.row, r.warning) for r in reports.import_warnings(df).collect()) == [(i, "duplicate SKU: a x3") for i in (0, 1, 6)]
