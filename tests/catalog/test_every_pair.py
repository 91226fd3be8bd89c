"""All candidate pairs: scored by profiles in blocks, expanded last."""

import pytest
from pyspark.sql import functions as F

from skuweave.config import MatchConfig
from skuweave.functions import text as T
from skuweave.operators import match, meeting
from skuweave.plans import queries

from .test_match import SCHEMA, rows

COLUMNS = ["q_id", "c_id", *match.METADATA_SCORES, "similarity_score"]


def copied(df, n):
    return df.withColumn("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("id") + i * 10_000)))


@pytest.mark.parametrize("few", [True, False])
def test_every_pair_once_with_its_scores(spark, monkeypatch, few):
    """Many blocks and rows of one profile; the catalog holds the queries, too."""
    for module, name, value in ((match, "IDS", 3), (meeting, "Q_BLOCK", 16), (meeting, "C_BLOCK", 8), (meeting, "SOME_PAIRS", 50)):
        monkeypatch.setattr(module, name, value)
    cfg = MatchConfig(limit=0, distinct_names=few)
    new = copied(spark.createDataFrame(rows(20, 2, 1000), SCHEMA), 5)
    stock = copied(spark.createDataFrame(rows(30, 1), SCHEMA), 5).unionByName(new)
    a, b = match.prepared(new), match.prepared(stock)
    scored = match.metadata_scored(match.metadata_pairs(a, b, cfg), cfg)
    want = scored.select("q_id", "c_id", *(F.round(c, 6).alias(c) for c in COLUMNS[2:]))
    assert sorted(map(tuple, match.metadata_every(a, b, cfg, 6).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, match.metadata_every(a, b, cfg).collect())) == sorted(map(tuple, scored.select(COLUMNS).collect()))


def test_copies_are_scored_once(spark, monkeypatch, tmp_path):
    """The registered query on tables of 10 copies with shifted keys: as many pairs are scored as on those of one."""
    sf = "/root/testdata/sf0.001"
    part, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("part", "lineitem"))
    shift = lambda c, n: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col(c) + i * 2_210_000))  # noqa: E731  of 13, 17 and 500
    counted, scored = [], match.metadata_scored

    def counting(pairs, cfg):
        counted.append(pairs.count())
        return scored(pairs, cfg)

    monkeypatch.setattr(match, "metadata_scored", counting)
    returned = []
    for n in (1, 10):
        part.withColumn("p_partkey", shift("p_partkey", n)).write.parquet(f"{tmp_path}/{n}/part.parquet")
        lines.withColumn("l_partkey", shift("l_partkey", n)).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        returned.append(queries.QUERIES["metadata_scores_all_pairs"](spark, f"{tmp_path}/{n}").count())
    assert returned[1] == 100 * returned[0] > 0
    assert counted[1] == counted[0]


def test_rounded_as_round(spark):
    values = [None, 0.0, -0.0, 1.0, 100.0, 66.66666666666667, 33.33333333333333, 0.1234565, 0.1234575, 2.0000005, 99.9999995, 12.3456785, 1e-7, 5e-7, 4.9999999e-7,
              -3.4567895, 1234567.8912345, 1e300, float("nan"), float("inf"), float("-inf"), *(k / 7 for k in range(700)), *(k + 0.0000005 for k in range(100))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    wrong = df.filter(~T.rounded(F.col("x"), 6).eqNullSafe(F.round("x", 6)))
    assert wrong.collect() == []
