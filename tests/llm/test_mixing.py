import pytest
from pyspark.sql import functions as F

from skuweave.llm import mixing as X
from skuweave.llm import queries as Q

from .brute import BLANKS

SF = "/root/testdata/sf0.001"


def filled(sizes, weights, epochs=3):
    """Shares by weight, again and again, until no source is above its limit."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > epochs * sizes[i]}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = epochs * sizes[i]
        open_ -= over
    return target


def check(docs, got):
    names = sorted({r.source for r in docs} - {None}) + ([None] if any(r.source is None for r in docs) else [])
    size = {n: sum(len(BLANKS.findall(r.text or "")) for r in docs if r.source == n) for n in names}
    want = dict(zip(names, filled([size[n] for n in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    assert len(got) == len(docs)
    for n in names:
        rows = [r for r in got if r.source == n]
        assert all(r.source_size == size[n] and r.target == pytest.approx(want[n]) and 0 <= r.taken <= 3 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - want[n]) <= 1
    return names


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = Q.op1_mix(spark, SF).collect()
    check(docs, got)
    assert {r.doc_id: r.size for r in got} == {r.doc_id: len(BLANKS.findall(r.text or "")) for r in docs}
    again = {r.doc_id: (r.taken, r.position) for r in Q.op1_mix(spark, SF).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        other = {r.doc_id: (r.taken, r.position) for r in Q.op1_mix(spark, SF).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == other == {r.doc_id: (r.taken, r.position) for r in got}


def test_limits_nulls_and_repeats(spark):
    rows = [(1, "a b c", "A"), (2, None, "A"), (3, "", "b"), (4, "x " * 500, None), (5, "y " * 40, "é"), (5, "y " * 40, "é"), (None, "z z", "é"), (7, "q", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs.collect(), X.assign(docs, Q.curriculum).collect())
    assert X.assign(docs.limit(0), Q.curriculum).count() == 0
    assert X.assign(docs.filter("text is null"), Q.curriculum).first().taken == 0


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i % 2 else "b") for i in range(2000)], "doc_id long, text string, source string")
    rise = lambda rank: F.when(rank == 1, F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w")), F.struct(F.lit(1.0).alias("t"), F.lit(2.0).alias("w")))).otherwise(
        F.array(F.struct(F.lit(0.0).alias("t"), F.lit(2.0).alias("w")), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("w"))))
    rows = X.mix(docs.withColumn("copy", F.lit("x")), rise).select("source", "position").collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    for t in (0.25, 0.5, 0.75):
        early = {s: sum(r.position <= t and r.source == s for r in rows) / 1000 for s in "ab"}
        assert early["a"] == pytest.approx(t * t, abs=0.01) and early["b"] == pytest.approx(1 - (1 - t) ** 2, abs=0.01)
