"""Where pairs are many, rows of the catalog are sent to fewer blocks."""

from pyspark.sql import functions as F

from skuweave.operators import meeting


def test_rows_sent_grow_as_the_input(spark, monkeypatch):
    for name, value in (("Q_BLOCK", 16), ("C_BLOCK", 64), ("MANY_PAIRS", 10_000)):
        monkeypatch.setattr(meeting, name, value)
    sent = []
    for n in (100, 300):
        side = lambda x: spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias(f"{x}_id"), F.lit(1).alias(f"{x}_m"))  # noqa: B023, E731
        left, right, keys = meeting.dealt(side("q"), side("c"), ["key"])
        assert left.join(right, keys).select("q_id", "c_id").distinct().count() == left.join(right, keys).count() == n * n
        sent.append(right.count())
    assert sent[1] <= 3 * sent[0]
