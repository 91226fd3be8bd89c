import datetime
import random

import pytest
from pyspark.sql import functions as F

from skuweave.operators import histories
from skuweave.operators.history_state import HistoryState
from skuweave.shared import new_path

DAY = datetime.date(2024, 1, 1)


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", ["price", "performance"])
def test_batches_in_any_order_equal_all_rows(spark, kind):
    rnd = random.Random(7)
    day = lambda: DAY + datetime.timedelta(rnd.randrange(12))
    product = lambda: rnd.choice([1, 1, 1, 2, 3, rnd.randrange(4, 60)])
    if kind == "price":
        rows, schema = [(product(), day(), round(rnd.uniform(1, 9), 2)) for _ in range(600)], "product_id long, date date, price double"
    else:
        rows, schema = [(product(), day(), rnd.randrange(50), rnd.randrange(9), float(rnd.randrange(5)), round(rnd.uniform(0, 99), 2)) for _ in range(600)], "product_id long, date date, sales long, views long, conversion_rate double, revenue double"
    rows += [rows[0]] * 2
    every = spark.createDataFrame(rows, schema)
    path = new_path(spark, "state")
    for number, part in enumerate((rows[400:], rows[:1], rows[1:400], [])):
        assert HistoryState(spark, path, kind, 3).merge(spark.createDataFrame(part, schema), f"b{number}")  # each as another run
    state = HistoryState(spark, path, kind, 3)
    assert not state.merge(every, "b1")  # known already
    want = histories.price_statistics if kind == "price" else histories.performance_statistics
    assert table(state.statistics()) == table(want(every))
    latest = histories.latest_prices if kind == "price" else histories.latest_performance
    assert table(state.latest()) == table(latest(every).select(state.latest().columns))
    assert state.state().count() == every.select("product_id").distinct().count()


def test_a_merge_that_died_is_repeated_and_the_state_is_not_shuffled(spark):
    path, schema = new_path(spark, "state"), "product_id long, date date, price double"
    state = HistoryState(spark, path, "price", 4)
    with pytest.raises(ValueError):
        state.state()
    state.merge(spark.createDataFrame([(1, DAY, 2.0)], schema), "a")
    broken = spark.createDataFrame([(1, DAY, 3.0)], schema).withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        state.merge(broken, "b")
    assert state.statistics().first().current_price == 2.0
    assert state.merge(spark.createDataFrame([(1, DAY, 3.0)], schema), "b") and state.statistics().first().max_price == 3.0
    assert "Exchange" not in state.statistics()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in state.state().groupBy("product_id").count()._jdf.queryExecution().executedPlan().toString()
