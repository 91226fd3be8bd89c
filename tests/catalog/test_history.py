import datetime

import pytest
from pyspark.sql import functions as F

from skuweave.functions import history as H
from skuweave.operators import histories
from skuweave.sources import ingest

PRICES = [("2024-01-15", 29.99), ("2024-02-15", 31.50), ("2024-03-15", 28.75), ("2024-04-15", 32.00), ("2024-05-15", 30.25)]


def day():
    return F.lit(datetime.date(2024, 6, 15))


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


def prices(spark, id=1):
    return spark.createDataFrame([(id, datetime.date.fromisoformat(d), p) for d, p in PRICES], "product_id long, date date, price double")


def test_price_history_formats(spark):
    parse = lambda text: one(spark, text, lambda c: H.price_history(c, day()))
    assert [(str(r.date), r.price) for r in parse("2024-02-15:31.5; 1/15/2024:29.99 ;bad:1;2024-01-01:-2")] == [("2024-01-15", 29.99), ("2024-02-15", 31.5)]
    assert [(str(r.date), r.price) for r in parse("29.99,31.50;28.75")] == [("2024-04-15", 29.99), ("2024-05-15", 31.5), ("2024-06-15", 28.75)]
    assert parse("") is None and parse("x") is None and parse(None) is None
    assert len(parse(";".join("1" for _ in range(20)))) == 12


def test_performance_history_formats(spark):
    parse = lambda text: one(spark, text, lambda c: H.performance_history(c, day()))
    assert [(str(r.date), r.sales) for r in parse("[100, 105]")] == [("2024-05-15", 100), ("2024-06-15", 105)]
    (r,) = parse("2024-01-15:150:1200:12.5:1800;1:2")
    assert (str(r.date), r.sales, r.views, r.conversion_rate, r.revenue) == ("2024-01-15", 150, 1200, 12.5, 1800)
    assert [(str(r.date), r.sales) for r in parse("150:1200:12.5:1800;180:1500:12.0:2160;1:1:101:1")] == [("2024-05-15", 180), ("2024-06-15", 150)]


def test_writing_and_reading_again(spark):
    text = "2024-01-15:29.99;2024-02-15:31.5"
    assert one(spark, text, lambda c: H.write_prices(H.price_history(c, day()))) == text
    assert one(spark, "[1, 2]", lambda c: H.write_sales(H.performance_history(c, day()))) == "[1,2]"
    assert one(spark, "2024-01-15,5\n\n7", lambda c: F.transform(H.pasted_prices(c, day()), lambda r: r["price"])) == [5.0, 7.0]
    assert one(spark, "5\nx\n7", H.pasted_sales) == [5, 7]


def test_price_statistics(spark):
    r = histories.price_statistics(prices(spark)).first()
    assert (r.min_price, r.max_price, r.average_price, r.current_price, r.trend, r.data_points) == (28.75, 32.0, 30.5, 30.25, "down", 5)


def test_performance_statistics(spark):
    rows = [(1, datetime.date(2024, i, 15), s, 100 * s, c, 12.0 * s) for i, (s, c) in enumerate([(150, 10.0), (180, 10.5), (200, 11.5), (220, 11.0), (190, 11.2)], 1)]
    r = histories.performance_statistics(spark.createDataFrame(rows, "product_id long, date date, sales long, views long, conversion_rate double, revenue double")).first()
    assert (r.total_sales, r.total_revenue, r.avg_sales_per_period, r.sales_trend, r.conversion_trend) == (940, 11280.0, 188.0, "down", "stable")


def test_linking_copies_missing_dates(spark):
    both = prices(spark).unionByName(spark.createDataFrame([(2, datetime.date(2024, 1, 15), 1.0)], "product_id long, date date, price double"))
    links = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    got = histories.link(both, links).groupBy("product_id").count().collect()
    assert {r.product_id: r["count"] for r in got} == {2: 4, 3: 5}


def test_validation(spark):
    rows = spark.createDataFrame([("2024-01-15", "1"), ("2024-02-30", "1"), ("", "1"), ("2024-01-15", "x"), ("2024-01-15", "-1")], "date string, price string")
    good, bad = ingest.split(ingest.checked_prices(rows))
    assert good.count() == 1 and bad.count() == 4


@pytest.mark.parametrize("text", ["Jan 5, 2024", "2024/1/5", "5 Jan 2024", "1/5/2024"])
def test_dates(spark, text):
    assert str(one(spark, text, H.parse_date)) == "2024-01-05"
