"""Price and performance histories: latest rows, statistics, trends, linking. One shuffle by product each. Averages of prices
are sums of decimals, so they do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.history import KEEP
from ..functions.text import half_up


def latest(history: DataFrame, order: str = "date") -> DataFrame:
    """The row with the latest date of each product; of equal dates the first by the other columns, where `id` decides if
    there is one."""
    rest = [c for c in history.columns if c not in ("product_id", order)]
    tie = (-F.col("id"),) if "id" in history.columns else tuple(F.col(c) for c in rest)
    row = F.max_by(F.struct(*rest, order), F.struct(F.col(order), *tie))
    return history.groupBy("product_id").agg(row.alias("r")).select("product_id", *(F.col(f"r.{c}").alias(c) for c in history.columns if c != "product_id"))


def latest_prices(prices: DataFrame) -> DataFrame:
    return latest(prices.select("product_id", "date", "price"))


def latest_performance(performance: DataFrame) -> DataFrame:
    return latest(performance.select("product_id", "date", "sales", "views", "conversion_rate", "revenue"))


def with_latest(products: DataFrame, prices: DataFrame, performance: DataFrame) -> DataFrame:
    """products with price and sales of their latest records (null without one)."""
    price = latest_prices(prices).select(F.col("product_id").alias("id"), "price")
    sales = latest_performance(performance).select(F.col("product_id").alias("id"), "sales")
    return products.join(price, "id", "left").join(sales, "id", "left")


def latest_of_products(products: DataFrame, latest_rows: DataFrame, category: str | None = None, is_historical: bool | None = None) -> DataFrame:
    """Latest records joined with their products, newest record first."""
    chosen = products
    if category is not None:
        chosen = chosen.filter(F.col("category") == category)
    if is_historical is not None:
        chosen = chosen.filter(F.col("is_historical") == is_historical)
    return chosen.join(latest_rows, chosen["id"] == latest_rows["product_id"]).orderBy(F.desc("date"), "id")


def last_rows(history: DataFrame, n: int = KEEP) -> DataFrame:
    """The n latest rows of each product."""
    rank = F.row_number().over(W.partitionBy("product_id").orderBy(F.desc("date"), *[c for c in history.columns if c not in ("product_id", "date")]))
    return history.withColumn("rank", rank).filter(F.col("rank") <= n)


def trend(now: Column, before: Column, margin: float) -> Column:
    return F.when(now > before * (1 + margin), "up").when(now < before * (1 - margin), "down").otherwise("stable")


def price_statistics(prices: DataFrame) -> DataFrame:
    last = W.partitionBy("product_id").orderBy("date", "price")
    rows = prices.withColumn("before", F.lag("price").over(last))
    out = rows.groupBy("product_id").agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), (F.sum(F.col("price").cast("decimal(28,6)")).cast("double") / F.count("price")).alias("mean"),
        F.max_by(F.struct("price", "before"), F.struct("date", "price")).alias("now"), F.count("price").alias("data_points"),
    )
    return out.select(
        "product_id", F.round("lo", 2).alias("min_price"), F.round("hi", 2).alias("max_price"), half_up(F.col("mean"), 2).alias("average_price"),
        F.round("now.price", 2).alias("current_price"), trend(F.col("now.price"), F.col("now.before"), 0.05).alias("trend"), "data_points",
    )


def performance_statistics(performance: DataFrame) -> DataFrame:
    last = W.partitionBy("product_id").orderBy("date", "sales")
    rows = performance.withColumns({"sales_before": F.lag("sales").over(last), "rate_before": F.lag("conversion_rate").over(last)})
    out = rows.groupBy("product_id").agg(
        F.sum("sales").alias("total_sales"), F.sum("views").alias("total_views"), F.sum("revenue").alias("revenue"), F.avg("conversion_rate").alias("rate"),
        F.count("*").alias("data_points"), F.max_by(F.struct("sales", "sales_before", "conversion_rate", "rate_before"), F.struct("date", "sales")).alias("now"),
    )
    return out.select(
        "product_id", "total_sales", "total_views", F.round("revenue", 2).alias("total_revenue"), F.round("rate", 2).alias("avg_conversion"),
        F.round(F.col("total_sales") / F.col("data_points"), 1).alias("avg_sales_per_period"),
        trend(F.col("now.sales"), F.col("now.sales_before"), 0.1).alias("sales_trend"),
        trend(F.col("now.conversion_rate"), F.col("now.rate_before"), 0.05).alias("conversion_trend"), "data_points",
    )


def link(history: DataFrame, links: DataFrame, n: int = KEEP) -> DataFrame:
    """The rows to append so that each dst of links (src, dst) has the n latest rows of its src, dates it has already left
    out. A date that several sources give is taken once, from the smallest source."""
    rows = last_rows(history, n).drop("rank").withColumnRenamed("product_id", "src")
    copied = links.select("src", "dst").distinct().join(rows, "src").withColumnRenamed("dst", "product_id")
    first = F.row_number().over(W.partitionBy("product_id", "date").orderBy("src", *[c for c in history.columns if c not in ("product_id", "date")]))
    copied = copied.withColumn("_first", first).filter("_first = 1").drop("_first", "src")
    return copied.join(history.select("product_id", "date"), ["product_id", "date"], "left_anti").select(history.columns)
