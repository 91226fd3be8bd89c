"""Metadata matching with bounds before pairs: the best candidates of each query without forming all its pairs.

Catalog rows of a key with one cleaned name are a group, summed up by its number of rows and the ranges of its prices, sales
and SKU lengths. The score of a query with any row of a group has an upper bound: category and name are those of the group, price and
sales are best at the near end of their ranges, the SKU can differ by no less than its length does. Queries meet groups first;
the groups with the best bounds that together hold more rows than the limit are scored, and the k-th score found there (or the
threshold) is what another group's bound must reach before any pair of it is formed. What is left out could not have been
among the best, so the matches are those of all pairs.

With a limit, rows are profiles of products that are alike (operators.match), c_m is how many products one stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import text as T
from ..shared import written

SLACK = 1e-6  # for sums in another order


def groups(right: DataFrame) -> DataFrame:
    """right: c_* columns of catalog rows with key. A row for each key and cleaned name."""
    price, sales, size = F.col("c_price"), F.col("c_sales"), F.char_length("c_nsku")
    odd = F.coalesce((price <= 0) | F.isnan(price), F.lit(True))
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return right.groupBy("key", "c_clean").agg(
        F.count("*").alias("m"), (F.sum("c_m") if "c_m" in right.columns else F.count("*")).alias("held"), F.min("c_id").alias("one_id"), F.any_value("c_ncategory").alias("c_ncategory"),
        F.min(F.when(~odd, price)).alias("price_lo"), F.max(F.when(~odd, price)).alias("price_hi"), some(odd).alias("odd_price"),
        F.min(F.when(sales > 0, sales)).alias("sales_lo"), F.max(F.when(sales > 0, sales)).alias("sales_hi"), some(sales.isNull()).alias("no_sales"), some(sales == 0).alias("zero_sales"), some((sales < 0) | F.isnan(sales)).alias("odd_sales"),
        F.min(F.when(size > 0, size)).alias("sku_lo"), F.max(F.when(size > 0, size)).alias("sku_hi"),
    )


def nearest(x: Column, lo: Column, hi: Column) -> Column:
    """The number of a range that is nearest to x; null if the range is empty."""
    return F.when(lo.isNotNull(), F.greatest(lo, F.least(hi, x)))


def upper_bound(cfg: MatchConfig) -> Column:
    """Of a query's score with any row of a group, from q_* columns, name_score and those of groups()."""
    w, starts = cfg.metadata_weights, T.WEIGHT_STARTS
    part = lambda name, score: T.asymmetric(score, w[name], starts[name])
    zero = F.lit(0.0)
    q_price, q_sales, q_size = F.col("q_price"), F.col("q_sales"), F.char_length("q_nsku")
    price = F.greatest(F.when(F.col("odd_price") | q_price.isNull(), 50.0).otherwise(zero), T.price_similarity(q_price, nearest(q_price, F.col("price_lo"), F.col("price_hi"))))
    some_sales = F.when(F.col("sales_lo").isNotNull(), T.performance_similarity(q_sales, nearest(q_sales, F.col("sales_lo"), F.col("sales_hi")))).otherwise(zero)
    of_zero = F.when(F.col("zero_sales"), T.performance_similarity(q_sales, zero)).otherwise(zero)
    sales = F.greatest(F.when(F.col("no_sales") | q_sales.isNull(), 50.0).otherwise(zero), some_sales, of_zero, F.when(F.col("odd_sales") | (q_sales < 0) | F.isnan(q_sales), float("inf")).otherwise(zero))
    near = nearest(q_size, F.col("sku_lo"), F.col("sku_hi"))
    sku = F.when((F.coalesce(q_size, F.lit(0)) == 0) | near.isNull(), zero).when(F.abs(near - q_size) > 5, zero).otherwise((1 - F.abs(near - q_size) / F.greatest(near, q_size)) * 100)
    category = T.normalized_category_similarity(F.col("q_ncategory"), F.col("c_ncategory"))
    return part("sku", sku) + part("name", F.col("name_score")) + part("category", category) + part("price", price) + part("performance", sales) + SLACK


class Pruned:
    """The pairs of left (q_* columns with key) and right (c_*, key) that can be among the best cfg.limit of their query and reach
    cfg.threshold. names: key, q_clean, c_clean, name_score, for all pairs of distinct cleaned names. pairs, seeded and formed are
    the numbers of pairs: all, those scored first, and all that are formed. With c_m in right, rows stand for c_m products, and
    a row may meet one of its own id, which the caller drops among the products: one more than the limit are found."""

    def __init__(self, left: DataFrame, right: DataFrame, names: DataFrame, cfg: MatchConfig, scored):
        self.left, self.right, self.cfg, self.scored = left, right, cfg, scored
        self.itself = "c_m" in right.columns
        met = left.join(names, ["key", "q_clean"]).join(groups(right), ["key", "c_clean"])
        if not self.itself:  # a group that holds the query alone forms no pair
            met = met.filter(~((F.col("m") == 1) & (F.col("one_id") == F.col("q_id"))))
        bounded = met.select("q_id", "key", "c_clean", "name_score", "m", "held", upper_bound(cfg).alias("bound"))
        # seeds: one more row than the limit, as the query itself may be in a group
        order = W.partitionBy("q_id").orderBy(F.desc("bound"), "key", "c_clean").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("held").over(order), F.lit(0)) if cfg.limit else F.lit(0)
        self.bounded = written(bounded.withColumns({"seed": (before <= cfg.limit) if cfg.limit else F.lit(True), "open": F.col("bound") >= cfg.threshold}), "bounds")

    def _pairs(self, chosen: DataFrame) -> DataFrame:
        """Scored pairs of the groups chosen."""
        rows = chosen.select("q_id", "key", "c_clean", "name_score").join(self.left.drop("q_clean"), ["q_id", "key"])
        pairs = rows.join(self.right, ["key", "c_clean"]).drop("c_clean")
        return self.scored(pairs if self.itself else pairs.filter("q_id <> c_id"), self.cfg)

    def best(self, rank) -> DataFrame:
        """rank(scored pairs): the best of each query, with similarity_score."""
        k, open_ = self.cfg.limit + self.itself, self.bounded.filter("open")
        self.first, self.rest = open_.filter("seed"), open_.filter("not seed")
        if not self.cfg.limit:
            return rank(self._pairs(self.first))
        seeds = written(rank(self._pairs(self.first)), "seeds")
        held = F.sum(F.col("c_m") if self.itself else F.lit(1)).over(W.partitionBy("q_id").orderBy("rank"))
        reached = seeds.withColumn("held", held).filter(F.col("held") >= k).groupBy("q_id").agg(F.max("similarity_score").alias("worst"))
        self.rest = written(self.rest.join(reached.select("q_id", "worst"), "q_id", "left").filter("worst is null or bound >= worst").drop("worst"), "rest")
        return rank(seeds.drop("rank").unionByName(rank(self._pairs(self.rest)).drop("rank")))

    def report(self) -> DataFrame:
        """After best(): pairs, seeded, formed."""
        total = self.bounded.agg(F.sum("m").alias("pairs"))
        seeded, more = self.first.agg(F.sum("m").alias("seeded")), self.rest.agg(F.sum("m").alias("more"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return total.crossJoin(seeded).crossJoin(more).select(zero("pairs").alias("pairs"), zero("seeded").alias("seeded"), (zero("seeded") + zero("more")).alias("formed"))  # one row each
