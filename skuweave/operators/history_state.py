"""Price and performance histories as mergeable state: a row of partial aggregates for each product, into which batches of new rows
are merged, so that statistics and latest rows read the state and not all histories.

The aggregates form a commutative monoid (merged()): sums of decimals, counts, extremes, and the last two rows of a product. The
state is a table bucketed by product; a merge reads the buckets in place, shuffles the batch alone, and writes a new version,
which a pointer of one row then names: a merge that dies leaves the version before it. Each batch has a name, and one that the
state holds already is not merged again.

A hot product is one row of state; its new rows are combined before they are shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import half_up
from .histories import trend

PRICE, SALES = ["price"], ["sales", "views", "conversion_rate", "revenue"]


def _last_two(rows: Column) -> Column:
    return F.slice(F.sort_array(rows, asc=False), 1, 2)


def partial(rows: DataFrame, kind: str) -> DataFrame:
    """One row of state for each product of a batch."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)"))
    if kind == "price":
        whole = rows.select("product_id", F.col("date"), F.col("price").cast("double").alias("price"))
        point, more = F.struct("date", "price"), [F.min("price").alias("lo"), F.max("price").alias("hi"), exact("price").alias("total"), F.count("price").alias("n")]
    else:
        whole = rows.select("product_id", "date", F.col("sales").cast("long").alias("sales"), F.col("views").cast("long").alias("views"), F.col("conversion_rate").cast("double").alias("conversion_rate"), F.col("revenue").cast("double").alias("revenue"))
        point = F.struct("date", "sales", "views", "conversion_rate", "revenue")
        more = [F.sum("sales").alias("sales"), F.sum("views").alias("views"), exact("revenue").alias("revenue"), exact("conversion_rate").alias("rates"), F.count("conversion_rate").alias("n_rates"), F.count("*").alias("n")]
    # the limit holds in each task before rows are shuffled, so a hot product sends two rows from each
    rank = F.row_number().over(W.partitionBy("product_id").orderBy(F.desc("point")))
    last = whole.select("product_id", point.alias("point")).withColumn("rank", rank).filter("rank <= 2")
    last = last.groupBy("product_id").agg(_last_two(F.collect_list("point")).alias("last"))
    return last.join(whole.groupBy("product_id").agg(*more), "product_id")


def merged(states: DataFrame, kind: str) -> DataFrame:
    """Rows of state, any number for a product, as one for each."""
    add = lambda c: F.sum(c).alias(c)
    more = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), add("total"), add("n")] if kind == "price" else [add(c) for c in ("sales", "views", "revenue", "rates", "n_rates", "n")]
    last = _last_two(F.flatten(F.collect_list("last")))  # two rows from the state and from each batch
    kinds = {f.name: f.dataType for f in states.schema}
    out = states.groupBy("product_id").agg(last.alias("last"), *more)
    return out.select([F.col(c).cast(kinds[c]).alias(c) for c in states.columns])


class HistoryState:
    """Under path: versions of the state and a pointer to the current one. kind: price or performance."""

    def __init__(self, spark: SparkSession, path: str, kind: str, buckets: int = 16):
        if kind not in ("price", "performance"):
            raise ValueError(f"unknown kind {kind}")
        self.spark, self.path, self.kind, self.buckets = spark, path.rstrip("/"), kind, buckets
        self._named: dict[str, str] = {}

    def _current(self) -> tuple[int, str | None, list[str]]:
        """Number and folder of the current version, and the batches in it."""
        try:
            row = self.spark.read.schema("number int, version string, batches array<string>").parquet(f"{self.path}/current").orderBy(F.desc("number")).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return (row.number, row.version, list(row.batches)) if row else (0, None, [])

    def _table(self, version: str) -> DataFrame:
        """A version as a bucketed table of this session, so that nothing that joins or groups by product shuffles it."""
        if version not in self._named:
            name, folder = f"history_state_{uuid.uuid4().hex}", f"{self.path}/{version}"
            schema = self.spark.read.parquet(folder)._jdf.schema().toDDL()
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (product_id) SORTED BY (product_id) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
            self._named[version] = name
        return self.spark.table(self._named[version])

    def merge(self, rows: DataFrame, batch: str) -> bool:
        """Merges a batch of history rows; False if the state has it already."""
        number, version, batches = self._current()
        if batch in batches:
            return False
        new = partial(rows, self.kind)
        if version:
            new = self._table(version).unionByName(new.repartition(self.buckets, "product_id").select(self._table(version).columns))
        made = f"state-{uuid.uuid4().hex}"
        name = f"history_state_{uuid.uuid4().hex}"
        merged(new, self.kind).repartition(self.buckets, "product_id").write.format("parquet").bucketBy(self.buckets, "product_id").sortBy("product_id").option("path", f"{self.path}/{made}").saveAsTable(name)
        self._named[made] = name
        self.spark.createDataFrame([(number + 1, made, [*batches, batch])], "number int, version string, batches array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/current")
        return True

    def state(self) -> DataFrame:
        version = self._current()[1]
        if version is None:
            raise ValueError("nothing has been merged yet")
        return self._table(version)

    def latest(self) -> DataFrame:
        """The latest row of each product."""
        fields = PRICE if self.kind == "price" else SALES
        now = F.get("last", F.lit(0))
        return self.state().select("product_id", now["date"].alias("date"), *(now[c].alias(c) for c in fields))

    def statistics(self) -> DataFrame:
        """What histories.price_statistics or performance_statistics find over all rows."""
        now, before, state = F.get("last", F.lit(0)), F.get("last", F.lit(1)), self.state()
        if self.kind == "price":
            return state.select(
                "product_id", F.round("lo", 2).alias("min_price"), F.round("hi", 2).alias("max_price"), half_up(F.col("total").cast("double") / F.col("n"), 2).alias("average_price"),
                F.round(now["price"], 2).alias("current_price"), trend(now["price"], before["price"], 0.05).alias("trend"), F.col("n").alias("data_points"),
            )
        return state.select(
            "product_id", F.col("sales").alias("total_sales"), F.col("views").alias("total_views"), F.round(F.col("revenue").cast("double"), 2).alias("total_revenue"),
            F.round(F.col("rates").cast("double") / F.col("n_rates"), 2).alias("avg_conversion"), F.round(F.col("sales") / F.col("n"), 1).alias("avg_sales_per_period"),
            trend(now["sales"], before["sales"], 0.1).alias("sales_trend"), trend(now["conversion_rate"], before["conversion_rate"], 0.05).alias("conversion_trend"), F.col("n").alias("data_points"),
        )
