"""Pages of an ordered table, each read from the ranges that hold it.

The rows are sorted once: dealt into ranges of the order, ranked inside them, and written in a folder for each range. The sizes of
the ranges, a few numbers, tell in which of them a page lies and how many rows come before, so a page reads its own ranges and
sorts nothing else, however far back it is. A page by key needs no count: it reads on from the last row of the page before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Pages:
    """Under path: rows in folders by range, sizes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, *order: Column, ranges: int | None = None) -> None:
        """order: what rows are ordered by; it should tell all rows apart (end it with the id)."""
        n = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
        # rows of a task follow each other in order, so the number in the partition is their place
        placed = dealt.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)))
        placed.write.partitionBy("_range").parquet(f"{self.path}/rows")
        self._rows().groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.path}/sizes")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def sizes(self) -> list[tuple[int, int]]:
        """(range, rows), in order."""
        return [(r["_range"], r["n"]) for r in self.spark.read.parquet(f"{self.path}/sizes").orderBy("_range").collect()]

    def page(self, number: int, limit: int) -> DataFrame:
        """Rows of a page (from 1), with row (their place in the whole order, from 1), total and total_pages."""
        if number < 1 or limit < 1:
            raise ValueError("number and limit must be 1 or more")
        sizes = self.sizes()
        total, first, before, chosen = sum(n for _, n in sizes), (number - 1) * limit, 0, {}
        for r, n in sizes:
            if before < first + limit and before + n > first:
                chosen[r] = before
            before += n
        rows = self._rows().filter(F.col("_range").isin(list(chosen)) if chosen else F.lit(False))
        base = F.coalesce(*(F.when(F.col("_range") == r, b) for r, b in chosen.items()), F.lit(0))
        placed = rows.withColumn("row", base + F.col("_place") + 1).filter((F.col("row") > first) & (F.col("row") <= first + limit))
        return placed.drop("_range", "_place").withColumns({"total": F.lit(total), "total_pages": F.lit(-(-total // limit))}).orderBy("row")

    def after(self, row: int, limit: int) -> DataFrame:
        """The rows that follow a row (0 for the first page): what a page by key reads."""
        sizes, before, chosen, have = self.sizes(), 0, {}, 0
        for r, n in sizes:
            if before + n > row and have < limit:
                chosen[r] = before
                have += before + n - max(row, before)
            before += n
        rows = self._rows().filter(F.col("_range").isin(list(chosen)) if chosen else F.lit(False))
        base = F.coalesce(*(F.when(F.col("_range") == r, b) for r, b in chosen.items()), F.lit(0))
        placed = rows.withColumn("row", base + F.col("_place") + 1).filter((F.col("row") > row) & (F.col("row") <= row + limit))
        return placed.drop("_range", "_place").orderBy("row")
