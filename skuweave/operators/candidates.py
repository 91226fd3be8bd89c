"""Keys on which queries meet their candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import text as T

NONE = "\x00"  # the key of what has no category


def keyed_queries(queries: DataFrame, catalog: DataFrame, cfg: MatchConfig) -> DataFrame:
    """queries with a row and `key` for each key of the catalog that they are matched with."""
    category = T.normalize_category(F.col("category"))
    every = catalog.select(F.coalesce(T.normalize_category(F.col("category")), F.lit(NONE)).alias("key")).distinct()
    own = F.array(category, F.lit(NONE)) if cfg.include_uncategorized else F.array(category)
    if cfg.match_against_all:
        return queries.crossJoin(every)  # a row for each category of the catalog
    some = queries.filter(category.isNotNull()).withColumn("key", F.explode(own))
    return some.unionByName(queries.filter(category.isNull()).crossJoin(every))


def keyed_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("key", F.coalesce(T.normalize_category(F.col("category")), F.lit(NONE)))


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("key",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])
