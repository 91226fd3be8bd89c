"""Catalog maintenance as set-wise rewrites. A catalog is a dict of DataFrames: products, features, matches, price_history,
performance_history; every function returns the new DataFrames and writes nothing."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written

CHILDREN = {"features": ["product_id"], "matches": ["new_product_id", "matched_product_id"], "price_history": ["product_id"], "performance_history": ["product_id"]}


def numbered(rows: DataFrame, after: int, order: list[str]) -> DataFrame:
    """rows with id, from after + 1 in their order: ranked inside ranges of the order, then shifted by what the ranges before
    hold, so no task sees all rows. The ranges are written once, as they must not change between the two steps. Rows must
    differ in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return local.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("id", F.col("_before") + F.col("_rank") + after).drop("_part", "_rank", "_before")


def append_products(products: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """products with new rows, whose ids follow the largest one in the order given."""
    last = products.agg(F.max("id")).first()[0] or 0
    rows = numbered(new.drop("id"), last, order)
    return products.unionByName(rows, allowMissingColumns=True).select(products.columns)


def append_features(features: DataFrame, new: DataFrame) -> DataFrame:
    return features.unionByName(new, allowMissingColumns=True).select(features.columns)


def update(rows: DataFrame, patch: DataFrame, key: str = "id", blank_is_null: bool = False) -> DataFrame:
    """rows with the patch's values where it has some; blank_is_null: an empty string clears a value."""
    fields = [c for c in patch.columns if c != key]
    out = rows.join(patch.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in fields)), key, "left")

    def value(c: str):
        new = F.col(f"_{c}")
        if blank_is_null and dict(patch.dtypes)[c] == "string":
            return F.when(new == "", None).otherwise(F.coalesce(new, F.col(c)))
        return F.coalesce(new, F.col(c))

    return out.withColumns({c: value(c) for c in fields}).select(rows.columns)


def replace_features(features: DataFrame, new: DataFrame) -> DataFrame:
    return append_features(features.join(new.select("product_id"), "product_id", "left_anti").select(features.columns), new)


def bulk_set(products: DataFrame, ids: DataFrame, **values: str | None) -> DataFrame:
    """The same values for all ids; '' and None clear."""
    mark = products.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return mark.withColumns({c: F.when(F.col("_hit"), F.lit(v or None).cast(dict(products.dtypes)[c])).otherwise(F.col(c)) for c, v in values.items()}).select(products.columns)


def delete(catalog: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The catalog without these products and all that hangs on them."""
    gone = ids.select("id").distinct()
    out = {"products": catalog["products"].join(gone, "id", "left_anti").select(catalog["products"].columns)}
    for name, keys in CHILDREN.items():
        if name in catalog:
            rows = catalog[name]
            for key in keys:
                rows = rows.join(gone.withColumnRenamed("id", key), key, "left_anti")
            out[name] = rows.select(catalog[name].columns)
    return out


def deletion_counts(catalog: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(table, n): rows that delete() removes."""
    gone = ids.select("id").distinct()
    parts = [catalog["products"].join(gone, "id", "left_semi").agg(F.lit("products").alias("table"), F.count("*").alias("n"))]
    for name, keys in CHILDREN.items():
        if name in catalog:
            rows = catalog[name]
            flagged = rows
            for key in keys:
                flagged = flagged.join(gone.select(F.col("id").alias(key), F.lit(True).alias(f"_{key}")), key, "left")
            hit = F.lit(False)
            for key in keys:
                hit = hit | F.coalesce(F.col(f"_{key}"), F.lit(False))
            parts.append(flagged.agg(F.lit(name).alias("table"), F.count_if(hit).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def of_type(products: DataFrame, kind: str) -> DataFrame:
    """Ids of all, historical or new products."""
    if kind not in ("all", "historical", "new"):
        raise ValueError(f"unknown kind {kind}")
    return (products if kind == "all" else products.filter(F.col("is_historical") == (kind == "historical"))).select("id")


def of_categories(products: DataFrame, categories: list[str | None]) -> DataFrame:
    """Ids by category; '' and None stand for none."""
    named = [c for c in categories if c]
    hit = F.col("category").isin(named) if named else F.lit(False)
    return products.filter(hit | F.col("category").isNull() if len(named) < len(categories) else hit).select("id")


def older_than(products: DataFrame, days: int, as_of: datetime.datetime) -> DataFrame:
    return products.filter(F.col("created_at") < F.lit(as_of - datetime.timedelta(days=days))).select("id")


def without_rows(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Histories or matches without those of some products."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(rows.columns)


def cleared(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


# Rows to append


def price_rows(rows: DataFrame) -> DataFrame:
    """Those with a date and a price; USD by default."""
    return rows.filter("date is not null and price is not null").withColumn("currency", F.coalesce("currency", F.lit("USD")))


def performance_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("date is not null").fillna(0, ["sales", "views", "conversion_rate", "revenue"])


def load(products: DataFrame, new: DataFrame, mode: str, is_historical: bool = True, order: tuple[str, ...] = ("created_at", "sku"), save: Callable[[], None] | None = None) -> DataFrame:
    """use_existing, add_to_existing, or replace one side of the catalog. save: called before a replacement, to keep a snapshot
    of what goes (sources.snapshots.Snapshots.save_before)."""
    if mode == "use_existing":
        return products
    if mode == "add_to_existing":
        return append_products(products, new.withColumn("is_historical", F.lit(is_historical)), list(order))
    if mode == "replace":
        if save is not None:
            save()
        return append_products(products.filter(F.col("is_historical") != is_historical), new.withColumn("is_historical", F.lit(is_historical)), list(order))
    raise ValueError(f"unknown mode {mode}")


def normalized(products: DataFrame) -> DataFrame:
    """Blank text to null, SKUs in their standard form."""
    return products.withColumns({"sku": T.normalize_sku(F.col("sku")), "category": T.blank_to_null(F.col("category")), "product_name": T.blank_to_null(F.col("product_name"))})
