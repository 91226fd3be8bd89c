"""Ingest of product batches and histories: validity columns, valid rows and quarantine, and the rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import history as H
from ..functions import text as T
from ..operators import match as M

METADATA_ONLY = "[METADATA_ONLY]"  # the image path of products without an image (fixed value)


def split(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull())


def checked_products(rows: DataFrame) -> DataFrame:
    """rows (sku, product_name, category, text) with error: what a metadata product lacks."""
    error = (
        F.when(T.normalize_sku(F.col("sku")).isNull(), "sku is required")
        .when(T.blank_to_null(F.col("product_name")).isNull(), "product_name is required")
        .when(~T.valid_sku(F.col("sku")), "invalid sku")
        .when(~T.valid_name(F.col("product_name")), "product_name too long")
        .when(~T.valid_category(F.col("category")), "invalid category")
    )
    return rows.withColumn("error", error)


def metadata_batch(rows: DataFrame, as_of: Column, is_historical: bool, reject_all: bool = True) -> dict[str, DataFrame]:
    """products, price_history, performance_history (by ref, the row's own key) and quarantine. rows: ref, sku, product_name,
    category, price (a number), price_history (text), performance_history (a JSON array of sales or entries). reject_all:
    one bad row rejects the batch, as quarantine then shows."""
    good, bad = split(checked_products(rows))
    if reject_all:
        any_bad = bad.agg(F.count("*").alias("_bad"))  # one row
        good = good.crossJoin(F.broadcast(any_bad)).filter("_bad = 0").drop("_bad")
    products = good.select("ref", F.lit(METADATA_ONLY).alias("image_path"), T.blank_to_null(F.col("category")).alias("category"), T.sanitize_name(F.col("product_name")).alias("product_name"),
                           T.normalize_sku(F.col("sku")).alias("sku"), F.lit(is_historical).alias("is_historical"))
    return {"products": products, "price_history": price_rows(good, as_of), "performance_history": sales_rows(good, as_of), "quarantine": bad}


def price_rows(rows: DataFrame, as_of: Column) -> DataFrame:
    """ref, date, price, currency: the parsed history and, for as_of, the price itself."""
    old = rows.select("ref", F.inline(H.price_history(F.col("price_history"), as_of)))
    now = rows.filter("price is not null").select("ref", as_of.alias("date"), F.col("price").cast("double").alias("price"))
    return now.unionByName(old.join(now.select("ref", "date"), ["ref", "date"], "left_anti")).withColumn("currency", F.lit("USD"))


def sales_rows(rows: DataFrame, as_of: Column) -> DataFrame:
    """ref, date, sales, views, conversion_rate, revenue: an array of sales stands 30 days apart; entries keep their dates."""
    array = F.from_json("performance_history", "array<double>")
    plain = F.transform(H.every_30_days(array, as_of), lambda r: F.struct(r["date"], r["sales"], F.lit(0).cast("long").alias("views"), F.lit(0.0).alias("conversion_rate"), F.lit(0.0).alias("revenue")))
    rows = rows.withColumn("_h", F.coalesce(plain.cast(H.SALES), H.performance_history(F.col("performance_history"), as_of)))
    return rows.select("ref", F.inline("_h"))


def image_batch(manifest: DataFrame, audit: DataFrame, is_historical: bool, category: str | None = None, on_bad_sku: str = "null") -> tuple[DataFrame, DataFrame]:
    """(products, quarantine) of a manifest (path, and optionally category, product_name, sku). audit: path and error_code
    (operators.images.audit). category: for rows without one. on_bad_sku: null clears it, reject refuses the row."""
    if on_bad_sku not in ("null", "reject"):
        raise ValueError(f"unknown choice {on_bad_sku}")
    have = lambda c: F.col(c) if c in manifest.columns else F.lit(None).cast("string")
    rows = manifest.select("path", have("category").alias("category"), have("product_name").alias("product_name"), have("sku").alias("sku"))
    rows = rows.join(audit.select("path", F.col("error_code").alias("error")), "path", "left")
    good_sku = T.valid_sku(F.col("sku"))
    if on_bad_sku == "reject":
        rows = rows.withColumn("error", F.coalesce("error", F.when(~good_sku, "INVALID_SKU")))
    good, bad = split(rows)
    return good.select(
        F.col("path").alias("image_path"), F.coalesce(T.blank_to_null(F.col("category")), F.lit(category)).alias("category"), T.sanitize_name(F.col("product_name")).alias("product_name"),
        T.normalize_sku(F.when(good_sku, F.col("sku"))).alias("sku"), F.lit(is_historical).alias("is_historical"),
    ), bad


def corrected(products: DataFrame, known: DataFrame) -> DataFrame:
    """products with categories in their stored spelling."""
    return M.resolve_categories(products, known)


def checked_prices(rows: DataFrame) -> DataFrame:
    """rows (date and price as text) with error."""
    day, price = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd")), F.col("price").try_cast("double")
    return rows.withColumn("error", F.when(F.coalesce("date", F.lit("")) == "", "date is required").when(day.isNull(), "invalid date").when(price.isNull() | F.isnan(price), "price must be a number").when(price < 0, "price must not be negative"))


def checked_performance(rows: DataFrame) -> DataFrame:
    """rows (text) with error; missing measures count as 0."""
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd"))
    error = F.when(F.coalesce("date", F.lit("")) == "", "date is required").when(day.isNull(), "invalid date")
    for c, kind in (("sales", "bigint"), ("views", "bigint"), ("conversion_rate", "double"), ("revenue", "double")):
        value = F.coalesce(F.col(c), F.lit("0")).try_cast(kind)
        error = error.when(value.isNull(), f"{c} must be a number").when(value < 0, f"{c} must not be negative")
        if c == "conversion_rate":
            error = error.when(value > 100, f"{c} must be 100 at most")
    return rows.withColumn("error", error)
