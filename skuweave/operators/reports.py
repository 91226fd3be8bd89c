"""Look-ups, searches, pages, quality and catalog reports, and result reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.history import parse_date
from ..shared import written


def newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), "id")


# Look-ups


def by_ids(products: DataFrame, ids: DataFrame) -> DataFrame:
    return products.join(ids.select("id"), "id", "left_semi")


def existing_ids(ids: DataFrame, products: DataFrame) -> DataFrame:
    """ids with `exists`."""
    known = products.select("id").distinct().withColumn("exists", F.lit(True))
    return ids.join(known, "id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def historical(products: DataFrame, category: str | None = None, limit: int = 100, offset: int = 0, include_uncategorized: bool = False) -> DataFrame:
    out = products.filter("is_historical")
    if category is not None:
        same = F.col("category") == category
        out = out.filter(same | F.col("category").isNull() if include_uncategorized else same)
    return newest(out).offset(offset).limit(limit)


def by_category(products: DataFrame, category: str | None, is_historical: bool | None = None, include_uncategorized: bool = False) -> DataFrame:
    """category None: only rows without one."""
    same = F.col("category").isNull() if category is None else F.col("category") == category
    if include_uncategorized:
        same = same | F.col("category").isNull()
    out = products.filter(same)
    return newest(out if is_historical is None else out.filter(F.col("is_historical") == is_historical))


def all_products(products: DataFrame, is_historical: bool | None = None) -> DataFrame:
    return newest(products if is_historical is None else products.filter(F.col("is_historical") == is_historical))


def without(products: DataFrame, column: str) -> DataFrame:
    """Rows whose column (category, sku) is null."""
    return newest(products.filter(F.col(column).isNull()))


def current_features(features: DataFrame) -> DataFrame:
    """One row for each product, the latest."""
    rest = [c for c in features.columns if c != "product_id"]
    order = [F.col(c) for c in ("created_at", "id") if c in rest] or [F.lit(0)]
    return features.groupBy("product_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("product_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def with_features(products: DataFrame, features: DataFrame) -> DataFrame:
    return products.join(features.withColumnRenamed("product_id", "id"), "id")


def feature_flag(products: DataFrame, features: DataFrame) -> DataFrame:
    have = features.select(F.col("product_id").alias("id")).distinct().withColumn("has_features", F.lit(True))
    return products.join(have, "id", "left").withColumn("has_features", F.coalesce("has_features", F.lit(False)))


def without_features(products: DataFrame, features: DataFrame) -> DataFrame:
    return products.join(features.select(F.col("product_id").alias("id")), "id", "left_anti")


def feature_candidates(products: DataFrame, features: DataFrame, category: str | None = None, is_historical: bool | None = None, include_uncategorized: bool = False, embedding_type: str | None = None, match_null_category: bool = False) -> DataFrame:
    """Products joined with their features, by category, side and kind of features."""
    out = with_features(products, features)
    if match_null_category:
        out = out.filter(F.col("category").isNull())
    elif category is not None:
        same = F.col("category") == category
        out = out.filter(same | F.col("category").isNull() if include_uncategorized else same)
    if is_historical is not None:
        out = out.filter(F.col("is_historical") == is_historical)
    return out if embedding_type is None else out.filter(F.col("embedding_type") == embedding_type)


def feature_details(products: DataFrame, features: DataFrame) -> DataFrame:
    """products with the sizes of their vectors and extraction_status."""
    arrays = [c for c, kind in features.dtypes if kind.startswith("array")]
    sized = features.select(F.col("product_id").alias("id"), *(F.size(c).alias(f"{c}_dim") for c in arrays), F.lit(True).alias("_there"))
    most = F.greatest(F.lit(0), *(F.coalesce(f"{c}_dim", F.lit(0)) for c in arrays))
    status = F.when(F.col("_there").isNull(), "pending").when(most > 0, "success").otherwise("failed")
    return products.join(sized, "id", "left").withColumn("extraction_status", status).drop("_there")


def to_extract_again(products: DataFrame, features: DataFrame, category: str | None = None, is_historical: bool | None = None) -> DataFrame:
    """Products whose features are of the legacy kind."""
    old = features.filter("embedding_type = 'legacy'").select(F.col("product_id").alias("id"))
    out = products.join(old, "id", "left_semi")
    out = out if category is None else out.filter(F.col("category") == category)
    return out if is_historical is None else out.filter(F.col("is_historical") == is_historical)


def by_sku(products: DataFrame, sku: str, case_sensitive: bool = False) -> DataFrame:
    if case_sensitive:
        return newest(products.filter(F.col("sku") == sku))
    return newest(products.filter(F.lower("sku") == sku.lower()))


def sku_exists(rows: DataFrame, products: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """rows with sku_exists: whether another product (by id, if rows have one) has the SKU."""
    key = (lambda c: c) if case_sensitive else F.lower
    known = products.filter("sku is not null").groupBy(key(F.col("sku")).alias("_key")).agg(F.count("*").alias("_n"), F.min("id").alias("_id"))
    out = rows.withColumn("_k", key(F.col("sku"))).join(known, F.col("_k") == F.col("_key"), "left")
    other = (F.col("_n") > 1) | (F.col("_n") == 1) & ~F.col("_id").eqNullSafe(F.col("id")) if "id" in rows.columns else F.col("_n") > 0
    return out.withColumn("sku_exists", F.coalesce(other, F.lit(False))).select(*rows.columns, "sku_exists")


def _holds(fields: list[str], query: str) -> Column:
    hit = F.lit(False)
    for c in fields:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False))
    return hit


def search(products: DataFrame, query: str, fields: tuple[str, ...] = ("product_name", "sku", "category"), category: str | None = None, is_historical: bool | None = None, limit: int = 100) -> DataFrame:
    out = products.filter(_holds(list(fields), query))
    out = out if category is None else out.filter(F.col("category") == category)
    out = out if is_historical is None else out.filter(F.col("is_historical") == is_historical)
    return newest(out).limit(limit)


def ranked_search(products: DataFrame, latest_prices: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Hits in the name first, then in the SKU, then in the category; with the latest price. products may be the hits of an
    index (operators.search_index)."""
    hits = products.filter(_holds(["product_name", "sku", "category"], query))
    rank = F.when(_holds(["product_name"], query), 0).when(_holds(["sku"], query), 1).otherwise(2)
    best = written(hits.withColumn("search_rank", rank).orderBy("search_rank", F.asc_nulls_first("product_name"), "id").limit(limit), "hits")
    # the semi join goes below what the latest prices are made from: only histories of the rows shown are grouped
    prices = latest_prices.select(F.col("product_id").alias("id"), "price").join(best.select("id"), "id", "left_semi")
    return best.join(prices, "id", "left")


SORTS = {"newest": lambda: (F.desc("created_at"),), "oldest": lambda: (F.asc("created_at"),), "name_asc": lambda: (F.asc("_name"),), "name_desc": lambda: (F.desc("_name"),), "category": lambda: (F.asc_nulls_first("category"),)}


def page_filter(products: DataFrame, features: DataFrame, search: str | None = None, category: str | None = None, is_historical: bool | None = None, has_features: bool | None = None) -> DataFrame:
    out = feature_flag(products, features)
    out = out if search is None else out.filter(_holds(["image_path", "sku", "product_name"], search))
    out = out if category is None else out.filter(F.col("category") == category)
    out = out if is_historical is None else out.filter(F.col("is_historical") == is_historical)
    return out if has_features is None else out.filter(F.col("has_features") == has_features)


def page(products: DataFrame, features: DataFrame, page: int = 1, limit: int = 50, sort_by: str = "newest", **filters) -> DataFrame:
    """One page of what page_filter() leaves, with filename, total and total_pages."""
    rows = page_filter(products, features, **filters)
    total = rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / limit))
    named = rows.withColumns({"filename": T.base_name(F.col("image_path")), "_name": F.coalesce("product_name", "image_path")})
    chosen = named.orderBy(*SORTS[sort_by](), "id").offset((page - 1) * limit).limit(limit).drop("_name")
    return chosen.crossJoin(F.broadcast(total))  # one row


def matches_for_product(matches: DataFrame, products: DataFrame, limit: int = 10) -> DataFrame:
    """The best matches of each product, with the matched products' columns."""
    rank = F.row_number().over(W.partitionBy("new_product_id").orderBy(F.desc("similarity_score"), "matched_product_id"))
    best = matches.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return best.join(products.withColumnRenamed("id", "matched_product_id"), "matched_product_id")


def comparison(matches: DataFrame, products: DataFrame, price_stats: DataFrame, performance_stats: DataFrame) -> DataFrame:
    """Both products of each match side by side, with their statistics."""

    def side(prefix: str, key: str) -> DataFrame:
        whole = products.join(price_stats.withColumnRenamed("product_id", "id").withColumnRenamed("data_points", "price_points"), "id", "left").join(performance_stats.withColumnRenamed("product_id", "id"), "id", "left")
        return whole.select(F.col("id").alias(key), *(F.col(c).alias(f"{prefix}{c}") for c in whole.columns if c != "id"))

    return matches.join(side("new_", "new_product_id"), "new_product_id").join(side("matched_", "matched_product_id"), "matched_product_id")


# Counts and quality


def count_products(products: DataFrame, category: str | None = None, is_historical: bool | None = None) -> DataFrame:
    out = products if category is None else products.filter(F.col("category") == category)
    out = out if is_historical is None else out.filter(F.col("is_historical") == is_historical)
    return out.agg(F.count("*").alias("n"))


def categories(products: DataFrame) -> DataFrame:
    return products.select("category").filter("category is not null").distinct().orderBy("category")


def duplicate_skus(products: DataFrame) -> DataFrame:
    """SKUs that several products have, case aside."""
    out = products.filter("sku is not null").groupBy(F.lower("sku").alias("sku_key")).agg(F.min("sku").alias("sku"), F.count("*").alias("n"))
    return out.filter("n > 1").select("sku", "n").orderBy(F.desc("n"), "sku")


def incomplete(products: DataFrame, features: DataFrame) -> DataFrame:
    out = feature_flag(products, features).select("id", (~F.col("has_features")).alias("missing_features"), *(F.col(c).isNull().alias(f"missing_{c}") for c in ("category", "product_name", "sku")))
    return out.filter("missing_features or missing_category or missing_product_name or missing_sku")


def quality_stats(products: DataFrame, features: DataFrame) -> DataFrame:
    """Counts, and completeness in per cent (0 for an empty catalog)."""
    n = F.count("*")
    share = lambda c: F.round(F.when(n > 0, (n - c) / n * 100).otherwise(0.0), 1)
    gone = {c: F.count_if(F.col(c).isNull()) for c in ("product_name", "sku", "category")}
    bare = F.count_if(~F.col("has_features"))
    main = feature_flag(products, features).agg(
        n.alias("total_products"), *(x.alias(f"missing_{c}") for c, x in gone.items()), bare.alias("missing_features"),
        F.count_if("is_historical").alias("historical_count"), F.count_if(~F.col("is_historical")).alias("new_count"), F.count_distinct("category").alias("categories"),
        *(share(x).alias(f"{c}_completeness") for c, x in gone.items()), share(bare).alias("features_completeness"),
    )
    return main.crossJoin(F.broadcast(duplicate_skus(products).agg(F.count("*").alias("duplicate_sku_groups"))))  # one row


def catalog_stats(products: DataFrame, features: DataFrame, matches: DataFrame) -> DataFrame:
    main = feature_flag(products, features).agg(
        F.count("*").alias("total_products"), F.count_if("is_historical").alias("historical_count"), F.count_if(~F.col("is_historical")).alias("new_count"),
        F.count_distinct("category").alias("categories"), F.count_if(~F.col("has_features")).alias("missing_features"), F.max("created_at").alias("last_created"),
    )
    return main.crossJoin(F.broadcast(matches.agg(F.count("*").alias("total_matches"))))  # one row


def category_breakdown(products: DataFrame) -> DataFrame:
    return products.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("category"))


def import_summary(raw: DataFrame, errors: int = 0) -> DataFrame:
    """Quality of imported text rows with columns filename, category, sku, name, price."""
    cell = {c: T.sanitize_field(F.col(c)) for c in ("filename", "category", "sku", "name", "price")}
    empty = F.lit(True)
    for c in cell.values():
        empty = empty & (c == "")
    rows = raw.select(empty.alias("empty"), *(x.alias(c) for c, x in cell.items()))
    again = rows.filter("sku <> '' and not empty").groupBy(F.lower("sku")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_skus"))
    main = rows.agg(
        F.count_if(~F.col("empty")).alias("imported"), F.count_if("empty").alias("empty_rows"),
        F.count_if(~F.col("empty") & (F.col("price") != "") & T.parse_price(F.col("price")).isNull()).alias("invalid_prices"),
        F.count_if(~F.col("empty") & (F.col("sku") == "") & (F.col("name") == "") & (F.col("filename") == "")).alias("missing_fields"), F.lit(errors).alias("parse_errors"),
    )
    return main.crossJoin(F.broadcast(again))  # one row


def import_warnings(rows: DataFrame) -> DataFrame:
    """(row, warning): negative prices, unreadable dates in price_history, repeated SKUs with their number. rows have `row`. SKUs
    are counted in partial sums and only repeated ones joined; rows without a SKU, a key of any size, meet no join."""
    again = rows.filter("sku <> ''").groupBy("sku").agg(F.count("*").alias("_n")).filter("_n > 1")
    entries = F.filter(F.split("price_history", ";"), lambda x: x != "")
    bad = F.exists(entries, lambda x: parse_date(F.get(F.split(x, ":"), 0)).isNull())
    found = F.array_compact(F.array(
        F.when(T.strip(F.col("price")).startswith("-"), "negative price"), F.when(bad, "invalid date in price history"),
        F.when((F.col("sku") != "") & (F.col("_n") > 1), F.concat(F.lit("duplicate SKU: "), "sku", F.lit(" x"), F.col("_n").cast("string"))),
    ))
    named = F.coalesce(F.col("sku") != "", F.lit(False))
    counted = rows.filter(named).join(again, "sku", "left").unionByName(rows.filter(~named).withColumn("_n", F.lit(None).cast("long")))
    return counted.select("row", F.explode(found).alias("warning"))


def images_by_folder(images: DataFrame) -> DataFrame:
    return images.groupBy(F.coalesce(T.folder_category(F.col("path"), 2), F.lit("Uncategorized")).alias("category")).agg(F.count("*").alias("n"))


# Results


def results_summary(status: DataFrame) -> DataFrame:
    """From match.query_status()."""
    some = F.count_if(F.col("n_matches") > 0)
    total = F.coalesce(F.sum("n_matches"), F.lit(0))
    return status.agg(F.count("*").alias("products"), some.alias("with_matches"), total.alias("total_matches"), F.round(F.when(some > 0, total / some).otherwise(0.0), 1).alias("avg_matches"))


def results_export(queries: DataFrame, matches: DataFrame, price_stats: DataFrame, performance_stats: DataFrame) -> DataFrame:
    """One row for each new product: its best match with price and sales statistics."""
    n = matches.groupBy("new_product_id").agg(F.count("*").alias("match_count"))
    best = matches.filter("rank = 1").select("new_product_id", "matched_product_id", F.col("product_name").alias("top_match"), F.round("similarity_score", 1).alias("top_score"))
    p = price_stats.select(F.col("product_id").alias("matched_product_id"), "current_price", "average_price", "min_price", "max_price", F.col("trend").alias("price_trend"))
    s = performance_stats.select(F.col("product_id").alias("matched_product_id"), "total_sales", F.col("avg_sales_per_period").alias("average_sales"), "sales_trend")
    out = queries.select(F.col("id").alias("new_product_id"), F.col("product_name").alias("name"), "category").join(n, "new_product_id", "left").join(best, "new_product_id", "left")
    out = out.join(p, "matched_product_id", "left").join(s, "matched_product_id", "left").drop("matched_product_id")
    return out.withColumns({"top_match": F.when(F.col("match_count").isNull(), "No matches").otherwise(F.coalesce("top_match", F.lit(""))), "top_score": F.coalesce("top_score", F.lit(0.0)), "match_count": F.coalesce("match_count", F.lit(0))})


def results_json(queries: DataFrame, matches: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    """Nested: a row for each product with its matches, for write.json. The matches of a query are bounded by the limit."""
    row = F.struct("rank", "matched_product_id", "similarity_score", "product_name", "sku", "category", "is_potential_duplicate")
    nested = matches.groupBy("new_product_id").agg(F.sort_array(F.collect_list(row)).alias("matches"))
    out = queries.select(F.col("id").alias("new_product_id"), "product_name", "category", "sku").join(nested, "new_product_id", "left")
    return out.withColumns({"weights": F.to_json(F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv))), "threshold": F.lit(threshold)})


def duplicate_report(matches: DataFrame, price_stats: DataFrame, performance_stats: DataFrame) -> DataFrame:
    p = price_stats.select(F.col("product_id").alias("matched_product_id"), "current_price", F.col("trend").alias("price_trend"))
    s = performance_stats.select(F.col("product_id").alias("matched_product_id"), "total_sales", "sales_trend")
    rows = matches.filter(T.is_duplicate(F.col("similarity_score"))).join(p, "matched_product_id", "left").join(s, "matched_product_id", "left")
    return rows.select("new_product_id", "matched_product_id", "similarity_score", T.duplicate_advice(F.col("similarity_score")).alias("recommendation"), "current_price", "price_trend", "total_sales", "sales_trend")


def refilter(matches: DataFrame, least: float = 0.0, category: str | None = None, hits: DataFrame | None = None, first: int = 0, duplicates_only: bool = False) -> DataFrame:
    """Matches that pass, ranked anew. category 'Uncategorized' stands for none; hits: ids of matched products."""
    out = matches.filter(F.col("similarity_score") >= least)
    if category is not None:
        out = out.filter(F.coalesce("category", F.lit("Uncategorized")) == category)
    if hits is not None:
        out = out.join(hits.select(F.col("id").alias("matched_product_id")), "matched_product_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("new_product_id").orderBy(F.desc("similarity_score"), "matched_product_id"))
    out = out.withColumn("rank", rank)
    out = out.filter(F.col("rank") <= first) if first else out
    if duplicates_only:
        keep = out.filter(T.is_duplicate(F.col("similarity_score"))).select("new_product_id").distinct()
        out = out.join(keep, "new_product_id", "left_semi")
    return out


def sort_products(queries: DataFrame, matches: DataFrame, prices: DataFrame | None = None, performance_stats: DataFrame | None = None, text: str | None = None, by: str = "score") -> DataFrame:
    """Queries with top_score, filtered by text and sorted by score, price, sales or name; without matches last."""
    out = queries.filter(_holds(["image_path", "product_name", "sku", "category"], text)) if text else queries
    best = matches.filter("rank = 1").select(F.col("new_product_id").alias("id"), "matched_product_id", F.col("similarity_score").alias("top_score"))
    out = out.join(best, "id", "left")
    if prices is not None:
        out = out.join(prices.select(F.col("product_id").alias("matched_product_id"), F.col("price").alias("top_price")), "matched_product_id", "left")
    if performance_stats is not None:
        out = out.join(performance_stats.select(F.col("product_id").alias("matched_product_id"), F.col("total_sales").alias("top_sales")), "matched_product_id", "left")
    key = {"score": "top_score", "price": "top_price", "sales": "top_sales"}.get(by)
    return out.orderBy(F.desc_nulls_last(key), "id") if key else out.orderBy("product_name", "id")


def catalog_export(products: DataFrame, features: DataFrame) -> DataFrame:
    """The columns of the catalog's CSV, newest first."""
    return newest(feature_flag(products, features)).select(
        F.col("id").alias("ID"), T.base_name(F.col("image_path")).alias("Filename"), F.coalesce("category", F.lit("")).alias("Category"), F.coalesce("product_name", F.lit("")).alias("Name"),
        F.coalesce("sku", F.lit("")).alias("SKU"), F.when(F.col("is_historical"), "Historical").otherwise("New").alias("Type"), F.col("created_at").alias("Created"),
        F.when(F.col("has_features"), "Yes").otherwise("No").alias("Has Features"),
    )
