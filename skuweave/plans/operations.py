"""Registered queries of imports, look-ups, modes of matching, snapshots and streams. What is a file is written and read."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import history as H
from ..functions import text as T
from ..functions import vectors as V
from ..operators import histories, images, knn, link, maintain, match, reports
from ..shared import new_path
from ..sources import csv, ingest, sinks, snapshots
from ..streaming.arrivals import current_matches, match_arrivals
from . import sql as S
from .catalog import Catalog
from .queries import AS_OF, COLOR, FIRST, HISTS, HYBRID, LINES, M10, SHAPE, TEXTURE, TOP, _images, _lines, _matches, _rows, query, v

NOW = datetime.datetime(2024, 6, 15, tzinfo=datetime.timezone.utc)

# Imports


@query(f"{LINES} SELECT filename, category, sku, name, price, price_error FROM l")
def csv_file_import(c: Catalog) -> DataFrame:
    """Lines in comma and semicolon files, read back from one folder."""
    path, rows = new_path(c.spark, "import"), _lines(c).drop("row")
    csv.write(rows.filter("length(filename) % 2 = 0"), f"{path}/a", ",")
    csv.write(rows.filter("length(filename) % 2 = 1"), f"{path}/b", ";")
    return csv.clean(csv.read(c.spark, f"{path}/*")).select("filename", "category", "sku", "name", "price", "price_error")


@query("SELECT p_partkey AS id, p_name || ', \"' || p_brand || '\"' AS name, p_type AS category, '' AS sku, CAST(p_size AS VARCHAR) AS price FROM part")
def csv_quoted_lines(c: Catalog) -> DataFrame:
    quoted = F.concat(F.lit('"'), "p_name", F.lit(', ""'), "p_brand", F.lit('"""'))
    line = F.concat_ws(",", F.lit("a.jpg"), "p_type", F.lit("N/A"), quoted, "p_size", F.lit(""), F.lit(""))
    cells = c.table("part").select(F.col("p_partkey").alias("id"), csv.split_line(line).alias("x"))
    return cells.select("id", F.get("x", F.lit(3)).alias("name"), F.get("x", F.lit(1)).alias("category"), F.get("x", F.lit(2)).alias("sku"), F.get("x", F.lit(4)).alias("price"))


def _batch(c: Catalog) -> DataFrame:
    """A product batch: one in eleven lacks its name, one in thirteen its SKU, one in seven has a SKU with a blank."""
    k = F.col("p_partkey")
    return c.table("part").select(
        k.alias("ref"), F.when(k % 13 == 0, " ").when(k % 7 == 0, F.concat(F.lit("bad "), k.cast("string"))).otherwise(F.concat(F.lit(" sku-"), k.cast("string"))).alias("sku"),
        F.when(k % 11 != 0, F.concat(F.lit("<b>"), "p_name", F.lit("</b> "))).alias("product_name"), F.when(k % 5 != 0, F.col("p_type")).otherwise("").alias("category"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("price"),
        F.when(k % 2 == 0, F.lit("2024-06-15:1;2024-05-01:2.5")).alias("price_history"), F.when(k % 2 == 0, F.lit("[3, -1, 5]")).otherwise(F.lit("2024-01-31:1:2:3:4")).alias("performance_history"),
    )


GOOD = "k % 13 <> 0 AND k % 7 <> 0 AND k % 11 <> 0"
BATCH = "WITH b AS (SELECT p_partkey AS k, * FROM part)"


@query(f"{BATCH} SELECT k AS ref, '[METADATA_ONLY]' AS image_path, CASE WHEN k % 5 <> 0 THEN p_type END AS category, p_name AS product_name, 'SKU-' || k AS sku, false AS is_historical FROM b WHERE {GOOD}")
def metadata_batch_products(c: Catalog) -> DataFrame:
    return ingest.metadata_batch(_batch(c), F.lit(AS_OF), False, reject_all=False)["products"]


@query(f"{BATCH} SELECT k AS ref, CASE WHEN k % 13 = 0 THEN 'sku is required' WHEN k % 11 = 0 THEN 'product_name is required' ELSE 'invalid sku' END AS error FROM b WHERE NOT ({GOOD})")
def metadata_batch_quarantine(c: Catalog) -> DataFrame:
    """One bad row rejects the batch, so only the quarantine has rows."""
    got = ingest.metadata_batch(_batch(c), F.lit(AS_OF), False)
    return got["quarantine"].select("ref", "error").unionByName(got["products"].select("ref", F.lit("kept").alias("error")))


@query(f"""{BATCH} SELECT k AS ref, DATE '2024-06-15' AS date, p_retailprice AS price, 'USD' AS currency FROM b WHERE {GOOD} AND k % 3 <> 0
UNION ALL SELECT k, DATE '2024-06-15', 1.0, 'USD' FROM b WHERE {GOOD} AND k % 3 = 0 AND k % 2 = 0 UNION ALL SELECT k, DATE '2024-05-01', 2.5, 'USD' FROM b WHERE {GOOD} AND k % 2 = 0""", dated=True)
def metadata_batch_prices(c: Catalog) -> DataFrame:
    return ingest.metadata_batch(_batch(c), F.lit(AS_OF), False, reject_all=False)["price_history"]


@query(f"""{BATCH} SELECT k AS ref, DATE '2024-06-15' - INTERVAL 60 DAY AS date, 3 AS sales, 0 AS views, CAST(0 AS DOUBLE) AS conversion_rate, CAST(0 AS DOUBLE) AS revenue FROM b WHERE {GOOD} AND k % 2 = 0
UNION ALL SELECT k, DATE '2024-06-15', 5, 0, 0, 0 FROM b WHERE {GOOD} AND k % 2 = 0 UNION ALL SELECT k, DATE '2024-01-31', 1, 2, 3, 4 FROM b WHERE {GOOD} AND k % 2 = 1""", dated=True)
def metadata_batch_sales(c: Catalog) -> DataFrame:
    return ingest.metadata_batch(_batch(c), F.lit(AS_OF), False, reject_all=False)["performance_history"]


@query("""SELECT 'main/' || p_type || '/' || p_partkey || '.jpg' AS image_path, CASE WHEN p_partkey % 4 = 0 THEN 'misc' ELSE p_type END AS category, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS product_name,
CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'P-' || p_partkey END AS sku, NULL AS error FROM part WHERE p_partkey % 6 <> 0
UNION ALL SELECT 'main/' || p_type || '/' || p_partkey || '.jpg', NULL, NULL, NULL, 'CORRUPTED_IMAGE' FROM part WHERE p_partkey % 6 = 0""")
def image_batch_ingest(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat_ws("/", F.lit("main"), "p_type", F.concat(k.cast("string"), F.lit(".jpg")))
    manifest = c.table("part").select(path.alias("path"), F.when(k % 4 == 0, " ").otherwise(F.col("p_type")).alias("category"), F.when(k % 3 == 0, "<i></i>").otherwise(F.col("p_name")).alias("product_name"),
                                      F.when(k % 5 == 0, "no sku!").otherwise(F.concat(F.lit("p-"), k.cast("string"))).alias("sku"))
    audit = c.table("part").select(path.alias("path"), F.when(k % 6 == 0, "CORRUPTED_IMAGE").alias("error_code"))
    good, bad = ingest.image_batch(manifest, audit, True, category="misc")
    return good.drop("is_historical").withColumn("error", F.lit(None).cast("string")).unionByName(bad.select(F.col("path").alias("image_path"), "error"), allowMissingColumns=True)


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM orders UNION ALL SELECT o_orderkey, DATE '2024-06-15', 7.5 FROM orders", dated=True)
def pasted_price_lines(c: Catalog) -> DataFrame:
    """A dated line, an unreadable one, and a price alone, dated by its line."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\t"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\r\n\nnever;5\n7.5"))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), F.inline(H.pasted_prices(text, F.lit(AS_OF))))


@query("SELECT o_orderkey AS id, unnest([o_custkey, 12]) AS sales FROM orders")
def pasted_sales_lines(c: Catalog) -> DataFrame:
    text = F.concat(F.col("o_custkey").cast("string"), F.lit("\n-4\nmany\r\n12.9"))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), F.explode(H.pasted_sales(text)).alias("sales"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM orders")
def strict_price_pairs(c: Catalog) -> DataFrame:
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(":"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(";:4;2024-01-01:0;2024-01-02"))
    pairs = c.table("orders").select(F.col("o_orderkey").alias("id"), F.inline(F.filter(H.price_pairs(text), lambda r: r["price"].isNotNull())))
    return pairs.withColumnRenamed("date", "day")


@query("SELECT o_orderkey AS id, CAST(DATE '2024-06-15' - INTERVAL 30 DAY AS DATE) AS date, o_custkey AS sales FROM orders UNION ALL SELECT o_orderkey, DATE '2024-06-15', 8 FROM orders", dated=True)
def sales_array_30_days(c: Catalog) -> DataFrame:
    values = F.array(F.lit(-1.0), F.col("o_custkey").cast("double"), F.lit(8.9))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), F.inline(H.every_30_days(values, F.lit(AS_OF))))


@query(v("SELECT product_id, date, price, 'USD' AS currency FROM price_history WHERE product_id % 4 <> 0 AND product_id % 5 <> 0"), dated=True)
def price_rows_to_append(c: Catalog) -> DataFrame:
    rows = c.price_history.select("product_id", F.when(F.col("product_id") % 4 != 0, F.col("date")).alias("date"), F.when(F.col("product_id") % 5 != 0, F.col("price")).alias("price"), F.lit(None).cast("string").alias("currency"))
    return maintain.price_rows(rows)


@query(v("SELECT product_id, date, CASE WHEN product_id % 2 = 0 THEN sales ELSE 0 END AS sales, views, conversion_rate, CASE WHEN product_id % 3 = 0 THEN 0 ELSE revenue END AS revenue FROM performance_history WHERE product_id % 4 <> 0"), dated=True)
def performance_rows_to_append(c: Catalog) -> DataFrame:
    k = F.col("product_id")
    rows = c.performance_history.withColumns({"date": F.when(k % 4 != 0, F.col("date")), "sales": F.when(k % 2 == 0, F.col("sales")), "revenue": F.when(k % 3 != 0, F.col("revenue"))})
    return maintain.performance_rows(rows)


# Rules


@query("""SELECT p_partkey AS id, p_partkey % 4 <> 1 AND p_partkey % 4 <> 3 AS category_valid, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN NULL ELSE repeat('x', 201) END AS name, p_partkey % 3 <> 2 AS name_valid, p_name || ' DROP' AS search FROM part""")
def text_rules(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    category = F.when(k % 4 == 0, F.concat("p_type", F.lit(" été-2"))).when(k % 4 == 1, "a/b").when(k % 4 == 2, "").otherwise("x" * 101)
    name = T.sanitize_name(F.when(k % 3 == 0, F.concat(F.lit("<b>"), "p_name", F.lit("</b>"))).when(k % 3 == 1, "<br>").otherwise("x" * 201))
    return c.table("part").select(k.alias("id"), T.valid_category(category).alias("category_valid"), name.alias("name"), T.valid_name(name).alias("name_valid"), T.sanitize_search(F.concat(F.lit(" '"), "p_name", F.lit('"; DROP\\'))).alias("search"))


@query(v("SELECT new_product_id, matched_product_id, CASE WHEN similarity_score >= 70 THEN 'high' WHEN similarity_score >= 50 THEN 'medium' ELSE 'low' END AS class, CASE trend WHEN 'up' THEN '↑' WHEN 'down' THEN '↓' ELSE '→' END AS arrow FROM m LEFT JOIN price_trend p ON p.product_id = m.matched_product_id", S.METADATA, M10, """,
pt AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM price_history),
price_trend AS (SELECT product_id, CASE WHEN max(price) FILTER (r = 1) > max(price) FILTER (r = 2) * 1.05 THEN 'up' WHEN max(price) FILTER (r = 1) < max(price) FILTER (r = 2) * 0.95 THEN 'down' ELSE 'stable' END AS trend FROM pt GROUP BY 1)"""))
def score_classes_and_arrows(c: Catalog) -> DataFrame:
    trends = histories.price_statistics(c.price_history).select(F.col("product_id").alias("matched_product_id"), "trend")
    rows = _matches(c).join(trends, "matched_product_id", "left")
    return rows.select("new_product_id", "matched_product_id", T.score_class(F.col("similarity_score")).alias("class"), T.trend_arrow(F.col("trend")).alias("arrow"))


@query("""SELECT vec_id AS product_id, CASE WHEN vec_id % 4 = 0 THEN 'MISSING_FEATURES' WHEN vec_id % 4 = 1 THEN 'FEATURE_DIMENSION_MISMATCH' END AS error_code,
CASE WHEN vec_id % 4 = 0 THEN 'Extract features for this product first.' WHEN vec_id % 4 = 1 THEN 'Extract features again with one encoder.' END AS suggestion FROM embeddings""")
def error_suggestions(c: Catalog) -> DataFrame:
    k = F.col("product_id") % 4
    vector = F.when(k == 0, None).when(k == 1, F.slice("embedding", 1, 5)).otherwise(F.col("embedding"))
    rows = c.features.select("product_id", V.feature_error(vector, 64).alias("error_code"))
    return rows.join(images.suggestions(c.spark), "error_code", "left").select("product_id", "error_code", "suggestion")


# Look-ups


@query(v("SELECT id, sku FROM products WHERE id % 7 = 0"))
def products_by_ids(c: Catalog) -> DataFrame:
    asked = c.table("part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"))
    return reports.by_ids(c.products, asked).select("id", "sku")


@query(v("SELECT id, sku FROM products WHERE NOT is_historical"))
def new_products(c: Catalog) -> DataFrame:
    return reports.all_products(c.products, is_historical=False).select("id", "sku")


@query(v("SELECT 'category' AS gone, id FROM products WHERE category IS NULL UNION ALL SELECT 'sku', id FROM products WHERE sku IS NULL"))
def products_without(c: Catalog) -> DataFrame:
    part = lambda column: reports.without(c.products, column).select(F.lit(column).alias("gone"), "id")
    return part("category").unionByName(part("sku"))


@query(v("SELECT id, sku FROM products WHERE lower(sku) = 'brand-17-1' OR sku = 'BRAND-4-2'"))
def products_by_sku(c: Catalog) -> DataFrame:
    found = reports.by_sku(c.products, "brand-17-1").unionByName(reports.by_sku(c.products, "BRAND-4-2", case_sensitive=True)).unionByName(reports.by_sku(c.products, "brand-4-2", case_sensitive=True))
    return found.select("id", "sku")


@query(v("SELECT o_orderkey AS id, EXISTS (SELECT 1 FROM products p WHERE p.id = o_orderkey) AS \"exists\" FROM orders"))
def existing_ids(c: Catalog) -> DataFrame:
    return reports.existing_ids(c.table("orders").select(F.col("o_orderkey").alias("id")), c.products)


@query(v("SELECT (SELECT count(*) FROM products) AS every, (SELECT count(*) FROM products WHERE category = 'ECONOMY' AND is_historical) AS some"))
def product_counts(c: Catalog) -> DataFrame:
    some = reports.count_products(c.products, "ECONOMY", True).withColumnRenamed("n", "some")
    return reports.count_products(c.products).withColumnRenamed("n", "every").crossJoin(F.broadcast(some))  # one row each


@query("SELECT CASE WHEN p_partkey % 4 < 2 THEN p_type ELSE 'Uncategorized' END AS category, count(*) AS n FROM part GROUP BY 1")
def images_per_folder(c: Catalog) -> DataFrame:
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat("p_type", F.lit("/a.jpg"))).when(k == 1, F.concat("p_type", F.lit("/images/a.jpg"))).otherwise("a.jpg")
    return reports.images_by_folder(c.table("part").select(path.alias("path")))


@query(v("SELECT new_product_id, matched_product_id, CAST(rank AS INTEGER) AS rank, p.sku FROM m JOIN products p ON p.id = matched_product_id WHERE rank <= 3", S.METADATA, M10))
def matches_of_products(c: Catalog) -> DataFrame:
    found = _matches(c).select("new_product_id", "matched_product_id", "similarity_score")
    return reports.matches_for_product(found, c.products, limit=3).select("new_product_id", "matched_product_id", "rank", "sku")


@query(v("SELECT p.id, round(m.similarity_score, 6) AS top_score, lp.price AS top_price FROM products p LEFT JOIN m ON m.new_product_id = p.id AND m.rank = 1 LEFT JOIN latest_price lp ON lp.product_id = m.matched_product_id WHERE NOT p.is_historical AND contains(lower(p.product_name), 'r')", S.METADATA, M10))
def sorted_products(c: Catalog) -> DataFrame:
    got = reports.sort_products(c.new, _matches(c), histories.latest_prices(c.price_history), text="r", by="price")
    return got.filter("contains(lower(product_name), 'r')").select("id", F.round("top_score", 6).alias("top_score"), "top_price")


# Matching


@query(v("SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY similarity_score DESC, c_id) AS INTEGER) AS rank, round(similarity_score, 6) AS similarity_score FROM metadata_all WHERE similarity_score >= 60 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY similarity_score DESC, c_id) <= 10", S.METADATA))
def metadata_match_threshold(c: Catalog) -> DataFrame:
    found = match.metadata_matches(c.with_latest(c.new), c.with_latest(c.historical), MatchConfig(threshold=60, limit=10))
    return found.select("new_product_id", "matched_product_id", "rank", F.round("similarity_score", 6).alias("similarity_score"))


@query(v("SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(rank AS INTEGER) AS rank, round(similarity_score, 6) AS similarity_score FROM metadata_ranked WHERE rank <= 10", S.METADATA))
def metadata_match_pruned(c: Catalog) -> DataFrame:
    """The best ten with bounds before pairs, whatever the number of distinct names."""
    found = match.metadata_matches(c.with_latest(c.new), c.with_latest(c.historical), MatchConfig(limit=10, distinct_names=True))
    return found.select("new_product_id", "matched_product_id", "rank", F.round("similarity_score", 6).alias("similarity_score"))


RECORDS = """, r AS (SELECT * FROM metadata_ranked WHERE rank <= 10)
SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(rank AS INTEGER) AS rank, round(sku_score, 6) AS sku_score, round(name_score, 6) AS name_score, round(category_score, 6) AS category_score, round(price_score, 6) AS price_score, round(performance_score, 6) AS performance_score,
CAST(0 AS DOUBLE) AS color_score, '[METADATA_ONLY]' AS image_path, c_category AS category, c_name AS product_name, c_sku AS sku, similarity_score > 90 AS is_potential_duplicate, coalesce(c_category, '') = '' AS is_uncategorized,
CASE WHEN coalesce(c_sku, '') = '' THEN 'sku' ELSE '' END AS missing_fields, coalesce(c_sku, '') = '' AS has_missing_metadata, coalesce(c_sku, '') = '' OR coalesce(c_category, '') = '' OR coalesce(c_price, 0) = 0 OR c_sales IS NULL AS has_missing_data, 'metadata' AS mode FROM r"""


@query(v(RECORDS.split("\n", 1)[1], S.METADATA, RECORDS.split("\n", 1)[0]))
def match_records(c: Catalog) -> DataFrame:
    scores = ["sku_score", "name_score", "category_score", "price_score", "performance_score"]
    return _matches(c).select("new_product_id", "matched_product_id", "rank", *(F.round(x, 6).alias(x) for x in scores), "color_score", "image_path", "category", "product_name", "sku", "is_potential_duplicate", "is_uncategorized",
                              F.array_join("missing_fields", ",").alias("missing_fields"), "has_missing_metadata", "has_missing_data", "mode")


@query(v("SELECT q_id, c_id, round((cosine + 1) / 2 * 100, 6) AS score FROM (SELECT q_id, c_id, cosine, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, c_id) AS rank FROM visual_all) WHERE rank <= 10", S.VECTORS))
def visual_index_scores(c: Catalog) -> DataFrame:
    return knn.catalog_knn(c.with_features(c.new), c.with_features(c.historical), TOP).select("q_id", "c_id", F.round("score", 6).alias("score"))


LEGACY = f"""{HISTS}, legacy AS (SELECT q_id, c_id, qv, cv, (0.5 * {COLOR} + 0.3 * {SHAPE} + 0.2 * {TEXTURE}) * (SELECT CASE WHEN coalesce(category, '') = '' THEN 0.9 ELSE 1.0 END FROM products WHERE id = c_id) AS score FROM hists)"""


@query(v("SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS similarity_score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, c_id) AS rank FROM legacy WHERE score >= 30) WHERE rank <= 10", S.VECTORS, LEGACY))
def descriptor_match_topk(c: Catalog) -> DataFrame:
    """The visual mode over colour, shape and texture."""
    found = match.visual_matches(c.with_features(c.new), c.with_features(c.historical), TOP, embeddings=False)
    return found.select("new_product_id", "matched_product_id", "rank", F.round("similarity_score", 6).alias("similarity_score"))


def _sides(c: Catalog) -> list[DataFrame]:
    return [c.with_latest(p).join(c.described.withColumnRenamed("product_id", "id"), "id", "left") for p in (c.new, c.historical)]


MODES = """SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS similarity_score, 'hybrid' AS mode
FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, c_id) AS rank FROM hybrid WHERE s >= 30 AND q_id IN (SELECT product_id FROM features)) WHERE rank <= 10"""


#: Both ranked tables are used twice; with these words they are computed once.
ONCE = [x.replace("metadata_ranked AS (", "metadata_ranked AS MATERIALIZED (").replace("hybrid AS (", "hybrid AS MATERIALIZED (").replace("visual_all AS (", "visual_all AS MATERIALIZED (") for x in (S.METADATA, S.VECTORS, HYBRID)]


@query(v(f"""{MODES.replace("q_id IN (SELECT product_id FROM features)", "EXISTS (SELECT 1 FROM features f WHERE f.product_id = q_id)")}
UNION ALL SELECT q_id, c_id, CAST(rank AS INTEGER), round(similarity_score, 6), 'metadata' FROM metadata_ranked WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM features f WHERE f.product_id = q_id)""", *ONCE))
def match_by_features(c: Catalog) -> DataFrame:
    """Products with vectors are matched by hybrid, the others by metadata."""
    found, _, _ = match.match(*_sides(c), TOP)
    return found.select("new_product_id", "matched_product_id", "rank", F.round("similarity_score", 6).alias("similarity_score"), "mode")


@query(v("""SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS similarity_score, NULL AS error_code
FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, c_id) AS rank FROM hybrid WHERE q_id IN (SELECT product_id FROM features)) WHERE rank <= 10
UNION ALL SELECT id, 0, 0, 0, 'VISUAL_FAILED' FROM products WHERE NOT is_historical AND id NOT IN (SELECT product_id FROM features)""", S.METADATA, S.VECTORS, HYBRID))
def hybrid_batch(c: Catalog) -> DataFrame:
    """The batch form: no floor for the hybrid score, and a row for each product of which an arm fails."""
    found, _, failed = match.hybrid_batch(*_sides(c), TOP)
    rows = found.select("new_product_id", "matched_product_id", "rank", F.round("similarity_score", 6).alias("similarity_score"), F.lit(None).cast("string").alias("error_code"))
    return rows.unionByName(failed.select("new_product_id", F.lit(0).alias("matched_product_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("similarity_score"), "error_code"))


BROKEN = "CASE WHEN c.id % 7 = 0 THEN 'gone' WHEN c.id % 7 = 1 THEN 'damaged' WHEN c.id % 7 = 2 THEN 'short' END"


@query(v(f"""SELECT q_id AS new_product_id, CAST(count(*) AS BIGINT) AS total_candidates, count(*) FILTER (kind = 'gone') AS missing_features, count(*) FILTER (kind = 'damaged') AS corrupted_features, count(*) FILTER (kind = 'short') AS computation_errors,
count(*) FILTER (sku IS NULL) AS missing_metadata, 0 AS invalid_categories, count(*) FILTER (kind IS NOT NULL) AS failed, count(*) FILTER (kind IS NULL) AS successful, count(*) FILTER (kind IS NOT NULL) + count(*) FILTER (sku IS NULL) AS total_issues,
round(count(*) FILTER (kind IS NULL) / count(*) * 100, 1) AS success_rate FROM (SELECT q.id AS q_id, c.sku, {BROKEN} AS kind FROM products q JOIN features f ON f.product_id = q.id, products c JOIN features g ON g.product_id = c.id
WHERE NOT q.is_historical AND c.is_historical AND (q.category IS NULL OR c.category IS NULL OR lower(trim(q.category)) = lower(trim(c.category)))) GROUP BY 1"""))
def visual_run_counters(c: Catalog) -> DataFrame:
    """Counters of the visual mode, with three in seven catalog vectors made unusable."""
    k, e = F.col("id") % 7, F.col("embedding").cast("array<double>")
    broken = F.when(k == 0, None).when(k == 1, F.transform(e, lambda x, i: F.when(i == 0, float("nan")).otherwise(x))).when(k == 2, F.slice(e, 1, 5)).otherwise(e)
    return match.quality_counters(c.with_features(c.new), c.with_features(c.historical).withColumn("embedding", broken))


@query(v("SELECT run_id, mode, count(*) AS n, count(DISTINCT new_product_id) AS products FROM m, (SELECT 'metadata' AS mode), (SELECT unnest(['run-1', 'run-2']) AS run_id) GROUP BY 1, 2", S.METADATA, M10))
def matches_written_by_run(c: Catalog) -> DataFrame:
    """Two runs, the first written twice."""
    path, found = new_path(c.spark, "matches"), _matches(c)
    for run in ("run-1", "run-2", "run-1"):
        sinks.matches(found, path, run)
    return c.spark.read.parquet(path).groupBy("run_id", "mode").agg(F.count("*").alias("n"), F.count_distinct("new_product_id").alias("products"))


@query(v("SELECT p.id AS new_product_id, p.sku, count(m.rank) AS n, max(m.matched_product_id) FILTER (m.rank = 1) AS best, 30.0 AS threshold FROM products p LEFT JOIN m ON m.new_product_id = p.id WHERE NOT p.is_historical GROUP BY 1, 2", S.METADATA, M10))
def results_as_json(c: Catalog) -> DataFrame:
    path = new_path(c.spark, "json")
    sinks.json(reports.results_json(c.new, _matches(c), {"visual": 0.5, "metadata": 0.5}, 30.0), path)
    n = F.coalesce(F.size("matches"), F.lit(0))
    return c.spark.read.json(path).select("new_product_id", "sku", F.when(n > 0, n).otherwise(0).cast("long").alias("n"), F.get("matches", F.lit(0))["matched_product_id"].alias("best"), "threshold")


@query(f"{FIRST} SELECT i.path, l.sku, l.name, l.row IS NOT NULL AS linked FROM images i LEFT JOIN l ON l.row = CAST(i.path AS BIGINT) + 1 AND CAST(i.path AS BIGINT) % 2 = 0")
def manual_links(c: Catalog) -> DataFrame:
    """Every second image gets the row after its own."""
    mapping = c.table("part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") + 1).alias("row"))
    linked = link.manual(_images(c, "sku"), _rows(c), mapping)
    return linked.select("path", F.when(F.col("linked"), F.coalesce("sku", F.lit(""))).alias("sku"), "name", "linked")


@query(v("SELECT new_product_id, count(*) AS n, 'metadata' AS mode FROM m GROUP BY 1", S.METADATA, M10))
def streamed_matches(c: Catalog) -> DataFrame:
    """New products that arrive as files, matched in micro-batches."""
    path = new_path(c.spark, "stream")
    c.with_latest(c.new).repartition(3).write.parquet(f"{path}/in")
    stream = c.spark.readStream.schema(c.spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    match_arrivals(stream, lambda: c.with_latest(c.historical), f"{path}/out", f"{path}/state", TOP).awaitTermination()
    return c.spark.read.parquet(f"{path}/out").groupBy("new_product_id").agg(F.count("*").alias("n"), F.max("mode").alias("mode"))


@query(v("SELECT new_product_id, matched_product_id, CAST(rank AS INTEGER) AS rank FROM m", S.METADATA, M10))
def streamed_again(c: Catalog) -> DataFrame:
    """Products that arrive under other names first and as they are in a later batch, which replaces their matches."""
    path, rows = new_path(c.spark, "stream"), c.with_latest(c.new)
    rows.withColumn("product_name", F.lit("another name")).coalesce(1).write.parquet(f"{path}/in")
    schema = c.spark.read.parquet(f"{path}/in").schema
    for later in (False, True):
        stream = c.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        match_arrivals(stream, lambda: c.with_latest(c.historical), f"{path}/out", f"{path}/state", TOP).awaitTermination()
        if not later:
            rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return current_matches(c.spark, f"{path}/out").select("new_product_id", "matched_product_id", "rank")


@query("SELECT p_partkey || '.jpg' AS filename, p_type AS category, p_name || chr(10) || ' \"' || p_brand || '\"' || chr(10) AS name FROM part")
def csv_line_breaks(c: Catalog) -> DataFrame:
    """Cells with line breaks and quotes, in files that are read by ranges."""
    path, k = new_path(c.spark, "import"), F.col("p_partkey").cast("string")
    name = F.concat("p_name", F.lit('\n "'), "p_brand", F.lit('"\n'))
    rows = c.table("part").select(F.concat(k, F.lit(".jpg")).alias("filename"), F.col("p_type").alias("category"), F.lit("").alias("sku"), name.alias("name"))
    rows.repartition(3).write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return csv.read(c.spark, path, multi_line=True).select("filename", "category", "name")


# Vectors of images


def _encoder():
    """Stands for a trained encoder: the mean of each quarter of the bytes."""
    return lambda contents: np.stack([np.frombuffer(bytes(x), np.uint8).reshape(4, -1).mean(1) for x in contents]).astype(np.float32)


def _pixels(c: Catalog) -> DataFrame:
    """8 x 8 grey pixels of each vector's absolute values."""
    byte = lambda x: F.lpad(F.hex(F.floor(F.least(F.abs(x), F.lit(0.996)) * 256).cast("long")), 2, "0")
    return c.features.select("product_id", F.unhex(F.array_join(F.transform(F.col("embedding").cast("array<double>"), byte), "")).alias("content"))


BYTES = "list_transform(embedding, lambda x: floor(least(abs(CAST(x AS DOUBLE)), 0.996) * 256))"


@query(f"""WITH b AS (SELECT vec_id, {BYTES} AS p FROM embeddings WHERE vec_id % 3 <> 0), q AS (SELECT vec_id, list_transform([0, 1, 2, 3], lambda k: list_avg(p[CAST(k * 16 + 1 AS BIGINT):CAST(k * 16 + 16 AS BIGINT)])) AS m FROM b)
SELECT vec_id AS product_id, CASE WHEN vec_id % 5 <> 0 THEN round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 4) END AS first, CASE WHEN vec_id % 5 = 0 THEN 'MISSING_OR_EMPTY' END AS error_code FROM q""")
def embedded_images(c: Catalog) -> DataFrame:
    """Images whose product has no legacy features, through a supplied encoder; one in five has no content."""
    todo = _pixels(c).withColumn("content", F.when(F.col("product_id") % 5 != 0, F.col("content")))
    got = images.embed(todo, _encoder, done=c.features.filter("embedding_type = 'legacy'"))
    return got.select("product_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"), "error_code")


@query(f"""WITH b AS (SELECT vec_id, {BYTES} AS p FROM embeddings) SELECT vec_id AS product_id, unnest([0, 1, 2, 3]) AS bin, unnest(list_transform([0, 1, 2, 3], lambda k: round(len(list_filter(p, lambda x: floor(x / 64) = k)) / 64, 6))) AS share FROM b""")
def grey_histograms(c: Catalog) -> DataFrame:
    """The value bins of grey images: hue and saturation are 0."""
    image = F.struct(F.col("product_id").cast("string").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.col("content").alias("data"))
    got = images.describe(_pixels(c).select(image.alias("image")))
    got = got.select(F.col("path").cast("long").alias("product_id"), F.posexplode(F.slice("color", 1, 4)).alias("bin", "x"))
    return got.select("product_id", "bin", F.round(F.col("x").cast("double"), 6).alias("share"))


# Maintenance and snapshots


@query(v("SELECT 'use_existing' AS mode, count(*) AS n, max(id) AS last FROM products UNION ALL SELECT 'add_to_existing', count(*) + count(*) FILTER (NOT is_historical), max(id) + count(*) FILTER (NOT is_historical) FROM products UNION ALL SELECT 'replace', 2 * count(*) FILTER (NOT is_historical), max(id) FILTER (NOT is_historical) + count(*) FILTER (NOT is_historical) FROM products UNION ALL SELECT 'saved', count(*), max(id) FROM products WHERE is_historical"))
def load_modes(c: Catalog) -> DataFrame:
    """New products loaded as historical ones; a replacement saves what goes."""
    store = snapshots.Snapshots(c.spark, new_path(c.spark, "snapshots"))
    save = lambda: store.save_before({"products": c.products}, True, NOW)
    out = None
    for mode in ("use_existing", "add_to_existing", "replace"):
        part = maintain.load(c.products, c.new, mode, order=("created_at", "product_name"), save=save).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.max("id").alias("last"))
        out = part if out is None else out.unionByName(part)
    saved = store.load(f"auto_{NOW:%Y%m%d_%H%M%S}")["products"]
    return out.unionByName(saved.agg(F.lit("saved").alias("mode"), F.count("*").alias("n"), F.max("id").alias("last")))


@query(v("SELECT (SELECT count(*) FROM price_history h JOIN products p ON p.id = h.product_id WHERE p.is_historical) AS prices, 0 AS cleared, (SELECT count(*) FROM m WHERE matched_product_id % 2 = 1) AS matches", S.METADATA, M10))
def clear_histories_and_matches(c: Catalog) -> DataFrame:
    """Prices of new products go, all sales, and the matches with products of even ids."""
    prices = maintain.without_rows(c.price_history, c.new, "product_id").agg(F.count("*").alias("prices"))
    sales = maintain.cleared(c.performance_history).agg(F.count("*").alias("cleared"))
    left = maintain.without_rows(_matches(c), c.products.filter("id % 2 = 0"), "matched_product_id").agg(F.count("*").alias("matches"))
    return prices.crossJoin(sales).crossJoin(left)  # one row each


@query(v("SELECT id, CASE WHEN id % 6 = 0 THEN 'Outlet' ELSE category END AS category, CASE WHEN id % 6 = 0 THEN NULL ELSE sku END AS sku FROM products"))
def bulk_edit_columns(c: Catalog) -> DataFrame:
    return maintain.bulk_set(c.products, c.products.filter("id % 6 = 0"), category="Outlet", sku="").select("id", "category", "sku")


@query(v("SELECT 'listed' AS what, CASE WHEN h THEN 'old' ELSE 'new' END AS snapshot, CAST(0 AS BIGINT) AS n FROM (SELECT unnest([true, false]) AS h) UNION ALL SELECT 'active', CASE WHEN is_historical THEN 'old' ELSE 'new' END, count(*) FROM products GROUP BY 2 UNION ALL SELECT 'listed', 'both', 0 UNION ALL SELECT 'active', 'both', count(*) FROM products"))
def snapshots_active(c: Catalog) -> DataFrame:
    """Two snapshots and their merger, listed and made active."""
    store = snapshots.Snapshots(c.spark, new_path(c.spark, "snapshots"))
    whole = {"products": c.products, "features": c.features, "price_history": c.price_history}
    store.create("old", whole, True, NOW)
    store.create("new", whole, False, NOW)
    store.merge(["old", "new"], "both", True, NOW)
    store.set_active(["old", "both"], ["new"], NOW)
    listed = store.list().select(F.lit("listed").alias("what"), F.col("name").alias("snapshot"), F.lit(0).cast("long").alias("n"))
    active = store.active_union("historical").select("snapshot").unionByName(store.active_union("new").select("snapshot"))
    return listed.unionByName(active.groupBy(F.lit("active").alias("what"), "snapshot").agg(F.count("*").alias("n")))


@query(v("SELECT 'main' AS what, is_historical, count(*) AS n FROM products WHERE NOT is_historical OR id % 2 = 0 GROUP BY 2 UNION ALL SELECT 'backup', true, count(*) FROM products WHERE is_historical"))
def snapshot_as_main(c: Catalog) -> DataFrame:
    """A snapshot of half the historical products takes the place of that side, which is saved first."""
    store = snapshots.Snapshots(c.spark, new_path(c.spark, "snapshots"))
    whole = {"products": c.products, "features": c.features}
    store.create("half", {"products": c.products.filter("id % 2 = 0"), "features": c.features}, True, NOW)
    main = store.load_as_main("half", whole, NOW)["products"].groupBy(F.lit("main").alias("what"), "is_historical").agg(F.count("*").alias("n"))
    backup = store.load(f"backup_{NOW:%Y%m%d_%H%M%S}")["products"]
    return main.unionByName(backup.agg(F.lit("backup").alias("what"), F.lit(True).alias("is_historical"), F.count("*").alias("n")))
