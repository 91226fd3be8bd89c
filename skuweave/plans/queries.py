"""The registered queries of the catalog engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import history as H
from ..functions import text as T
from ..functions import vectors as V
from ..operators import histories, history_state, knn, link, maintain, match, pages, reports, search_index, vector_index
from ..shared import new_path
from ..sources import csv, ingest, snapshots
from . import sql as S
from .catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL = MatchConfig(limit=0, min_threshold=0)
TOP = MatchConfig(limit=10)
AS_OF = datetime.date(2024, 6, 15)


def query(sql: str | None = None, dated: bool = False):
    """Registers a query. dated: its column date is given as text, which all engines compare alike."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Catalog(spark, sf_dir))
            return out.withColumn("date", F.col("date").cast("string")) if dated else out

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE (CAST(CAST(date AS DATE) AS VARCHAR) AS date) FROM ({sql}) AS r" if dated else sql
        return f

    return register


def v(select: str, *more: str) -> str:
    return S.with_views(select, *more)


# Matching


@query(v("SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(rank AS INTEGER) AS rank, round(similarity_score, 6) AS similarity_score FROM metadata_ranked WHERE rank <= 10", S.METADATA))
def metadata_match_topk(c: Catalog) -> DataFrame:
    found = match.metadata_matches(c.with_latest(c.new), c.with_latest(c.historical), TOP)
    return found.select("new_product_id", "matched_product_id", "rank", F.round("similarity_score", 6).alias("similarity_score"))


@query(v("SELECT q_id, c_id, round(sku_score, 6) AS sku_score, round(name_score, 6) AS name_score, round(category_score, 6) AS category_score, round(price_score, 6) AS price_score, round(performance_score, 6) AS performance_score, round(similarity_score, 6) AS similarity_score FROM metadata_all", S.METADATA))
def metadata_scores_all_pairs(c: Catalog) -> DataFrame:
    return match.metadata_every(match.prepared(c.with_latest(c.new)), match.prepared(c.with_latest(c.historical)), ALL, 6)


def _two(c: Catalog, column: str) -> DataFrame:
    """The distinct values of a column of new and of historical products, paired within the categories that match."""
    return match.value_pairs(c.new.select("id", "category", column), c.historical.select("id", "category", column), column, ALL)


@query(v(f"SELECT a, b, round({S.name_score('a', 'b')}, 6) AS score FROM (SELECT DISTINCT q_name AS a, c_name AS b FROM pairs)"))
def name_similarity(c: Catalog) -> DataFrame:
    return _two(c, "product_name").withColumn("score", F.round(T.name_similarity(F.col("a"), F.col("b")), 6))


@query(v(f"SELECT a, b, round({S.sku_score('a', 'b')}, 6) AS score FROM (SELECT DISTINCT q_sku AS a, c_sku AS b FROM pairs)"))
def sku_similarity(c: Catalog) -> DataFrame:
    return _two(c, "sku").withColumn("score", F.round(T.sku_similarity(F.col("a"), F.col("b")), 6))


MESSY = "CASE p_partkey % 9 WHEN 0 THEN '  ' || p_type || ' ' WHEN 1 THEN lower(p_type) WHEN 2 THEN 'unknown' WHEN 3 THEN '' WHEN 4 THEN 'N/A' WHEN 5 THEN p_type || 's' WHEN 6 THEN substr(p_type, 2) ELSE p_type END"


def _messy(c: Catalog) -> DataFrame:
    """Categories as people type them."""
    return c.table("part").select(F.col("p_partkey").alias("id"), F.expr(MESSY).alias("raw"), F.col("p_type").alias("category"))


@query(f"WITH m AS (SELECT p_partkey AS id, {MESSY} AS raw FROM part) SELECT id, raw, {S.category('raw')} AS category FROM m")
def category_normalize(c: Catalog) -> DataFrame:
    return _messy(c).select("id", "raw", T.normalize_category(F.col("raw")).alias("category"))


@query(f"WITH m AS (SELECT p_partkey AS id, {MESSY} AS raw, p_type FROM part) SELECT id, round({S.category_score('raw', 'p_type')}, 6) AS score FROM m")
def category_similarity(c: Catalog) -> DataFrame:
    return _messy(c).select("id", F.round(T.category_similarity(F.col("raw"), F.col("category")), 6).alias("score"))


COMPACT = "replace(replace(lower(trim({})), ' ', ''), '-', '')"


@query(f"""WITH m AS (SELECT p_partkey AS id, {MESSY} AS raw FROM part), known AS (SELECT lower(trim(p_type)) AS low, min(p_type) AS stored FROM part GROUP BY 1),
asked AS (SELECT DISTINCT raw, lower(trim(raw)) AS low FROM m), exact AS (SELECT asked.raw, asked.low, known.stored FROM asked LEFT JOIN known ON asked.low = known.low),
near AS (SELECT raw, stored FROM (SELECT e.raw, k.stored, row_number() OVER (PARTITION BY e.raw ORDER BY levenshtein({COMPACT.format('e.raw')}, {COMPACT.format('k.stored')}), k.stored) AS r
  FROM exact e, known k WHERE e.stored IS NULL AND e.low <> '' AND levenshtein({COMPACT.format('e.raw')}, {COMPACT.format('k.stored')}) <= 2) WHERE r = 1)
SELECT m.id, coalesce(e.stored, n.stored, CASE WHEN e.low <> '' THEN e.low END) AS category, CASE WHEN e.stored IS NULL AND n.stored IS NOT NULL THEN 'corrected from ' || m.raw END AS category_warning
FROM m LEFT JOIN exact e ON e.raw = m.raw LEFT JOIN near n ON n.raw = m.raw""")
def category_fuzzy_correct(c: Catalog) -> DataFrame:
    rows = _messy(c)
    return match.resolve_categories(rows.select("id", F.col("raw").alias("category")), rows.select("category"))


@query(v(f"SELECT a.product_id, a.date, round({S.price_score('a.price', 'b.price')}, 6) AS score FROM price_history a JOIN latest_price b ON a.product_id = b.product_id"), dated=True)
def price_similarity(c: Catalog) -> DataFrame:
    """Each historical price against the latest."""
    last = histories.latest_prices(c.price_history).select("product_id", F.col("price").alias("now"))
    return c.price_history.join(last, "product_id").select("product_id", "date", F.round(T.price_similarity(F.col("price"), F.col("now")), 6).alias("score"))


@query(v(f"SELECT a.product_id, a.date, round({S.performance_score('a.sales', 'b.sales')}, 6) AS score FROM performance_history a JOIN latest_performance b ON a.product_id = b.product_id"), dated=True)
def performance_similarity(c: Catalog) -> DataFrame:
    last = histories.latest_performance(c.performance_history).select("product_id", F.col("sales").alias("now"))
    return c.performance_history.join(last, "product_id").select("product_id", "date", F.round(T.performance_similarity(F.col("sales"), F.col("now")), 6).alias("score"))


@query(v("SELECT product_id, date, round(" + S.weighted("least(price / 20, 100.0)", 0.3, 40) + ", 6) AS part FROM price_history"), dated=True)
def asymmetric_score(c: Catalog) -> DataFrame:
    score = F.least(F.col("price") / 20, F.lit(100.0))
    return c.price_history.select("product_id", "date", F.round(T.asymmetric(score, 0.3, 40), 6).alias("part"))


# Vectors


@query(v("SELECT q_id, c_id, rank, round(cosine, 6) AS cosine FROM (SELECT q_id, c_id, cosine, CAST(row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, c_id) AS INTEGER) AS rank FROM visual_all) WHERE rank <= 10", S.VECTORS))
def visual_knn_topk(c: Catalog) -> DataFrame:
    found = knn.catalog_knn(c.with_features(c.new), c.with_features(c.historical), TOP)
    return found.select("q_id", "c_id", F.col("rank").cast("int").alias("rank"), F.round("cosine", 6).alias("cosine"))


@query(v("SELECT q_id, c_id, round(raw_score, 6) AS raw_score, round(similarity_score, 6) AS similarity_score FROM visual_all", S.VECTORS))
def visual_cosine_all_pairs(c: Catalog) -> DataFrame:
    scored = match.visual_pairs(c.with_features(c.new), c.with_features(c.historical), ALL, "embedding")
    return scored.select("q_id", "c_id", F.round("score", 6).alias("raw_score"), F.round("similarity_score", 6).alias("similarity_score"))


@query(v("SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(rank AS INTEGER) AS rank, round(similarity_score, 6) AS similarity_score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity_score DESC, c_id) AS rank FROM visual_all WHERE similarity_score >= 30) WHERE rank <= 10", S.VECTORS))
def visual_match_topk(c: Catalog) -> DataFrame:
    found = match.visual_matches(c.with_features(c.new), c.with_features(c.historical), TOP)
    return found.select("new_product_id", "matched_product_id", "rank", F.round("similarity_score", 6).alias("similarity_score"))


HIST = ("list_transform(qv, lambda x: abs(x))", "list_transform(cv, lambda x: abs(x))")
NORM = "list_transform({0}, lambda x: x / list_sum({0}))"
COLOR = "least(100.0, list_sum(list_transform(list_zip(" + NORM.format("a") + ", " + NORM.format("b") + "), lambda z: least(z[1], z[2]))) * 100)"
SHAPE = "exp(-sqrt(list_sum(list_transform(list_zip(qv, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 2) * 100"
TEXTURE = "exp(-(0.5 * list_sum(list_transform(list_zip(" + NORM.format("a") + ", " + NORM.format("b") + "), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2] + 1e-10)))) / 0.5) * 100"
HISTS = f", hists AS (SELECT q_id, c_id, qv, cv, {HIST[0]} AS a, {HIST[1]} AS b FROM visual_pairs)"


def _described(c: Catalog, what: str) -> DataFrame:
    scored = match.visual_pairs(c.with_features(c.new), c.with_features(c.historical), ALL, what)
    return scored.select("q_id", "c_id", F.round("score", 6).alias("score"))


@query(v(f"SELECT q_id, c_id, round({COLOR}, 6) AS score FROM hists", S.VECTORS, HISTS))
def color_similarity(c: Catalog) -> DataFrame:
    return _described(c, "color")


@query(v(f"SELECT q_id, c_id, round({SHAPE}, 6) AS score FROM hists", S.VECTORS, HISTS))
def shape_similarity(c: Catalog) -> DataFrame:
    return _described(c, "shape")


@query(v(f"SELECT q_id, c_id, round({TEXTURE}, 6) AS score FROM hists", S.VECTORS, HISTS))
def texture_similarity(c: Catalog) -> DataFrame:
    return _described(c, "texture")


@query(v(f"SELECT q_id, c_id, round(0.5 * {COLOR} + 0.3 * {SHAPE} + 0.2 * {TEXTURE}, 6) AS score FROM hists", S.VECTORS, HISTS))
def combined_similarity(c: Catalog) -> DataFrame:
    return _described(c, "combined")


@query("""SELECT vec_id AS product_id, CASE WHEN vec_id % 7 = 0 THEN 'MISSING_FEATURES' WHEN vec_id % 7 = 1 THEN 'EMPTY_FEATURES' WHEN vec_id % 7 = 2 THEN 'FEATURE_DIMENSION_MISMATCH' WHEN vec_id % 7 = 3 THEN 'NAN_FEATURES' WHEN vec_id % 7 = 4 THEN 'INF_FEATURES' END AS error_code,
CASE WHEN vec_id % 7 = 5 THEN 'ALL_ZERO' END AS warning FROM embeddings""")
def feature_validation(c: Catalog) -> DataFrame:
    k, e = F.col("product_id") % 7, F.col("embedding").cast("array<double>")
    broken = (
        F.when(k == 0, None).when(k == 1, F.slice(e, 1, 0)).when(k == 2, F.slice(e, 1, 3)).when(k == 3, F.transform(e, lambda x, i: F.when(i == 2, float("nan")).otherwise(x)))
        .when(k == 4, F.transform(e, lambda x, i: F.when(i == 2, float("inf")).otherwise(x))).when(k == 5, F.transform(e, lambda x: x * 0)).otherwise(e)
    )
    rows = c.features.select("product_id", broken.alias("x"))
    return rows.select("product_id", V.feature_error(F.col("x"), 64).alias("error_code"), V.feature_warning(F.col("x")).alias("warning"))


HYBRID = """,
varm AS (SELECT q_id, c_id, similarity_score AS s FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity_score DESC, c_id) AS r FROM visual_all WHERE similarity_score >= 30) WHERE r <= 100),
marm AS (SELECT q_id, c_id, similarity_score AS s FROM metadata_ranked WHERE rank <= 100),
merged AS (SELECT coalesce(v.q_id, m.q_id) AS q_id, coalesce(v.c_id, m.c_id) AS c_id, coalesce(v.s, 0) AS visual_score, coalesce(m.s, 0) AS metadata_score FROM varm v FULL OUTER JOIN marm m ON v.q_id = m.q_id AND v.c_id = m.c_id),
hybrid AS (SELECT *, visual_score * 0.5 + metadata_score * 0.5 AS s FROM merged)"""


@query(v("SELECT q_id AS new_product_id, c_id AS matched_product_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS similarity_score, round(visual_score, 6) AS visual_score, round(metadata_score, 6) AS metadata_score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, c_id) AS rank FROM hybrid WHERE s >= 30) WHERE rank <= 10", S.METADATA, S.VECTORS, HYBRID))
def hybrid_match_topk(c: Catalog) -> DataFrame:
    side = lambda p: c.with_latest(p).join(c.described.withColumnRenamed("product_id", "id"), "id", "left")
    found = match.hybrid_matches(side(c.new), side(c.historical), TOP)
    return found.select("new_product_id", "matched_product_id", "rank", *(F.round(x, 6).alias(x) for x in ("similarity_score", "visual_score", "metadata_score")))


# Match statistics and results. Ranked metadata matches are the input of all of these.


def _matches(c: Catalog) -> DataFrame:
    return match.metadata_matches(c.with_latest(c.new), c.with_latest(c.historical), TOP)


M10 = ", m AS (SELECT q_id AS new_product_id, c_id AS matched_product_id, rank, similarity_score, c_category AS category, c_name AS product_name FROM metadata_ranked WHERE rank <= 10)"


@query(v("SELECT new_product_id, count(*) AS total_matches, round(max(similarity_score), 6) AS highest, round(min(similarity_score), 6) AS lowest, round(avg(similarity_score), 6) AS average, count(*) FILTER (similarity_score > 90) AS duplicates, count(*) FILTER (similarity_score > 70) AS high, count(*) FILTER (similarity_score BETWEEN 50 AND 70) AS medium, count(*) FILTER (similarity_score < 50) AS low FROM m GROUP BY 1", S.METADATA, M10))
def match_statistics(c: Catalog) -> DataFrame:
    got = match.match_statistics(_matches(c))
    return got.withColumns({x: F.round(x, 6) for x in ("highest", "lowest", "average")})


@query(v("""SELECT q_id AS new_product_id, count(*) AS total_candidates, count(*) FILTER (similarity_score < 50) AS filtered_by_threshold, count(*) FILTER (coalesce(c_sku, '') = '') AS missing_sku, count(*) FILTER (coalesce(c_name, '') = '') AS missing_name,
count(*) FILTER (coalesce(c_category, '') = '') AS missing_category, count(*) FILTER (coalesce(c_price, 0) = 0) AS missing_price, count(*) FILTER (c_sales IS NULL) AS missing_performance,
count(*) FILTER (coalesce(c_sku, '') = '') + count(*) FILTER (coalesce(c_name, '') = '') + count(*) FILTER (coalesce(c_category, '') = '') + count(*) FILTER (coalesce(c_price, 0) = 0) + count(*) FILTER (c_sales IS NULL) AS total_issues FROM metadata_all GROUP BY 1""", S.METADATA))
def match_run_counters(c: Catalog) -> DataFrame:
    return match.metadata_counters(match.prepared(c.with_latest(c.new)), match.prepared(c.with_latest(c.historical)), ALL, 50)


@query(v("SELECT count(*) AS total, count(*) AS successful, 0 AS failed, 100.0 AS success_rate, CAST(sum(n) AS BIGINT) AS total_matches FROM (SELECT p.id, count(m.rank) AS n FROM products p LEFT JOIN m ON m.new_product_id = p.id WHERE NOT p.is_historical GROUP BY 1)", S.METADATA, M10))
def match_run_summary(c: Catalog) -> DataFrame:
    _, status, _ = match.match(c.with_latest(c.new).withColumn("embedding", F.lit(None).cast("array<float>")), c.with_latest(c.historical).withColumn("embedding", F.lit(None).cast("array<float>")), TOP, "metadata")
    return match.batch_summary(status)


@query(v("SELECT count(*) AS products, count(*) FILTER (n > 0) AS with_matches, CAST(sum(n) AS BIGINT) AS total_matches, round(sum(n) / count(*) FILTER (n > 0), 1) AS avg_matches FROM (SELECT p.id, count(m.rank) AS n FROM products p LEFT JOIN m ON m.new_product_id = p.id WHERE NOT p.is_historical GROUP BY 1)", S.METADATA, M10))
def results_summary(c: Catalog) -> DataFrame:
    return reports.results_summary(match.query_status(c.new, _matches(c), c.new.limit(0).select(F.col("id").alias("new_product_id"), F.lit("").alias("error_code"))))


TREND = "CASE WHEN {0} > {1} * {2} THEN 'up' WHEN {0} < {1} * {3} THEN 'down' ELSE 'stable' END"
STATS = """,
pr AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM price_history),
price_stats AS (SELECT product_id, round(min(price), 2) AS min_price, round(max(price), 2) AS max_price, floor(CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) / count(price) * 100 + 0.5) / 100 AS average_price, round(max(price) FILTER (r = 1), 2) AS current_price,
  """ + TREND.format("max(price) FILTER (r = 1)", "max(price) FILTER (r = 2)", 1.05, 0.95) + """ AS trend, count(*) AS data_points FROM pr GROUP BY 1),
sr AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM performance_history),
sales_stats AS (SELECT product_id, CAST(sum(sales) AS BIGINT) AS total_sales, CAST(sum(views) AS BIGINT) AS total_views, round(sum(revenue), 2) AS total_revenue, round(avg(conversion_rate), 2) AS avg_conversion, round(sum(sales) / count(*), 1) AS avg_sales_per_period,
  """ + TREND.format("max(sales) FILTER (r = 1)", "max(sales) FILTER (r = 2)", 1.1, 0.9) + " AS sales_trend, " + TREND.format("max(conversion_rate) FILTER (r = 1)", "max(conversion_rate) FILTER (r = 2)", 1.05, 0.95) + """ AS conversion_trend, count(*) AS data_points FROM sr GROUP BY 1)"""


@query(v("SELECT * FROM price_stats", STATS))
def price_statistics(c: Catalog) -> DataFrame:
    return histories.price_statistics(c.price_history)


@query(v("SELECT * FROM sales_stats", STATS))
def performance_statistics(c: Catalog) -> DataFrame:
    return histories.performance_statistics(c.performance_history)


def _state(c: Catalog, kind: str, rows: DataFrame) -> history_state.HistoryState:
    """Histories merged in three batches by month, one of them twice."""
    state = history_state.HistoryState(c.spark, new_path(c.spark, f"{kind}-state"), kind, 4)
    for batch in (0, 1, 2, 1):
        state.merge(rows.filter(F.month("date") % 3 == batch), f"batch-{batch}")
    return state


@query(v("SELECT * FROM price_stats", STATS))
def merged_price_statistics(c: Catalog) -> DataFrame:
    return _state(c, "price", c.price_history).statistics()


@query(v("SELECT * FROM sales_stats", STATS))
def merged_performance_statistics(c: Catalog) -> DataFrame:
    return _state(c, "performance", c.performance_history).statistics()


@query(v("SELECT * FROM latest_price"), dated=True)
def merged_latest_price(c: Catalog) -> DataFrame:
    return _state(c, "price", c.price_history).latest()


@query(v("SELECT m.new_product_id, m.matched_product_id, round(similarity_score, 6) AS similarity_score, CASE WHEN similarity_score > 95 THEN 'Very likely duplicate' ELSE 'Possible duplicate' END AS recommendation, p.current_price, p.trend AS price_trend, s.total_sales, s.sales_trend FROM m LEFT JOIN price_stats p ON p.product_id = m.matched_product_id LEFT JOIN sales_stats s ON s.product_id = m.matched_product_id WHERE similarity_score > 90", S.METADATA, M10, STATS))
def duplicate_report(c: Catalog) -> DataFrame:
    got = reports.duplicate_report(_matches(c), histories.price_statistics(c.price_history), histories.performance_statistics(c.performance_history))
    return got.withColumn("similarity_score", F.round("similarity_score", 6))


@query(v("""SELECT p.id AS new_product_id, p.product_name AS name, p.category, coalesce(n.k, 0) AS match_count, CASE WHEN n.k IS NULL THEN 'No matches' ELSE coalesce(b.product_name, '') END AS top_match, round(coalesce(b.similarity_score, 0), 1) AS top_score,
ps.current_price, ps.average_price, ps.min_price, ps.max_price, ps.trend AS price_trend, ss.total_sales, ss.avg_sales_per_period AS average_sales, ss.sales_trend
FROM products p LEFT JOIN (SELECT new_product_id, count(*) AS k FROM m GROUP BY 1) n ON n.new_product_id = p.id LEFT JOIN m b ON b.new_product_id = p.id AND b.rank = 1 LEFT JOIN price_stats ps ON ps.product_id = b.matched_product_id LEFT JOIN sales_stats ss ON ss.product_id = b.matched_product_id WHERE NOT p.is_historical""", S.METADATA, M10, STATS))
def results_export(c: Catalog) -> DataFrame:
    return reports.results_export(c.new, _matches(c), histories.price_statistics(c.price_history), histories.performance_statistics(c.performance_history))


@query(v("SELECT new_product_id, matched_product_id, CAST(row_number() OVER (PARTITION BY new_product_id ORDER BY similarity_score DESC, matched_product_id) AS INTEGER) AS rank, round(similarity_score, 6) AS similarity_score FROM m WHERE similarity_score >= 60 AND category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY new_product_id ORDER BY similarity_score DESC, matched_product_id) <= 3", S.METADATA, M10))
def refilter_results(c: Catalog) -> DataFrame:
    found = _matches(c).filter("category is not null")
    return reports.refilter(found, least=60, first=3).select("new_product_id", "matched_product_id", "rank", F.round("similarity_score", 6).alias("similarity_score"))


@query(v("SELECT m.new_product_id, m.matched_product_id, a.product_name AS new_name, b.product_name AS matched_name, pa.trend AS new_trend, pb.trend AS matched_trend, sa.total_sales AS new_total_sales, sb.total_sales AS matched_total_sales FROM m JOIN products a ON a.id = m.new_product_id JOIN products b ON b.id = m.matched_product_id LEFT JOIN price_stats pa ON pa.product_id = a.id LEFT JOIN price_stats pb ON pb.product_id = b.id LEFT JOIN sales_stats sa ON sa.product_id = a.id LEFT JOIN sales_stats sb ON sb.product_id = b.id", S.METADATA, M10, STATS))
def match_comparison(c: Catalog) -> DataFrame:
    pairs = _matches(c).select("new_product_id", "matched_product_id")
    got = reports.comparison(pairs, c.products, histories.price_statistics(c.price_history), histories.performance_statistics(c.performance_history).drop("data_points"))
    return got.select("new_product_id", "matched_product_id", F.col("new_product_name").alias("new_name"), F.col("matched_product_name").alias("matched_name"), "new_trend", "matched_trend", "new_total_sales", "matched_total_sales")


@query(v("SELECT p.id, coalesce(p.category, m.category) AS category FROM products p LEFT JOIN m ON m.new_product_id = p.id AND m.rank = 1 WHERE NOT p.is_historical", S.METADATA, M10))
def infer_category(c: Catalog) -> DataFrame:
    return match.infer_category(c.new, _matches(c)).select("id", "category")


# Histories


@query(v("SELECT * FROM latest_price"), dated=True)
def latest_price(c: Catalog) -> DataFrame:
    return histories.latest_prices(c.price_history)


@query(v("SELECT * FROM latest_performance"), dated=True)
def latest_performance(c: Catalog) -> DataFrame:
    return histories.latest_performance(c.performance_history)


@query(v("SELECT product_id, date, price, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM price_history) WHERE r <= 12"), dated=True)
def history_last12(c: Catalog) -> DataFrame:
    return histories.last_rows(c.price_history)


@query(v("""SELECT q AS product_id, date, price FROM (SELECT l.q, h.date, h.price FROM (SELECT id AS q, id + 1 AS src FROM products) l JOIN (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM price_history) h ON h.product_id = l.src AND h.r <= 12) x
WHERE NOT EXISTS (SELECT 1 FROM price_history y WHERE y.product_id = x.q AND y.date = x.date)"""), dated=True)
def history_link(c: Catalog) -> DataFrame:
    """Each product gets the prices of the next one."""
    links = c.products.select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    return histories.link(c.price_history, links)


SERIES = "list_transform(range(0, 1 + p_partkey % 5), lambda i: p_size + i * 7)"


@query(f"WITH s AS (SELECT p_partkey AS id, p_size, p_partkey % 5 AS k FROM part) SELECT id, i, CAST(DATE '2024-06-15' - to_months(CAST(k - i AS INTEGER)) AS DATE) AS date, CAST(p_size + i * 7 AS DOUBLE) AS value FROM (SELECT *, unnest(range(0, 1 + k)) AS i FROM s)", dated=True)
def generated_months(c: Catalog) -> DataFrame:
    k = F.col("p_partkey") % 5
    values = F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: (F.col("p_size") + i * 7).cast("double"))
    rows = c.table("part").select(F.col("p_partkey").alias("id"), F.posexplode(H.monthly(values, F.lit(AS_OF))).alias("i", "m"))
    return rows.select("id", F.col("i").cast("long").alias("i"), F.col("m.date").alias("date"), F.col("m.value").alias("value"))


@query(v("SELECT product_id, date, round((price - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 9) AS scaled FROM (SELECT *, min(price) OVER w AS lo, max(price) OVER w AS hi FROM price_history WINDOW w AS (PARTITION BY product_id))"), dated=True)
def series_minmax(c: Catalog) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("date", "price")))
    got = c.price_history.groupBy("product_id").agg(rows.alias("rows"))
    got = got.select("product_id", F.arrays_zip(F.col("rows.date").alias("date"), H.min_max_scaled(F.col("rows.price")).alias("scaled")).alias("z"))
    return got.select("product_id", F.inline("z")).withColumn("scaled", F.round("scaled", 9))


def _orders(c: Catalog) -> DataFrame:
    return c.table("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders)
SELECT id, day AS date, CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) AS price FROM o WHERE id % 3 < 2 UNION ALL SELECT id, CAST(day + 31 AS DATE), CAST(CAST(price + 1 AS DECIMAL(18,2)) AS DOUBLE) FROM o WHERE id % 3 < 2
UNION ALL SELECT id, DATE '2024-05-15', CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) FROM o WHERE id % 3 = 2 UNION ALL SELECT id, DATE '2024-06-15', CAST(CAST(price + 1 AS DECIMAL(18,2)) AS DOUBLE) FROM o WHERE id % 3 = 2""", dated=True)
def price_history_parse(c: Catalog) -> DataFrame:
    """Histories written with ISO dates, with US dates and a bad entry, and without dates, parsed again."""
    money = lambda x: F.col("price").cast("decimal(18,2)").cast("string") if not x else (F.col("price") + x).cast("decimal(18,2)").cast("string")
    later = F.date_add("day", 31)
    us = lambda d: F.date_format(d, "M/d/yyyy")
    text = (
        F.when(F.col("id") % 3 == 0, F.concat(F.col("day").cast("string"), F.lit(":"), money(0), F.lit(";"), later.cast("string"), F.lit(": "), money(1)))
        .when(F.col("id") % 3 == 1, F.concat(us("day"), F.lit(":"), money(0), F.lit(",never:5,2024-13-01:3,"), us(later), F.lit(":"), money(1)))
        .otherwise(F.concat(money(0), F.lit(" ; "), money(1)))
    )
    return _orders(c).select("id", F.inline(H.price_history(text, F.lit(AS_OF))))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey AS BIGINT) AS k FROM orders)
SELECT id, day AS date, k AS sales, k * 10 AS views, CAST(12.5 AS DOUBLE) AS conversion_rate, CAST(k * 2 AS DOUBLE) AS revenue FROM o WHERE id % 2 = 0
UNION ALL SELECT id, DATE '2024-05-15', k, 0, 0, 0 FROM o WHERE id % 2 = 1 UNION ALL SELECT id, DATE '2024-06-15', k + 1, 0, 0, 0 FROM o WHERE id % 2 = 1""", dated=True)
def performance_history_parse(c: Catalog) -> DataFrame:
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_custkey").alias("k"))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.concat_ws(":", "day", "k", F.col("k") * 10, F.lit("12.5"), F.col("k") * 2), F.lit(";2024-01-01:1:1:101:1;x"))).otherwise(F.concat(F.lit("["), "k", F.lit(", "), F.col("k") + 1, F.lit("]")))
    return rows.select("id", F.inline(H.performance_history(text, F.lit(AS_OF))))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'date is required' WHEN 1 THEN 'invalid date' WHEN 2 THEN 'price must be a number' WHEN 3 THEN 'price must not be negative' END AS error FROM orders""")
def history_validate(c: Catalog) -> DataFrame:
    k = F.col("o_orderkey") % 6
    rows = c.table("orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, "").when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(k == 2, "n/a").when(k == 3, "-1.5").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    return ingest.checked_prices(rows).select("id", "error")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'invalid date' WHEN 1 THEN 'sales must be a number' WHEN 2 THEN 'views must not be negative' WHEN 3 THEN 'conversion_rate must be 100 at most' WHEN 4 THEN 'revenue must not be negative' END AS error FROM orders""")
def performance_validate(c: Catalog) -> DataFrame:
    k = F.col("o_orderkey") % 7
    pick = lambda i, bad, good: F.when(k == i, bad).otherwise(good)
    rows = c.table("orders").select(
        F.col("o_orderkey").alias("id"), pick(0, "2024-02-30", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), pick(1, "many", "5").alias("sales"), pick(2, "-5", "50").alias("views"),
        pick(3, "100.5", "10").alias("conversion_rate"), pick(4, "-0.01", F.lit(None)).alias("revenue"))
    return ingest.checked_performance(rows).select("id", "error")


# Text cleaning


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 11 = 1 THEN NULL ELSE floor(l_extendedprice * 100 + 0.5) / 100 END AS price FROM lineitem""")
def price_parse(c: Catalog) -> DataFrame:
    k, money = F.col("l_orderkey") % 11, F.format_number("l_extendedprice", 2)
    text = F.when(k == 0, F.concat(F.lit("-"), money)).when(k == 1, F.lit("call us")).when(k % 3 == 0, F.concat(F.lit("$"), money)).when(k % 3 == 1, F.concat(F.lit(" € "), money, F.lit(" each"))).otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.parse_price(text).alias("price"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN '' ELSE p_name END AS field FROM part")
def field_sanitize(c: Catalog) -> DataFrame:
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, " N/A ").when(k == 1, F.lit(None)).when(k == 2, "'-'").when(k == 3, F.concat(F.lit(' "'), "p_name", F.lit('" '))).otherwise(F.concat("p_name", F.lit("\t")))
    return c.table("part").select(F.col("p_partkey").alias("id"), T.sanitize_field(text).alias("field"))


@query("""WITH s AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' ' || lower(replace(p_brand, '#', '_')) || ' ' WHEN 1 THEN p_brand WHEN 2 THEN '  ' ELSE repeat('x', 51) END AS sku FROM part)
SELECT id, nullif(upper(trim(sku)), '') AS sku, trim(sku) = '' OR (length(trim(sku)) <= 50 AND regexp_full_match(trim(sku), '[A-Za-z0-9_-]+')) AS valid FROM s""")
def sku_validate(c: Catalog) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(" "))).when(k == 1, F.col("p_brand")).when(k == 2, "  ").otherwise("x" * 51)
    return c.table("part").select(F.col("p_partkey").alias("id"), T.normalize_sku(text).alias("sku"), T.valid_sku(text).alias("valid"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type END AS category FROM part""")
def category_from_path(c: Catalog) -> DataFrame:
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit("main/"), "p_type", F.lit("/a.jpg"))).when(k == 1, F.concat(F.lit("main/"), "p_type", F.lit("/Images/a.jpg"))).when(k == 2, "main/a.jpg").otherwise("a.jpg")
    return c.table("part").select(F.col("p_partkey").alias("id"), T.folder_category(path).alias("category"))


# Import, export, linking


def _lines(c: Catalog) -> DataFrame:
    """Imported rows as text: one in ten is empty, one in seven has a bad price."""
    k = F.col("p_partkey")
    empty = k % 10 == 9
    cell = lambda x: F.when(empty, " ").otherwise(x)
    return c.table("part").select(
        k.alias("row"), cell(F.concat(F.lit("img_"), k.cast("string"), F.lit(".jpg"))).alias("filename"), cell(F.col("p_type")).alias("category"),
        cell(F.when(k % 4 == 0, "null").otherwise(F.concat(F.lit("SKU-"), (k % 700).cast("string")))).alias("sku"), cell(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("name"),
        cell(F.when(k % 7 == 0, "free").otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)))).alias("price"), cell(F.lit("")).alias("price_history"), cell(F.lit("[1, 2]")).alias("performance_history"),
    )


LINES = """WITH l AS (SELECT p_partkey AS row, 'img_' || p_partkey || '.jpg' AS filename, p_type AS category, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'SKU-' || (p_partkey % 700) END AS sku, p_name AS name,
CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE floor(p_retailprice * 100 + 0.5) / 100 END AS price, p_partkey % 7 = 0 AS price_error FROM part WHERE p_partkey % 10 <> 9)"""


@query(f"{LINES} SELECT * FROM l")
def csv_clean_import(c: Catalog) -> DataFrame:
    return csv.clean(_lines(c)).select("row", "filename", "category", "sku", "name", "price", "price_error")


@query(f"{LINES} SELECT count(*) AS imported, (SELECT count(*) FROM part) - count(*) AS empty_rows, count(*) FILTER (price_error) AS invalid_prices, 0 AS missing_fields, 0 AS parse_errors, (SELECT count(*) FROM (SELECT lower(sku) FROM l WHERE sku <> '' GROUP BY 1 HAVING count(*) > 1)) AS duplicate_skus FROM l")
def import_quality(c: Catalog) -> DataFrame:
    return reports.import_summary(_lines(c))


@query(f"{LINES} SELECT row, 'duplicate SKU: ' || sku || ' x' || n AS warning FROM (SELECT row, sku, count(*) OVER (PARTITION BY sku) AS n FROM l) WHERE sku <> '' AND n > 1")
def import_warnings(c: Catalog) -> DataFrame:
    cells = {x: T.sanitize_field(F.col(x)) for x in ("sku", "price", "price_history")}
    return reports.import_warnings(_lines(c).filter("trim(filename) <> ''").withColumns(cells))


@query(f"{LINES} SELECT filename, category, sku, name, coalesce(CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), '') AS price, '' AS price_history, '[1,2]' AS performance_history FROM l")
def csv_serialize(c: Catalog) -> DataFrame:
    out = csv.to_csv_columns(csv.typed(csv.clean(_lines(c)), F.lit(AS_OF)))
    return out.withColumn("price", F.when(F.col("price") == "", "").otherwise(F.col("price").cast("decimal(18,2)").cast("string")))


def _images(c: Catalog, name: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    names = {
        "sku": F.concat(F.lit("sku-"), (F.col("p_partkey") % 900).cast("string"), F.lit(".JPG")), "inside": F.concat(F.lit("photo_SKU-"), (F.col("p_partkey") % 900).cast("string"), F.lit("_front.jpg")),
        "folder": F.concat(k, F.lit(".jpg")), "words": F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jpg")), "own": F.concat(F.lit("IMG_"), k, F.lit(".JPG")),
    }
    category = F.concat(F.lit("sku-"), (F.col("p_partkey") % 900).cast("string")) if name == "folder" else F.col("p_type")
    return c.table("part").select(k.alias("path"), names[name].alias("filename"), category.alias("category"))


def _rows(c: Catalog) -> DataFrame:
    cleaned = csv.clean(_lines(c))
    return cleaned.withColumn("price", F.col("price").cast("string"))


FIRST = LINES + ", firsts AS (SELECT lower(sku) AS key, min(row) AS row FROM l WHERE sku <> '' GROUP BY 1), images AS (SELECT CAST(p_partkey AS VARCHAR) AS path, 'sku-' || (p_partkey % 900) AS key FROM part)"
BY_SKU = f"{FIRST} SELECT path, row FROM images JOIN firsts USING (key)"


@query(BY_SKU)
def link_filename_equals_sku(c: Catalog) -> DataFrame:
    return link.by_filename(_images(c, "sku"), _rows(c))


@query(BY_SKU)
def link_filename_contains_sku(c: Catalog) -> DataFrame:
    return link.by_sku_in_filename(_images(c, "inside"), _rows(c))


@query(BY_SKU)
def link_folder_equals_sku(c: Catalog) -> DataFrame:
    return link.by_folder(_images(c, "folder"), _rows(c))


FUZZY = """CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b))
ELSE len(list_filter(x, lambda s: len(list_filter(y, lambda t: contains(s, t) OR contains(t, s))) > 0)) / greatest(len(x), len(y)) END"""


@query(f"""{LINES}, names AS (SELECT name AS b, min(row) AS row FROM l GROUP BY 1), texts AS (SELECT DISTINCT p_name AS a FROM part),
scored AS (SELECT a, row, {FUZZY} AS score FROM (SELECT a, b, row, list_filter(string_split(a, ' '), lambda w: length(w) > 1) AS x, list_filter(string_split(b, ' '), lambda w: length(w) > 1) AS y FROM texts, names)),
best AS (SELECT a, row, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, row) AS r FROM scored WHERE score >= 0.5) WHERE r = 1)
SELECT CAST(p_partkey AS VARCHAR) AS path, row, round(score, 6) AS score FROM part JOIN best ON a = p_name""")
def link_fuzzy_name(c: Catalog) -> DataFrame:
    return link.by_fuzzy_name(_images(c, "words"), _rows(c)).withColumn("score", F.round("score", 6))


@query(f"{FIRST} SELECT 'image' AS side, path AS key FROM images WHERE key NOT IN (SELECT key FROM firsts) UNION ALL SELECT 'row', CAST(row AS VARCHAR) FROM l WHERE row NOT IN (SELECT row FROM images JOIN firsts USING (key))")
def link_unmatched(c: Catalog) -> DataFrame:
    _, images, rows = link.run(_images(c, "sku"), _rows(c), "filename_equals_sku")
    return images.select(F.lit("image").alias("side"), F.col("path").alias("key")).unionByName(rows.select(F.lit("row").alias("side"), F.col("row").cast("string").alias("key")))


@query(f"{LINES} SELECT CAST(p_partkey AS VARCHAR) AS path, coalesce(l.category, p_type) AS category, nullif(l.sku, '') AS sku, l.name, l.row IS NOT NULL AS matched FROM part LEFT JOIN l ON lower(l.filename) = 'img_' || p_partkey || '.jpg'")
def template_merge(c: Catalog) -> DataFrame:
    got, _ = link.template_merge(_images(c, "own"), _rows(c).select("row", "filename", "category", "sku", "name"))
    return got.select("path", "category", "sku", "name", "matched")


# Reports


@query(v("SELECT id, NOT EXISTS (SELECT 1 FROM features f WHERE f.product_id = p.id) AS missing_features, category IS NULL AS missing_category, product_name IS NULL AS missing_product_name, sku IS NULL AS missing_sku FROM products p WHERE category IS NULL OR product_name IS NULL OR sku IS NULL OR NOT EXISTS (SELECT 1 FROM features f WHERE f.product_id = p.id)"))
def incomplete_products(c: Catalog) -> DataFrame:
    return reports.incomplete(c.products, c.features)


@query(v("SELECT id FROM products WHERE id NOT IN (SELECT product_id FROM features)"))
def without_features(c: Catalog) -> DataFrame:
    return reports.without_features(c.products, c.features).select("id")


@query(v("SELECT id, embedding_type FROM products p JOIN features f ON f.product_id = p.id WHERE is_historical AND embedding_type = 'clip'"))
def feature_candidates(c: Catalog) -> DataFrame:
    return reports.feature_candidates(c.products, c.features, is_historical=True, embedding_type="clip").select("id", "embedding_type")


@query(v("SELECT id, coalesce(len(embedding), NULL) AS embedding_dim, CASE WHEN f.product_id IS NULL THEN 'pending' ELSE 'success' END AS extraction_status FROM products p LEFT JOIN features f ON f.product_id = p.id"))
def feature_details(c: Catalog) -> DataFrame:
    return reports.feature_details(c.products, c.features).select("id", "embedding_dim", "extraction_status")


@query(v("SELECT id FROM products p JOIN features f ON f.product_id = p.id WHERE embedding_type = 'legacy'"))
def reextract_worklist(c: Catalog) -> DataFrame:
    return reports.to_extract_again(c.products, c.features).select("id")


@query(v("SELECT min(sku) AS sku, count(*) AS n FROM products WHERE sku IS NOT NULL GROUP BY lower(sku) HAVING count(*) > 1"))
def duplicate_skus(c: Catalog) -> DataFrame:
    return reports.duplicate_skus(c.products)


@query(v("""SELECT count(*) AS total_products, count(*) FILTER (product_name IS NULL) AS missing_product_name, count(*) FILTER (sku IS NULL) AS missing_sku, count(*) FILTER (category IS NULL) AS missing_category, count(*) FILTER (NOT h) AS missing_features,
count(*) FILTER (is_historical) AS historical_count, count(*) FILTER (NOT is_historical) AS new_count, count(DISTINCT category) AS categories,
round((count(*) - count(*) FILTER (product_name IS NULL)) / count(*) * 100, 1) AS product_name_completeness, round((count(*) - count(*) FILTER (sku IS NULL)) / count(*) * 100, 1) AS sku_completeness, round((count(*) - count(*) FILTER (category IS NULL)) / count(*) * 100, 1) AS category_completeness, round((count(*) - count(*) FILTER (NOT h)) / count(*) * 100, 1) AS features_completeness,
(SELECT count(*) FROM (SELECT lower(sku) FROM products WHERE sku IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_sku_groups FROM (SELECT p.*, f.product_id IS NOT NULL AS h FROM products p LEFT JOIN features f ON f.product_id = p.id)"""))
def data_quality_stats(c: Catalog) -> DataFrame:
    return reports.quality_stats(c.products, c.features)


@query(v("""SELECT count(*) AS total_products, count(*) FILTER (is_historical) AS historical_count, count(*) FILTER (NOT is_historical) AS new_count, count(DISTINCT category) AS categories, count(*) FILTER (f.product_id IS NULL) AS missing_features, max(created_at) AS last_created,
(SELECT count(*) FROM m) AS total_matches FROM products p LEFT JOIN features f ON f.product_id = p.id""", S.METADATA, M10))
def catalog_stats(c: Catalog) -> DataFrame:
    return reports.catalog_stats(c.products, c.features, _matches(c))


@query(v("SELECT category, count(*) AS n FROM products GROUP BY 1"))
def category_breakdown(c: Catalog) -> DataFrame:
    return reports.category_breakdown(c.products)


@query(v("SELECT DISTINCT category FROM products WHERE category IS NOT NULL"))
def categories(c: Catalog) -> DataFrame:
    return reports.categories(c.products)


@query(v("SELECT category, is_historical, count(*) AS n FROM products GROUP BY 1, 2"))
def index_counts(c: Catalog) -> DataFrame:
    return c.products.groupBy("category", "is_historical").agg(F.count("*").alias("n"))


@query(v("SELECT category, count(*) AS vectors, round(sum(len(embedding) * 4) / 1000000, 3) AS mb FROM products p JOIN features f ON f.product_id = p.id GROUP BY 1"))
def index_statistics(c: Catalog) -> DataFrame:
    return knn.index_statistics(reports.with_features(c.products, c.features))


@query(v("SELECT id, product_name, sku, category FROM products WHERE contains(lower(coalesce(product_name, '')), 'red') OR contains(lower(coalesce(sku, '')), 'red') OR contains(lower(coalesce(category, '')), 'red') ORDER BY created_at DESC, id LIMIT 100"))
def search_products(c: Catalog) -> DataFrame:
    return reports.search(c.products, "Red").select("id", "product_name", "sku", "category")


@query(v("SELECT id, product_name, row, (SELECT count(*) FROM products) AS total, (SELECT CAST(ceil(count(*) / 25) AS BIGINT) FROM products) AS total_pages FROM (SELECT id, product_name, row_number() OVER (ORDER BY product_name, id) AS row FROM products) WHERE row > 50 AND row <= 75 UNION ALL SELECT id, product_name, row, 0, 0 FROM (SELECT id, product_name, row_number() OVER (ORDER BY product_name, id) AS row FROM products) WHERE row > 75 AND row <= 85"))
def pages_by_range(c: Catalog) -> DataFrame:
    """The third page by name, and ten rows that follow it."""
    store = pages.Pages(c.spark, new_path(c.spark, "pages"))
    store.write(c.products.select("id", "product_name"), F.col("product_name"), F.col("id"))
    zero = F.lit(0)
    return store.page(3, 25).select("id", "product_name", "row", "total", "total_pages").unionByName(store.after(75, 10).select("id", "product_name", "row", zero.alias("total"), zero.alias("total_pages")))


def _search_index(c: Catalog) -> search_index.SearchIndex:
    """All products under other names, then, as a second batch, as they are."""
    index = search_index.SearchIndex(c.spark, new_path(c.spark, "search"), 4)
    index.append(c.products.withColumn("product_name", F.concat(F.lit("red herring "), F.col("id").cast("string"))), 1)
    index.append(c.products, 2)
    return index


@query(v("SELECT id, product_name, sku, category FROM products WHERE contains(lower(coalesce(product_name, '')), 'red') OR contains(lower(coalesce(sku, '')), 'red') OR contains(lower(coalesce(category, '')), 'red') ORDER BY created_at DESC, id LIMIT 100"))
def indexed_search(c: Catalog) -> DataFrame:
    return reports.search(_search_index(c).hits("Red"), "Red").select("id", "product_name", "sku", "category")


@query(v("SELECT p.id, p.product_name, CASE WHEN contains(lower(p.product_name), 'brand-1') THEN 0 WHEN contains(lower(coalesce(p.sku, '')), 'brand-1') THEN 1 ELSE 2 END AS search_rank, lp.price FROM products p LEFT JOIN latest_price lp ON lp.product_id = p.id WHERE contains(lower(p.product_name), 'brand-1') OR contains(lower(coalesce(p.sku, '')), 'brand-1') OR contains(lower(coalesce(p.category, '')), 'brand-1') ORDER BY search_rank, p.product_name, p.id LIMIT 100"))
def indexed_ranked_search(c: Catalog) -> DataFrame:
    hits = _search_index(c).hits("Brand-1")
    return reports.ranked_search(hits, histories.latest_prices(c.price_history), "Brand-1").select("id", "product_name", "search_rank", "price")


@query(v("SELECT p.id, p.product_name, CASE WHEN contains(lower(p.product_name), 'e') THEN 0 WHEN contains(lower(coalesce(p.sku, '')), 'e') THEN 1 ELSE 2 END AS search_rank, lp.price FROM products p LEFT JOIN latest_price lp ON lp.product_id = p.id WHERE contains(lower(p.product_name), 'e') OR contains(lower(coalesce(p.sku, '')), 'e') OR contains(lower(coalesce(p.category, '')), 'e') ORDER BY search_rank, p.product_name, p.id LIMIT 100"))
def ranked_search(c: Catalog) -> DataFrame:
    return reports.ranked_search(c.products, histories.latest_prices(c.price_history), "e").select("id", "product_name", "search_rank", "price")


@query(v("SELECT id, filename, has_features, (SELECT count(*) FROM products WHERE contains(lower(product_name), 'ring')) AS total, (SELECT CAST(ceil(count(*) / 20) AS BIGINT) FROM products WHERE contains(lower(product_name), 'ring')) AS total_pages FROM (SELECT p.id, product_name, '[METADATA_ONLY]' AS filename, f.product_id IS NOT NULL AS has_features FROM products p LEFT JOIN features f ON f.product_id = p.id WHERE contains(lower(product_name), 'ring') ORDER BY product_name, p.id LIMIT 20 OFFSET 20)"))
def products_page(c: Catalog) -> DataFrame:
    return reports.page(c.products, c.features, page=2, limit=20, sort_by="name_asc", search="ring").select("id", "filename", "has_features", "total", "total_pages")


@query(v("SELECT id, category FROM products WHERE (category = 'ECONOMY' OR category IS NULL) AND is_historical"))
def products_by_category(c: Catalog) -> DataFrame:
    return reports.by_category(c.products, "ECONOMY", True, include_uncategorized=True).select("id", "category")


@query(v("SELECT id FROM products WHERE is_historical ORDER BY created_at DESC, id LIMIT 100 OFFSET 50"))
def historical_page(c: Catalog) -> DataFrame:
    return reports.historical(c.products, limit=100, offset=50).select("id")


@query(v("SELECT id, sku IS NOT NULL AND EXISTS (SELECT 1 FROM products o WHERE lower(o.sku) = lower(p.sku) AND o.id <> p.id) AS sku_exists FROM products p"))
def sku_exists(c: Catalog) -> DataFrame:
    return reports.sku_exists(c.products.select("id", "sku"), c.products).select("id", "sku_exists")


@query(v("""SELECT id AS "ID", '[METADATA_ONLY]' AS "Filename", coalesce(category, '') AS "Category", coalesce(product_name, '') AS "Name", coalesce(sku, '') AS "SKU", CASE WHEN is_historical THEN 'Historical' ELSE 'New' END AS "Type", created_at AS "Created", CASE WHEN f.product_id IS NULL THEN 'No' ELSE 'Yes' END AS "Has Features" FROM products p LEFT JOIN features f ON f.product_id = p.id"""))
def catalog_export(c: Catalog) -> DataFrame:
    return reports.catalog_export(c.products, c.features)


# Maintenance and snapshots


@query(v("SELECT id, CASE WHEN id % 2 = 0 THEN upper(product_name) ELSE product_name END AS product_name, CASE WHEN id % 4 = 0 THEN NULL ELSE category END AS category FROM products"))
def bulk_update(c: Catalog) -> DataFrame:
    patch = c.products.filter("id % 2 = 0").select("id", F.upper("product_name").alias("product_name"), F.when(F.col("id") % 4 == 0, "").alias("category"))
    return maintain.update(c.products, patch, blank_is_null=True).select("id", "product_name", "category")


def _catalog(c: Catalog) -> dict[str, DataFrame]:
    return {"products": c.products, "features": c.features, "price_history": c.price_history, "performance_history": c.performance_history}


COUNTS = "SELECT 'products' AS \"table\", count(*) AS n FROM products WHERE {0} UNION ALL SELECT 'features', count(*) FROM features WHERE {1} UNION ALL SELECT 'price_history', count(*) FROM price_history WHERE {1} UNION ALL SELECT 'performance_history', count(*) FROM performance_history WHERE {1}"


def _left(catalog: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in catalog.items():
        part = rows.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(v(COUNTS.format("is_historical", "product_id NOT IN (SELECT id FROM products WHERE NOT is_historical)")))
def cascade_delete(c: Catalog) -> DataFrame:
    return _left(maintain.delete(_catalog(c), maintain.of_type(c.products, "new")))


@query(v(COUNTS.format("category IS NULL OR category = 'PROMO'", "product_id IN (SELECT id FROM products WHERE category IS NULL OR category = 'PROMO')")))
def clear_by_category(c: Catalog) -> DataFrame:
    return maintain.deletion_counts(_catalog(c), maintain.of_categories(c.products, ["PROMO", None]))


@query(v("SELECT id FROM products WHERE created_at >= TIMESTAMP '2024-01-01 05:00:00'"))
def clear_by_date(c: Catalog) -> DataFrame:
    gone = maintain.older_than(c.products, 10, datetime.datetime(2024, 1, 11, 5, tzinfo=datetime.timezone.utc))
    return maintain.delete({"products": c.products}, gone)["products"].select("id")


@query(v("""SELECT CAST(row_number() OVER (ORDER BY src, id) AS BIGINT) AS id, sku, (SELECT count(*) FROM price_history h WHERE h.product_id = x.id) AS prices FROM (SELECT 0 AS src, * FROM products WHERE is_historical UNION ALL SELECT 1, * FROM products WHERE NOT is_historical) x"""))
def snapshot_merge(c: Catalog) -> DataFrame:
    sides = [{"products": p, "price_history": c.price_history.join(p.select(F.col("id").alias("product_id")), "product_id", "left_semi")} for p in (c.historical, c.new)]
    got = snapshots.merged(sides, is_historical=True)
    n = got["price_history"].groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("prices"))
    return got["products"].join(n, "id", "left").select("id", "sku", F.coalesce("prices", F.lit(0)).alias("prices"))


@query(v("SELECT CASE WHEN is_historical THEN 'old' ELSE 'new' END AS snapshot, coalesce(category, 'Uncategorized') AS category, count(*) AS n FROM products GROUP BY 1, 2 UNION ALL SELECT CASE WHEN is_historical THEN 'old' ELSE 'new' END, '*', count(*) FROM products GROUP BY 1"))
def active_union(c: Catalog) -> DataFrame:
    return snapshots.info({"old": c.historical, "new": c.new})


def _indexed(c: Catalog) -> tuple[vector_index.VectorIndex, DataFrame]:
    """An index of all vectors, appended in two batches, and the queries: rows whose id is divisible by 20."""
    rows = c.features.select(F.col("product_id").alias("id"), F.lit("").alias("key"), "embedding")
    index = vector_index.VectorIndex(c.spark, new_path(c.spark, "vectors"))
    index.fit(rows)
    for part in (0, 1):
        index.append(rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part))
    index.tune(rows)
    return index, rows.filter("id % 20 = 0")


@query()
def approximate_knn_topk(c: Catalog) -> DataFrame:
    """The ten nearest of all vectors through the index; rows only, as SQL would find the exact ones."""
    index, asked = _indexed(c)
    return index.search(asked, 10).select("q_id", "c_id", F.round("cosine", 6).alias("cosine"), "rank")


@query("SELECT count(*) AS queries, true AS recall_of_90_percent, true AS cosines_are_exact FROM embeddings WHERE vec_id % 20 = 0")
def approximate_knn_recall(c: Catalog) -> DataFrame:
    """What the index finds, held against the exact neighbours of the same queries."""
    index, asked = _indexed(c)
    found = index.search(asked, 10).select("q_id", "c_id", F.col("cosine").alias("found"))
    exact = knn.knn_join(asked, c.features.select(F.col("product_id").alias("id"), F.lit("").alias("key"), "embedding"), 10)
    both = exact.join(found, ["q_id", "c_id"], "left")
    return both.agg(F.count_distinct("q_id").alias("queries"), (F.count("found") >= 0.9 * F.count("*")).alias("recall_of_90_percent"), F.every(F.coalesce(F.abs(F.col("found") - F.col("cosine")) < 1e-6, F.lit(True))).alias("cosines_are_exact"))


@query("SELECT '' AS key, count(*) AS vectors, round(count(*) * 64 / 4 / 1e6, 3) AS code_mb, round(count(*) * 64 * 4 / 1e6, 3) AS vector_mb FROM embeddings")
def vector_index_statistics(c: Catalog) -> DataFrame:
    return _indexed(c)[0].statistics().drop("cells", "bins")
