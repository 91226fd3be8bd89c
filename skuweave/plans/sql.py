"""SQL of the registered queries: the catalog's views and the scoring rules as text."""

from __future__ import annotations

VIEWS = """
products AS (SELECT p_partkey AS id, '[METADATA_ONLY]' AS image_path, CASE WHEN p_partkey % 17 <> 0 THEN p_type END AS category, p_name AS product_name,
  CASE WHEN p_partkey % 13 <> 0 THEN upper(replace(p_brand, '#', '-')) || '-' || CAST(p_partkey % 500 AS VARCHAR) END AS sku, p_partkey % 5 <> 0 AS is_historical,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS created_at FROM part),
price_history AS (SELECT l_partkey AS product_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, max(floor(l_extendedprice / l_quantity * 100) / 100) AS price FROM lineitem GROUP BY 1, 2),
performance_history AS (SELECT l_partkey AS product_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS sales, count(*) * 10 AS views,
  CAST(10.0 AS DOUBLE) AS conversion_rate, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1, 2),
features AS (SELECT vec_id AS product_id, embedding, CASE WHEN vec_id % 3 = 0 THEN 'legacy' ELSE 'clip' END AS embedding_type FROM embeddings),
latest_price AS (SELECT product_id, date, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM price_history) WHERE r = 1),
latest_performance AS (SELECT product_id, date, sales, views, conversion_rate, revenue FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM performance_history) WHERE r = 1),
full_products AS (SELECT p.*, lp.price, ls.sales FROM products p LEFT JOIN latest_price lp ON lp.product_id = p.id LEFT JOIN latest_performance ls ON ls.product_id = p.id),
pairs AS (SELECT q.id AS q_id, c.id AS c_id, q.sku AS q_sku, c.sku AS c_sku, q.product_name AS q_name, c.product_name AS c_name, q.category AS q_category, c.category AS c_category,
  q.price AS q_price, c.price AS c_price, q.sales AS q_sales, c.sales AS c_sales FROM full_products q, full_products c
  WHERE NOT q.is_historical AND c.is_historical AND (q.category IS NULL OR c.category IS NULL OR lower(trim(q.category)) = lower(trim(c.category))))"""

COMMON = "('the','a','an','and','or','of','in','on','at','by','for','with','')"


def clean(c: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex(regexp_replace(lower(trim({c})), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: w NOT IN {COMMON}), ' ')"


def edit(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) * 100 END"


def name_score(a: str, b: str) -> str:
    x, y = clean(a), clean(b)
    words = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
    both, least = f"len(list_intersect({words(x)}, {words(y)}))", f"least(len({words(x)}), len({words(y)}))"
    any_ = f"(len({words(x)}) + len({words(y)}) - {both})"
    jaccard = f"(CASE WHEN {any_} > 0 THEN {both} / {any_} * 100 ELSE 0.0 END)"
    return f"CASE WHEN coalesce(trim({a}), '') = '' OR coalesce(trim({b}), '') = '' THEN 0.0 WHEN {x} = {y} THEN 100.0 WHEN {least} > 0 AND {jaccard} >= 50 THEN {jaccard} WHEN {least} > 0 AND {both} >= {least} * 0.7 THEN {both} / {least} * 100 ELSE {edit(x, y)} END"


def sku_score(a: str, b: str) -> str:
    x, y = f"upper(trim({a}))", f"upper(trim({b}))"
    return f"CASE WHEN coalesce({x}, '') = '' OR coalesce({y}, '') = '' THEN 0.0 WHEN {x} = {y} THEN 100.0 WHEN abs(length({x}) - length({y})) > 5 THEN 0.0 ELSE {edit(x, y)} END"


def category(c: str) -> str:
    return f"(CASE WHEN lower(trim({c})) NOT IN ('', 'unknown', 'uncategorized', 'none', 'n/a', 'na') THEN lower(trim({c})) END)"


def category_score(a: str, b: str) -> str:
    x, y = category(a), category(b)
    return f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN 50.0 WHEN {x} IS NULL OR {y} IS NULL THEN 0.0 WHEN {x} = {y} THEN 100.0 WHEN levenshtein({x}, {y}) <= 2 THEN {edit(x, y)} ELSE 0.0 END"


def price_score(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} <= 0 OR {b} <= 0 THEN 50.0 WHEN {a} = {b} THEN 100.0 ELSE greatest(0.0, 100 - abs({a} - {b}) / (({a} + {b}) / 2) * 100) END"


def performance_score(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 50.0 WHEN {a} = 0 AND {b} = 0 THEN 50.0 WHEN {a} = 0 OR {b} = 0 THEN 25.0 ELSE greatest(0.0, least({a}, {b}) / greatest({a}, {b}) * 100) END"


def weighted(c: str, weight: float, start: float) -> str:
    return f"(CASE WHEN {c} >= {start} THEN {c} * {weight} ELSE {c} * ({weight} * 0.5) END)"


METADATA = f""",
scores AS (SELECT *, {sku_score('q_sku', 'c_sku')} AS sku_score, {category_score('q_category', 'c_category')} AS category_score, {price_score('q_price', 'c_price')} AS price_score, {performance_score('q_sales', 'c_sales')} AS performance_score FROM pairs),
names AS (SELECT a, b, {name_score('a', 'b')} AS name_score FROM (SELECT DISTINCT q_name AS a, c_name AS b FROM pairs)),
named AS (SELECT s.*, n.name_score FROM scores s JOIN names n ON s.q_name = n.a AND s.c_name = n.b),
metadata_all AS (SELECT *, {weighted('sku_score', 0.30, 40)} + {weighted('name_score', 0.30, 50)} + {weighted('category_score', 0.25, 50)} + {weighted('price_score', 0.10, 60)} + {weighted('performance_score', 0.05, 60)} AS similarity_score FROM named),
metadata_ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity_score DESC, c_id) AS rank FROM metadata_all)"""

VECTORS = """,
pf AS (SELECT p.*, list_transform(f.embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM products p JOIN features f ON f.product_id = p.id),
visual_pairs AS (SELECT q.id AS q_id, c.id AS c_id, q.v AS qv, c.v AS cv, c.category AS c_category FROM pf q, pf c WHERE NOT q.is_historical AND c.is_historical
  AND (q.category IS NULL OR c.category IS NULL OR lower(trim(q.category)) = lower(trim(c.category)))),
visual_cos AS (SELECT q_id, c_id, qv, cv, c_category, list_sum(list_transform(list_zip(qv, cv), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(qv, lambda x: x * x)) * list_sum(list_transform(cv, lambda x: x * x))) AS cosine FROM visual_pairs),
visual_all AS (SELECT q_id, c_id, cosine, (cosine + 1) / 2 * 100 AS raw_score, (cosine + 1) / 2 * 100 * CASE WHEN coalesce(c_category, '') = '' THEN 0.9 ELSE 1.0 END AS similarity_score FROM visual_cos)"""


def with_views(select: str, *more: str) -> str:
    return f"WITH {VIEWS}{''.join(more)}\n{select}"
