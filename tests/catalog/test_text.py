import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skuweave.functions import text as T
from skuweave.functions import vectors as V
from skuweave.operators import match


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def pairs(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], f"i int, a {kind}, b {kind}")
    return [r.y for r in rows.select("i", f(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()]


def test_categories(spark):
    assert column(spark, ["PlaceMats", "\tdinnerware\n", "", "  ", "Unknown", "uncategorized", "N/A", None], T.normalize_category) == ["placemats", "dinnerware"] + [None] * 6


def test_skus(spark):
    assert column(spark, [None, "", " ", "sku-123", "Prod_123"], T.normalize_sku) == [None, None, None, "SKU-123", "PROD_123"]
    assert column(spark, ["x" * 51, "SKU 123", "SKU@123", "SKU#123", "SKU-1", None], T.valid_sku) == [False] * 4 + [True] * 2
    got = pairs(spark, [("PM-001", "pm-001 "), ("PM-001", "PM-002"), (None, "x"), ("a", "abcdefgh")], T.sku_similarity)
    assert got == pytest.approx([100, 100 * 5 / 6, 0, 0])


def test_prices(spark):
    texts = ["29.99", "$29.99", "€29.99", "1,234.56", "0", "-29.99", "abc", "", None, "5 each", "2.675"]
    assert column(spark, texts, T.parse_price) == [29.99, 29.99, 29.99, 1234.56, 0.0, None, None, None, None, 5.0, pytest.approx(2.68)]
    assert pairs(spark, [(10.0, 10.0), (None, 1.0), (0.0, 1.0), (10.0, 30.0), (9.0, 11.0), (1.0, 100.0)], T.price_similarity, "double") == pytest.approx([100, 50, 50, 0, 80, 0])


def test_names(spark):
    got = pairs(spark, [("The Mug", "mug!"), ("the", "a"), ("Spiral Notebook", "Notebook Spiral 100 Pages"), ("15 inch Laptop Backpack", "Backpack Laptop 15inch"), ("Wireless Mouse", "Wireless Mouse Ergonomic Pad Black Slim"), ("", "x"), ("abc", "abd")], T.name_similarity)
    assert got[:3] == [100, 100, 50] and got[4] == 100 and got[5] == 0 and got[6] == pytest.approx(200 / 3)
    assert 0 < got[3] < 50


def test_sales_and_categories(spark):
    assert pairs(spark, [(None, 1.0), (0.0, 0.0), (0.0, 5.0), (50.0, 100.0)], T.performance_similarity, "double") == [50, 50, 25, 50]
    assert pairs(spark, [(None, ""), (None, "mugs"), ("Mugs", "mugs "), ("mugs", "mug"), ("mugs", "plates")], T.category_similarity) == [50, 0, 100, 75, 0]


def test_cells_headers_folders(spark):
    assert column(spark, ["N/A", " '-' ", '"a b"', None, "x"], T.sanitize_field) == ["", "", "a b", "", "x"]
    assert [T.header_name(x) for x in ("product_name", "ProductName", "Product SKU", "unit_price", "Sku", "price_history")] == ["name", "name", "sku", "price", "sku", "price_history"]
    paths = ["main/Placemats/a.jpg", "main/a.jpg", "a.jpg", "main/mugs/images/a.jpg", None]
    assert column(spark, paths, T.folder_category) == ["Placemats", None, None, "mugs", None]
    assert column(spark, ["mugs/a.jpg", "images/a.jpg"], lambda c: T.folder_category(c, 2)) == ["mugs", None]


def test_fuzzy_score(spark):
    got = pairs(spark, [("blue", "blue"), ("blue", "blue placemat"), ("abc", "xyz"), ("", "x"), ("red mug", "mug set")], T.fuzzy_score)
    assert got[0] == 1 and 0 < got[1] < 1 and got[2:4] == [0, 0] and got[4] == 0.5


def test_fuzzy_categories(spark):
    known = spark.createDataFrame([(x,) for x in ("placemats", "dinnerware", "glassware", "flatware", "table linens")], "category string")
    asked = {"placemat": "placemats", "place mats": "placemats", "place-mats": "placemats", "dinerware": "dinnerware", "dinner-ware": "dinnerware", "glasware": "glassware", "flatwear": "flatware", "tablelinens": "table linens", "xyz": "xyz", "PLACEMATS": "placemats"}
    rows = spark.createDataFrame([(x,) for x in asked], "category string").withColumn("asked", F.col("category"))
    got = {r.asked: r.category for r in match.resolve_categories(rows, known).collect()}
    assert got == asked


def test_vectors(spark):
    one, left, right, flat = [1.0, 0.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0], [1.0] * 4
    got = pairs(spark, [(left, left), (left, right), (flat, left), ([0.0] * 4, flat)], V.color_similarity, "array<double>")
    assert got == pytest.approx([100, 0, 50, 100])
    assert pairs(spark, [(one, one)], V.shape_similarity, "array<double>") == [100]
    assert pairs(spark, [(one, one), (one, [-1.0, 0.0, 0.0, 0.0]), (one, [0.0] * 4)], V.embedding_similarity, "array<double>") == [100, 0, 0]
    errors = column(spark, [None, [], [1.0], [1.0, float("nan")], [1.0, float("inf")], [0.0, 1.0]], lambda c: V.feature_error(c, 2), "array<double>")
    assert errors == ["MISSING_FEATURES", "EMPTY_FEATURES", "FEATURE_DIMENSION_MISMATCH", "NAN_FEATURES", "INF_FEATURES", None]
    with pytest.raises(ValueError, match="add up"):
        V.combined_similarity(F.lit(1), F.lit(1), F.lit(1), (0.5, 0.5, 0.5))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=12)), min_size=1, max_size=40))
def test_scores_are_symmetric_and_bounded(spark, values):
    for f in (T.sku_similarity, T.name_similarity, T.category_similarity):
        there, back = pairs(spark, values, f), pairs(spark, [(b, a) for a, b in values], f)
        assert there == pytest.approx(back) and all(0 <= x <= 100 for x in there)
