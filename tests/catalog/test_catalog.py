import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuweave.operators import images, link, maintain, match, reports
from skuweave.sources import csv, ingest, sinks, snapshots
from skuweave.streaming.arrivals import match_arrivals

DAY = datetime.date(2024, 6, 15)
NOW = datetime.datetime(2024, 6, 15, 12)
PRODUCTS = "id long, image_path string, category string, product_name string, sku string, is_historical boolean, created_at timestamp, price double, sales long"


def products(spark):
    rows = [(1, "a/b/m1.jpg", "mugs", "Red mug", "SKU-001", True), (2, "m2.jpg", "mugs", "Blue mug", "SKU-002", True), (3, "m3.jpg", None, None, None, True), (4, "m4.jpg", "plates", "Plate", "sku-001", True), (5, "n1.jpg", "mugs", "Red mug", "SKU-001", False)]
    return spark.createDataFrame([(*r, NOW - datetime.timedelta(days=r[0]), 10.0, 5) for r in rows], PRODUCTS)


def features(spark):
    return spark.createDataFrame([(1, [1.0, 0.0], "clip"), (2, [0.0, 1.0], "legacy"), (2, [1.0, 1.0], "clip")], "product_id long, embedding array<double>, embedding_type string")


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_look_ups(spark):
    p, f = products(spark), features(spark)
    assert ids(reports.by_sku(p, "sku-001")) == [1, 4, 5] and ids(reports.by_sku(p, "SKU-001", True)) == [1, 5]
    assert [tuple(r) for r in reports.duplicate_skus(p).collect()] == [("SKU-001", 3)]
    assert ids(reports.without_features(p, f)) == [3, 4, 5] and reports.feature_flag(p, f).count() == 5
    assert ids(reports.by_category(p, None)) == [3] and ids(reports.historical(p, "mugs", include_uncategorized=True)) == [1, 2, 3]
    assert [r.id for r in reports.page(p, f, page=2, limit=2, sort_by="newest").collect()] == [3, 4]
    assert reports.page(p, f, limit=2, has_features=True).first().total == 2
    assert ids(reports.search(p, "MUG")) == [1, 2, 5]
    assert [r.search_rank for r in reports.ranked_search(p, p.select(F.col("id").alias("product_id"), "price"), "mug").collect()] == [0, 0, 0]
    q = reports.quality_stats(p, f).first()
    assert (q.total_products, q.missing_sku, q.missing_features, q.duplicate_sku_groups, q.sku_completeness) == (5, 1, 3, 1, 80.0)
    assert reports.quality_stats(p.limit(0), f).first().sku_completeness == 0
    assert {r.id: r.sku_exists for r in reports.sku_exists(p.select("id", "sku"), p).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    assert ids(reports.to_extract_again(p, f)) == [2] and ids(reports.incomplete(p, f)) == [3, 4, 5]


def test_matching_products_and_exports(spark, tmp_path):
    p = products(spark)
    found = match.metadata_matches(p.filter("not is_historical"), p.filter("is_historical"))
    best = found.filter("rank = 1").first()
    assert best.matched_product_id == 1 and best.is_potential_duplicate
    sinks.matches(found, f"{tmp_path}/m", "run1")
    sinks.matches(found, f"{tmp_path}/m", "run1")
    sinks.matches(found, f"{tmp_path}/m", "run2")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2 * found.count()
    sinks.csv(reports.catalog_export(p, features(spark)), f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == ["ID", "Filename", "Category", "Name", "SKU", "Type", "Created", "Has Features"] and back.filter("Filename = 'm1.jpg'").count() == 1
    none = spark.createDataFrame([], "product_id long, current_price double, average_price double, min_price double, max_price double, trend string, total_sales long, avg_sales_per_period double, sales_trend string")
    assert [r.match_count for r in reports.results_export(p.filter("not is_historical"), found, none, none).collect()] == [3]
    sinks.json(reports.results_json(p.filter("not is_historical"), found, {"visual": 0.5}, 30.0), f"{tmp_path}/json")
    assert len(spark.read.json(f"{tmp_path}/json").first().matches) == 3
    assert [r.id for r in reports.sort_products(p, found, text="mug").select("id").collect()] == [5, 1, 2]
    assert found.count() == 3 and reports.refilter(found, first=2).count() == 2


def test_maintenance(spark):
    p, f = products(spark), features(spark)
    patch = spark.createDataFrame([(1, "", "New")], "id long, category string, product_name string")
    got = {r.id: (r.category, r.product_name) for r in maintain.update(p, patch, blank_is_null=True).collect()}
    assert got[1] == (None, "New") and got[2] == ("mugs", "Blue mug")
    left = maintain.delete({"products": p, "features": f}, spark.createDataFrame([(2,)], "id long"))
    assert ids(left["products"]) == [1, 3, 4, 5] and ids(left["features"], "product_id") == [1]
    assert ids(maintain.of_categories(p, [""])) == [3] and ids(maintain.older_than(p, 3, NOW)) == [4, 5]
    more = maintain.load(p, p.filter("id = 5"), "replace", is_historical=False)
    assert ids(more) == [1, 2, 3, 4, 5]
    assert maintain.bulk_set(p, p.select("id"), category="").filter("category is null").count() == 5
    assert maintain.replace_features(f, spark.createDataFrame([(2, [5.0, 5.0])], "product_id long, embedding array<double>")).count() == 2


def test_snapshots(spark, tmp_path):
    p, f = products(spark), features(spark)
    store = snapshots.Snapshots(spark, str(tmp_path))
    assert store.list().count() == 0
    store.create("old", {"products": p, "features": f}, True, NOW, tags=("a",))
    store.create("new", {"products": p, "features": f}, False, NOW)
    with pytest.raises(Exception, match="EXISTS"):
        store.create("old", {"products": p}, True, NOW)
    assert ids(store.load("old")["products"]) == [1, 2, 3, 4] and store.load("old")["features"].count() == 3
    store.merge(["old", "new"], "both", True, NOW)
    both = store.load("both")
    assert ids(both["products"]) == [1, 2, 3, 4, 5] and both["products"].filter("not is_historical").count() == 0 and both["features"].count() == 2
    store.set_active(["old", "both"], [], NOW)
    assert store.active_union("historical").count() == 9
    assert {(r.category, r.n) for r in store.info("old").collect()} == {("mugs", 2), ("plates", 1), ("Uncategorized", 1), ("*", 4)}
    assert store.load_as_main("new", {"products": p, "features": f}, NOW)["products"].count() == 5
    assert store.list().count() == 4


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_csv_round_trip(spark, tmp_path, sep):
    names = ['Mug "large", red', "a;b", "tab\there", "Ünïcode", "N/A"]
    rows = spark.createDataFrame([(f"f{i}.jpg", "mugs", f"S-{i}", n, 1.5 * i, "2024-01-15:1.5", "[1,2]") for i, n in enumerate(names)], "filename string, category string, sku string, name string, price double, price_history string, performance_history string")
    out = csv.to_csv_columns(csv.typed(rows, F.lit(DAY)))
    csv.write(out.coalesce(1), f"{tmp_path}/x", sep)
    back = csv.clean(csv.read(spark, f"{tmp_path}/x"))
    got = {r.filename: r for r in back.collect()}
    assert len(got) == 5 and [got[f"f{i}.jpg"].name for i in range(4)] == names[:4] and got["f4.jpg"].name == ""
    assert [got[f"f{i}.jpg"].price for i in range(5)] == [0.0, 1.5, 3.0, 4.5, 6.0] and got["f0.jpg"].price_history == "2024-01-15:1.5"


def test_csv_dirty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿product_name,Product SKU,unit_price,image\r\n"Mug, red",A-1,$1.50,m.jpg\r\n,,,\r\nCup,null,free,m.jpg\r\n', encoding="utf-8")
    got = csv.clean(csv.read(spark, f"{tmp_path}/a.csv"))
    assert [(r.name, r.sku, r.price, r.price_error) for r in got.orderBy("row").collect()] == [("Mug, red", "A-1", 1.5, False), ("Cup", "", None, True)]
    assert [r.name for r in csv.last_by_filename(got).collect()] == ["Cup"]
    (tmp_path / "b.csv").write_text("m.jpg;mugs;A-1;Mug;2\n")
    assert csv.clean(csv.read(spark, f"{tmp_path}/b.csv")).select("filename", "sku", "price").first() == ("m.jpg", "A-1", 2.0)
    line = spark.createDataFrame([('m.jpg,"a ""b"", c",N/A',)], "x string").select(csv.split_line(F.col("x")).alias("y")).first().y
    assert line[:3] == ["m.jpg", 'a "b", c', ""]


def test_linking(spark):
    pics = spark.createDataFrame([("p1", "sku-1.jpg", "x"), ("p2", "photo_AB-12_front.png", "sku-1"), ("p3", "red_mug_large.jpg", None), ("p4", "zzz.jpg", None)], "path string, filename string, category string")
    rows = spark.createDataFrame([(0, "", "mugs", "SKU-1", "Red Mug", "2"), (1, "", "", "sku-1", "later", ""), (2, "", "", "AB-12", "Plate", "3")], "row long, filename string, category string, sku string, name string, price string")
    get = lambda df: sorted((r.path, r.row) for r in df.collect())
    assert get(link.by_filename(pics, rows)) == [("p1", 0)] and get(link.by_sku_in_filename(pics, rows)) == [("p1", 0), ("p2", 2)]
    assert get(link.by_folder(pics, rows)) == [("p2", 0)] and get(link.by_fuzzy_name(pics, rows)) == [("p3", 0)]
    done, lost, free = link.run(pics, rows, "filename_contains_sku")
    assert {r.path: (r.sku, r.linked) for r in done.collect()} == {"p1": ("SKU-1", True), "p2": ("AB-12", True), "p3": (None, False), "p4": (None, False)}
    assert sorted(r.path for r in lost.collect()) == ["p3", "p4"] and [r.row for r in free.collect()] == [1]


def test_ingest(spark):
    rows = spark.createDataFrame([(1, " sku-1 ", "<b>Mug</b>", " ", 2.5, "2024-01-15:2", "[1, 2]"), (2, "sku 2", "Cup", "mugs", None, None, None), (3, None, "Cup", "mugs", None, None, None)], "ref long, sku string, product_name string, category string, price double, price_history string, performance_history string")
    got = ingest.metadata_batch(rows, F.lit(DAY), True, reject_all=False)
    assert got["products"].select("sku", "product_name", "category").first() == ("SKU-1", "Mug", None)
    assert got["price_history"].count() == 2 and [str(r.date) for r in got["performance_history"].orderBy("date").collect()] == ["2024-05-16", "2024-06-15"]
    assert [r.error for r in got["quarantine"].orderBy("ref").collect()] == ["invalid sku", "sku is required"]
    assert ingest.metadata_batch(rows, F.lit(DAY), True)["products"].count() == 0


def test_descriptors():
    solid = np.full((60, 60, 3), [0, 0, 255], np.uint8)
    assert images.color_histogram(solid).max() == pytest.approx(1, abs=1e-6)
    square = np.zeros((60, 60), np.uint8)
    square[20:40, 20:40] = 255
    moved = np.roll(square, (5, -7), (0, 1))
    assert images.shape_moments(square) == pytest.approx(images.shape_moments(moved), abs=1e-3)
    assert 10 ** -images.shape_moments(square)[0] == pytest.approx(1 / 6 / 255, rel=0.01)
    h = images.texture_histogram(np.full((60, 60), 9, np.uint8))
    assert h.sum() == pytest.approx(1, abs=1e-5) and h[24] > 0.7


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(w, h):
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + b"\xff\0\0" * w for _ in range(h)))) + chunk(b"IEND", b"")

    for name, data in {"good.png": png(64, 64), "small.png": png(20, 64), "text.png": b"hello", "broken.png": png(64, 64)[:60]}.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(n,) for n in ("good.png", "small.png", "text.png", "broken.png", "gone.png")], "path string")
    codes = {r.path: r.error_code for r in images.audit(manifest, str(tmp_path)).collect()}
    assert codes == {"good.png": None, "small.png": "IMAGE_TOO_SMALL", "text.png": "UNSUPPORTED_FORMAT", "broken.png": "CORRUPTED_IMAGE", "gone.png": "MISSING_OR_EMPTY"}
    rows = images.describe(spark.read.format("image").load(str(tmp_path / "good.png"))).collect()
    assert len(rows[0].color) == 256 and len(rows[0].shape) == 7 and len(rows[0].texture) == 256


def test_embedding_with_supplied_encoder(spark):
    def make():
        def predict(values):
            return np.stack([[len(v), 0.0] for v in values]).astype(np.float32)

        return predict

    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "x")], "product_id long, content string")
    got = {r.product_id: (r.embedding, r.error_code) for r in images.embed(rows, make, done=rows.filter("product_id = 4")).collect()}
    assert got == {1: ([1.0, 0.0], None), 2: (None, "ENCODER_FAILED"), 3: (None, "MISSING_OR_EMPTY")}


def test_stream(spark, tmp_path):
    p = products(spark)
    p.filter("not is_historical").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    match_arrivals(stream, lambda: p.filter("is_historical"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
