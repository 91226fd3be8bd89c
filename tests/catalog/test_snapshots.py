import datetime

import pytest
from pyspark.sql import functions as F

from skuweave.shared import new_path
from skuweave.sources.snapshots import Snapshots

NOW = datetime.datetime(2024, 6, 15, 12)


def catalog(spark, ids, side=True):
    products = spark.createDataFrame([(i, f"SKU-{i}", "mugs", side) for i in ids], "id long, sku string, category string, is_historical boolean")
    prices = products.select(F.col("id").alias("product_id"), (F.col("id") * 1.5).alias("price"))
    features = products.select(F.col("id").alias("product_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    return {"products": products, "price_history": prices, "features": features}


def test_a_run_that_died_can_be_repeated(spark):
    store = Snapshots(spark, new_path(spark, "snapshots"))
    broken = catalog(spark, [1, 2])
    broken["price_history"] = broken["price_history"].withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.create("a", broken, True, NOW)
    assert store.list().count() == 0
    store.create("a", catalog(spark, [1, 2]), True, NOW)
    assert store.load("a")["price_history"].count() == 2 and store.vacuum() >= 2 and store.vacuum() == 0  # what the dead run had written
    with pytest.raises(ValueError, match="exists"):
        store.create("a", catalog(spark, [3]), True, NOW)
    assert {store.save_before(catalog(spark, [1]), True, NOW) for _ in range(3)} == {"auto_20240615_120000", "auto_20240615_120000_2", "auto_20240615_120000_3"}


def test_of_two_runs_that_create_a_name_one_wins(spark):
    path = new_path(spark, "snapshots")
    one, two = Snapshots(spark, path), Snapshots(spark, path)
    two._live_, two._live = two._live, dict  # it looked before the other had committed
    one.create("a", catalog(spark, [1]), True, NOW)
    folders = {"products": two._put("products", catalog(spark, [2])["products"])}
    two._live = two._live_
    with pytest.raises(ValueError, match="another run"):
        two._commit(("a", NOW, "1.0", "", True, [], NOW), folders)
    assert [r.id for r in two.load("a")["products"].collect()] == [1]


def test_unchanged_tables_are_shared(spark):
    store = Snapshots(spark, new_path(spark, "snapshots"))
    store.create("a", catalog(spark, [1, 2, 3]), True, NOW)
    store.create("b", catalog(spark, [2, 9]), True, NOW)
    store.derive("a2", "a", {"products": store.load("a")["products"].withColumn("category", F.lit("cups"))}, NOW)
    assert store.files("a2")["features"] == store.files("a")["features"] and store.files("a2")["products"] != store.files("a")["products"]
    store.merge(["a", "b"], "both", True, NOW)
    for table in ("products", "price_history", "features"):
        assert store.files("a")[table][0] in store.files("both")[table] and store.files("b")[table][0] not in store.files("both")[table]
    got = store.load("both")
    assert sorted((r.id, r.sku) for r in got["products"].collect()) == [(1, "SKU-1"), (2, "SKU-2"), (3, "SKU-3"), (4, "SKU-2"), (5, "SKU-9")]
    assert sorted((r.product_id, r.price) for r in got["price_history"].collect()) == [(1, 1.5), (2, 3.0), (3, 4.5), (4, 3.0), (5, 13.5)]
    store.merge(["b", "a"], "other", True, NOW)  # ids 2 and 9 change, so nothing is shared
    assert not set(store.files("other")["products"]) & set(store.files("b")["products"])
    store.merge(["a", "b"], "new", False, NOW)  # the side changes
    assert not set(store.files("new")["products"]) & set(store.files("a")["products"])
    store.remove("a", NOW)
    assert store.vacuum() == 0 or store.load("both")["products"].count() == 5  # what others share stays
    assert store.load("a2")["features"].count() == 3 and "a" not in {r.name for r in store.list().collect()}


def test_active_snapshots(spark):
    store = Snapshots(spark, new_path(spark, "snapshots"))
    assert store.active().count() == 0
    for name in ("a", "b"):
        store.create(name, catalog(spark, [1, 2]), True, NOW)
    store.set_active(["a"], [], NOW)
    store.set_active(["a", "b"], [], NOW)
    assert store.active_union("historical").count() == 4
    store.set_active([], [], NOW)
    assert store.active().count() == 0
