"""What a search index costs is dealt to all tasks, and a ranked search groups the histories of its hits alone."""

from pyspark.sql import functions as F

from skuweave.operators import histories, reports
from skuweave.operators.search_index import SearchIndex
from skuweave.plans.catalog import Catalog
from skuweave.shared import new_path


def test_products_of_one_file_are_cut_by_many_tasks(spark):
    df = spark.range(0, 60_000, 1, 1).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("product_name"), F.lit(None).cast("string").alias("sku"), F.lit("mugs").alias("category"))
    index = SearchIndex(spark, new_path(spark, "search"), 2)
    rows = index.postings(df)
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString().split("Generate")[-1]  # below the cut into trigrams
    lists = {(r.gram, r.block): r for r in rows.filter("gram in ('nam', ' 77')").collect()}
    assert lists["nam", 0].ids == list(range(60_000)) and lists["nam", 0].n == 60_000
    assert lists[" 77", 0].ids == [i for i in range(60_000) if str(i).startswith("77")]


def test_ranked_search_groups_the_histories_of_its_hits(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    got = reports.ranked_search(c.products, histories.latest_prices(c.price_history), "ring", limit=7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.rindex("Aggregate")
    hits = sorted(c.products.collect(), key=lambda r: (0 if "ring" in r.product_name.lower() else 1 if "ring" in (r.sku or "").lower() else 2 if "ring" in (r.category or "").lower() else 3, r.product_name, r.id))[:7]
    prices = {r.product_id: r.price for r in histories.latest_prices(c.price_history).collect()}
    assert {r.id: r.price for r in got.collect()} == {r.id: prices.get(r.id) for r in hits}
