import random

from pyspark.sql import functions as F

from skuweave.operators.search_index import FIELDS, SearchIndex
from skuweave.shared import new_path

SCHEMA = "id long, product_name string, sku string, category string, extra long"


def test_searches_equal_scans(spark):
    rnd = random.Random(5)
    words = ["Red", "red", "mug", "Plate", "of", "É", "té", "a%b", "x_y", "SKU-1", "", "blue-ish", "🙂🙂🙂"]
    text = lambda: rnd.choice([None, " ".join(rnd.choices(words, k=rnd.randrange(5)))])
    first = {i: (text(), text(), text(), i) for i in [*range(200), *range(65_500, 65_600), 10**12, 10**12 + 1]}
    changed = {i: (text(), text(), text(), -i) for i in range(0, 200, 3)}
    index = SearchIndex(spark, new_path(spark, "search"), 3)
    rows = lambda d: spark.createDataFrame([(i, *r) for i, r in d.items()], SCHEMA)
    index.append(rows(first), 1)
    index.append(rows(changed), 2)
    index.append(rows(changed), 2)  # once more, after a failure
    index.remove(spark.createDataFrame([(i,) for i in range(5, 50)], "id long"), 3)
    now = {i: r for i, r in {**first, **changed}.items() if not 5 <= i < 50}
    for term in ("RED", "red mug", "re", "é té", "a%b", "x_y", "SKU-1", "zzz", "🙂🙂🙂", "plate of", "late", "d m", ""):
        for fields in (FIELDS, ["sku"]):
            want = {i for i, r in now.items() if any((x or "").lower().find(term.lower()) >= 0 and x is not None for x in (r[FIELDS.index(f)] for f in fields))}
            got = {r.id: r.extra for r in index.hits(term, tuple(fields)).collect()}
            assert got == {i: now[i][3] for i in want}, term


def test_only_few_files_are_read(spark):
    df = spark.range(0, 300_000, 7).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("product_name"), F.lit(None).cast("string").alias("sku"), F.lit("mugs").alias("category"))
    index = SearchIndex(spark, new_path(spark, "search"), 8)
    index.append(df, 1)
    assert [r.id for r in index.hits("name 140007").collect()] == [140_007]
    assert [r.id for r in index.candidates("name 140007", FIELDS).collect()].count(140_007) == 1
    plan = index.hits("name 140007")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_block") >= 1 or "_block" in plan.split("PartitionFilters")[1][:80]
    found = index._postings(["140", "name"[:3]])
    assert all("part=" in f for f in found.inputFiles()) and "PushedFilters: [In(gram" in found._jdf.queryExecution().executedPlan().toString()
