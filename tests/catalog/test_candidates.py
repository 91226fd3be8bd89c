"""Candidate pairs against all pairs."""

import random

from pyspark.sql import functions as F

from skuweave.functions import text as T
from skuweave.operators import link, match
from skuweave.sources import csv


def test_fuzzy_names_against_all_pairs(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["red", "redmug", "mug", "mugs", "blue", "large", "a", "x1", "plate", "sea", "of", "b", "bigbigbigword", "12"])
    say = lambda: " ".join(word() for _ in range(rnd.choice([1, 1, 2, 3, 5])))
    images = spark.createDataFrame([(str(i), say() + ".jpg", None) for i in range(150)], "path string, filename string, category string")
    rows = spark.createDataFrame([(i, say()) for i in range(120)], "row long, name string")
    a, b = T.fuzzy_text(T.without_extension(F.col("filename"))), T.fuzzy_text(F.col("name"))
    for least in (0.3, 0.5, 0.9):
        every = images.select("path", a.alias("a")).filter(F.char_length("a") >= 2).crossJoin(rows.select("row", b.alias("b"))).withColumn("score", T.fuzzy_score(F.col("a"), F.col("b"))).filter(F.col("score") >= least)
        best = every.groupBy("path").agg(F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row"))).alias("m"))
        want = {(r.path, r.m.row, round(r.m.score, 9)) for r in best.collect()}
        assert {(r.path, r.row, round(r.score, 9)) for r in link.by_fuzzy_name(images, rows, least).collect()} == want


def test_nearest_categories_against_all_pairs(spark):
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice("abc-") for _ in range(rnd.randrange(1, 9)))
    known, asked = {text() for _ in range(60)}, {text() for _ in range(150)}
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(sorted(asked))], "id int, category string")
    got = {r.id: (r.category, r.category_warning) for r in match.resolve_categories(rows, spark.createDataFrame([(c,) for c in known], "category string")).collect()}
    near = rows.crossJoin(spark.createDataFrame([(c,) for c in known], "stored string")).withColumn("far", F.levenshtein(T.compact(F.col("category")), T.compact(F.col("stored"))))
    want = {}
    for r in near.filter("far <= 2").collect():
        want.setdefault(r.id, []).append((r.category != r.stored, r.far, r.stored))
    for i, c in enumerate(sorted(asked)):
        best = min(want[i]) if i in want else None
        assert got[i] == ((best[2], f"corrected from {c}" if best[0] else None) if best else (c, None)), c


def test_csv_files_of_several_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename,category,sku\na1.jpg,mugs,A-1\na2.jpg,mugs,A-2\n")
    (tmp_path / "b.csv").write_text("filename,category,sku\nb1.jpg,cups,B-1\n")
    (tmp_path / "c.tsv").write_text("SKU\tProduct Name\tFile\nC-1\tCup\tc1.jpg\n")
    (tmp_path / "d.csv").write_text("\nd1.jpg;mugs;D-1;Mug;2\nd2.jpg;mugs;D-2;Mug;3\n")
    (tmp_path / "e.csv").write_text("")
    got = csv.read(spark, str(tmp_path)).filter("filename is not null").orderBy("row").collect()
    assert [(r.filename, r.sku) for r in got] == [("a1.jpg", "A-1"), ("a2.jpg", "A-2"), ("b1.jpg", "B-1"), ("c1.jpg", "C-1"), ("d1.jpg", "D-1"), ("d2.jpg", "D-2")]
    assert got[3].name == "Cup" and got[5].price == "3"
    (tmp_path / "big.csv").write_text("filename,name\n" + "".join(f"f{i}.jpg,n{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = csv.read(spark, str(tmp_path / "big.csv"))
        assert rows.rdd.getNumPartitions() > 3 and [r.filename for r in rows.orderBy("row").collect()] == [f"f{i}.jpg" for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
