"""Nulls, long texts, repeated rows, empty tables and clashing column names, for operators whose own tests lack them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skuweave.llm import common, decontaminate, exact_dedup, language_id, mixing, set_join
from skuweave.llm.queries import curriculum

from .brute import components, shingles

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} und" for i in range(150_000))


def test_running_sums_and_maxima(spark):
    rnd = random.Random(1)
    lists = [[], [5], [rnd.randrange(-9, 9) for _ in range(7)], [rnd.randrange(-9, 9) for _ in range(2000)]]
    df = spark.createDataFrame([(x,) for x in lists], "x array<bigint>").select("x", common.running(F.col("x")).alias("s"), common.running(F.col("x"), highest=True).alias("m"))
    for r in df.collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))] and r.m == [max([0, *r.x[:i]]) for i in range(len(r.x))]


def test_mixing(spark):
    rows = [(1, LONG, "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (4, "two words", None, "x"), (4, "two words", None, "x"), (None, "one", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").selectExpr("*", "1 as copy", "2 as rank", "3 as bucket", "4 as h", "5 as _order")
    got = {(r.doc_id, r.size): r for r in mixing.in_training_order(mixing.assign(docs, curriculum)).collect()}
    assert got[1, 300_000].taken > 0 and got[2, 0].taken == 0 and got[2, 0].position is None and sum(r.taken for r in got.values()) >= 299_000
    mixed = mixing.mix(docs, curriculum)
    assert set(docs.columns) <= set(mixed.columns) and {r.size for r in mixed.collect()} == {"x"}
    assert mixing.mix(docs.filter("doc_id = 99"), curriculum).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "word3 und word4 und word5 und word6 und word7 und")], "item_id long, text string")
    docs = spark.createDataFrame([(1, LONG, "x"), (2, None, "y")], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in decontaminate.scan(docs, items).select("doc_id", "n_words", decontaminate.hit_words().alias("hit")).collect()}
    assert (got[1].n_words, got[1].hit) == (300_000, 10 * (150_000 // 977 + 1)) and (got[2].n_words, got[2].hit) == (0, 0)
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert {r.n_words for r in decontaminate.scan(docs, items.limit(0)).collect()} == {300_000, 0}


def test_language(spark):
    docs = spark.createDataFrame([(1, LONG, "de"), (2, "the cat and the dog", "en"), (3, None, "en"), (4, "12 !", None), (4, LONG, "de")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language_id.predict(docs, language_id.learn(docs)).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got) == Counter([(1, "de"), (2, "en"), (3, "und"), (4, "und"), (4, "de")])
    assert language_id.predict(docs.limit(0), language_id.learn(docs.limit(0))).count() == 0


def test_exact_dedup_keeps_clashing_columns(spark):
    rows = [(1, "A b", "p"), (2, "a B", "q"), (2, "a b", "r"), (None, "a b", "s"), (5, None, "t"), (6, "", "u"), (7, LONG, "v"), (8, LONG.upper(), "w"), (9, "only", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string").selectExpr("*", "1 as digest", "2 as rep", "3 as kept", "4 as _0", "5 as row", "6 as _there")
    index = exact_dedup.DigestIndex(spark)
    got = exact_dedup.kept_rows(docs, index)
    assert got.columns == docs.columns and [(r.doc_id, r.text) for r in got.orderBy("doc_id").collect()][1:] == [(6, ""), (8, LONG.upper()), (9, "only")]
    index.compact()
    again = exact_dedup.dedup(docs.filter("doc_id = 9").unionByName(docs.filter("doc_id = 9").withColumn("text", F.lit("new"))), index).collect()
    assert {(r.kept, r.keep_id) for r in again} == {(False, 9), (True, 9)} and index.rows().count() == 5
    index.drop()


def test_set_join_with_repeated_ids(spark):
    rows = [(1, "a b c d e f g"), (2, "x y z"), (2, "a b c d e f g"), (3, "x y z"), (4, None), (None, "x y z"), (7, LONG), (8, LONG + " end"), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit(1), "n": F.lit("x"), "tokens": F.lit(2)})
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in set_join.join(docs, k=3, percent=90).collect())
    n = len(shingles(LONG))
    assert got == Counter([(1, 5, 1), (2, 1, 2), (2, 1, 2), (3, 1, 2), (3, 1, 2), (4, 0, 4), (None, 1, None), (7, n, 7), (8, n + 1, 7)])
    assert set_join.join(docs.limit(0)).count() == 0
    assert components({1: {1}, 2: {1}}) == {1: 1, 2: 1}


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_of_the_pipeline(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(P.STAGES)[name]
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and set(docs.columns) <= set(empty.columns)
    some = docs.limit(20).unionByName(docs.limit(20).withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    some = common.written(some.unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).withColumns({"rep": F.lit(1), "kept": F.lit(2), "spans": F.lit("x"), "score": F.lit(3)}), "some")
    got = stage(spark, some, SF)
    assert set(some.columns) - {"spans"} <= set(got.columns) and got.count() > 0


def test_written_folders_can_be_removed(spark):
    path = common.written(spark.range(3), "some").inputFiles()[0]
    assert common.remove_written(spark) >= 1 and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
