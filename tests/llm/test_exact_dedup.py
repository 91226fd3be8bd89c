from skuweave.llm import exact_dedup as E
from skuweave.llm import queries as Q

from .brute import low, sha

SF = "/root/testdata/sf0.001"


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, low(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    groups = {}
    for i, t in docs:
        groups.setdefault(t, []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in Q.op10_exact_dedup(spark, SF).collect()}
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), sha(t)) for i, t in docs}


def test_nulls_ties_and_hot_groups(spark):
    rows = [(1, None), (2, ""), (None, "A"), (None, "a"), (5, "É"), (6, "é"), (7, "ÀA"), (8, "Àa"), (9, "x"), (9, "X")] + [(100 + i, "hot") for i in range(3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    index = E.DigestIndex(spark)
    got = E.dedup(docs, index).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == index.rows().count() == 7
    kept = {r.text_sha256: r.doc_id for r in got if r.kept}
    assert kept == {sha(""): 2, sha("a"): None, sha("É"): 5, sha("é"): 6, sha("Àa"): 8, sha("x"): 9, sha("hot"): 3099}
    assert E.kept_rows(docs, E.DigestIndex(spark)).count() == 7


def test_index_persists_across_batches(spark):
    index = E.DigestIndex(spark, buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert E.dedup(frame([(1, "a"), (2, "b"), (3, "A")]), index).filter("kept").count() == 2
    later = {r.doc_id: (r.keep_id, r.kept) for r in E.dedup(frame([(9, "a"), (10, "c"), (11, "C")]), index).collect()}
    assert later == {9: (3, False), 10: (11, False), 11: (11, True)}
    assert index.rows().count() == 3 and E.dedup(frame([]), index).count() == 0
    plan = spark.sql(f"describe extended {index.table}").collect()
    assert {r.col_name.strip(): r.data_type for r in plan}["Num Buckets"] == "3"


def test_batches_meet_the_index_by_an_anti_join(spark, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(None, "text 0"), (None, None), (50, "only"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, append = [], E.DigestIndex.append

    def seen(self, groups):
        if (known := self.rows()) is not None:
            plans.append(groups.join(known.select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString())
        return append(self, groups)

    monkeypatch.setattr(E.DigestIndex, "append", seen)
    for n in (1, 2, 4):
        index = E.DigestIndex(spark)
        key = lambda r: (r[4], r[0] is None, r[0])
        got = sorted((tuple(r) for r in E.dedup_in_batches(docs, index, n).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=key)
        want = sorted((tuple(r) for r in E.dedup(docs, E.DigestIndex(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=key)
        assert got == want and index.rows().count() == 9
        index.drop()
        assert index.rows() is None
    assert len(plans) == 4 and all("SortMergeJoin" in p and "LeftAnti" in p for p in plans)
    assert E.dedup_in_batches(docs.limit(0), E.DigestIndex(spark)).count() == 0
