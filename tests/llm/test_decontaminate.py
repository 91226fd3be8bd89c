import random

import pytest

from skuweave.llm import decontaminate as D
from skuweave.llm import queries as Q

from .brute import sha, windows

SF = "/root/testdata/sf0.001"


def test_query_matches_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: windows(r.text, items) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in Q.op2_decontaminate(spark, SF).collect()}
    assert got == {i: (n, h, len(ids), sha(",".join(ids)), h > 0) for i, (n, h, ids) in docs.items()}
    assert sum(h > 0 for _, h, _ in docs.values()) > 0


@pytest.mark.parametrize("shard_words", [100_000, 30])
def test_small_alphabet_against_brute_force(spark, shard_words):
    """Few words make many overlapping and nested windows; items shorter than a window are windows as a whole."""
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice("a b c É".split()) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 3, 4, 5, 7, 12]))) for i in range(12)] + [(3, "b b b b"), (50, None), (51, "!!"), (52, "")]
    docs = [(i, say(rnd.choice([0, 1, 3, 6, 30, 80]))) for i in range(40)] + [(40, None), (41, "A.b,C! a b c"), (40, "a b")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r.item_ids)) for r in D.scan(frame, bench, 4, shard_words).collect())
    assert got == sorted((i, *windows(t, items, 4)) for i, t in docs)


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = [(1, f"Before it, {passage.title()}! And é after it" + " more" * 20), (2, passage), (3, "clean   text."), (4, None), (5, "")]
    frame = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in D.decontaminate(frame, bench).collect()}
    left = "Before it, ! And é after it" + " more" * 20
    assert got == {1: (left, len(left)), 3: ("clean   text.", 13), 4: (None, 0), 5: ("", 0)}


def test_no_items_and_empty_table(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.scan(docs, none).first().spans == [] and D.scan(docs.filter("doc_id = 2"), none).count() == 0
