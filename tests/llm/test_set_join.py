import random

import pytest

from skuweave.llm import queries as Q
from skuweave.llm import set_join

from .brute import components, shingles

SF = "/root/testdata/sf0.001"


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sets = {r.doc_id: shingles(r.text) for r in docs}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op6_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "share", "most_sets", "most_tokens"), [(3, 90, None, 4096, 2_000_000), (5, 80, None, 4096, 2_000_000), (2, 60, 0.1, 4, 2_000_000), (1, 50, 1.0, 4096, 60), (3, 90, 0.05, 3, 500)])
def test_near_copies_match_brute_force(spark, k, percent, share, most_sets, most_tokens):
    rnd = random.Random(f"{k}{percent}")
    words = ["of", "the", "and", *(f"w{i}" for i in range(300))]
    docs = [(0, None), (1, ""), (2, " \n "), (3, "a b"), (4, "A  b"), (5, "a"), (6, "É é"), (7, "é É")]
    common = [rnd.choice(words) for _ in range(25)]
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([9, 15, 40, 90, 200]))] + common * (g % 2)
        for _ in range(rnd.choice([1, 3, 14])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 8])):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice([[], [rnd.choice(words)], [rnd.choice(words), "x"]])
                w = w or ["z"]
            docs.append((len(docs), " ".join(w).upper() if rnd.random() < 0.2 else "\t".join(w)))
    frame = spark.createDataFrame([(*d, d[0]) for d in docs], "doc_id long, text string, n long")
    sets = {i: shingles(t, k) for i, t in docs}
    want = components(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.join(frame, k, percent, share, most_sets, most_tokens).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_null_and_repeated_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text + " x"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in set_join.join(frame, 3, 90).collect())))
    assert got == sorted(map(str, [(None, None), (5, 5), (5, 5), (9, 5), (None, None)]))
    assert set_join.join(frame.filter("doc_id = 1")).count() == 0
