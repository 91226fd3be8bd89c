import random

import numpy as np

from skuweave.llm import queries as Q
from skuweave.llm import suffix_dedup as S

from .brute import WORDS, low

SF = "/root/testdata/sf0.001"


def covered(docs, n=50):
    """For each document the words inside windows of n words that occur more than once."""
    seen = {}
    for i, t in docs:
        w = WORDS.findall(low(t))
        for a in range(len(w) - n + 1):
            seen.setdefault(tuple(w[a : a + n]), []).append((i, a))
    out = {}
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                out.setdefault(i, set()).update(range(a, a + n))
    return out


def test_planted_passages(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(900))
    say = lambda n: [word() for _ in range(n)]
    passages = [say(n) for n in (51, 55, 60, 75, 90, 200, 49, 30)]
    docs = []
    for i in range(160):
        w = say(rnd.choice([0, 5, 80, 300]))
        if i % 3:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passages[i % len(passages)]
        docs.append((i, ", ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(200 + i, " ".join(passages[5] + say(3))) for i in range(60)] + [(300, None), (301, "")]
    want = covered(docs)
    frame = spark.createDataFrame([(*d, 1) for d in docs] + [(None, "x " * 60, 1)], "doc_id long, text string, spans int")
    for most in (2000, 20):
        got = {r.doc_id: r for r in S.repeats(frame, most=most).collect()}
        assert set(got) == set(want)
        for i, r in got.items():
            mine = {k for s in r.spans for k in range(s.start, s.end)}
            assert r.n_repeated == len(mine) and mine == want[i]
    assert S.repeats(frame.filter("doc_id < 0")).count() == 0


def classes(docs, n=50):
    """The smallest document that shared windows of n words connect each with."""
    root, seen = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, t in docs:
        w = WORDS.findall(low(t))
        for a in range(len(w) - n + 1):
            p, q = find(i), find(seen.setdefault(tuple(w[a : a + n]), i))
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def exact(spark, texts, most):
    """Compares spans and classes with brute force."""
    want, of = covered(texts), classes(texts)
    got = {r.doc_id: r for r in S.repeats(spark.createDataFrame(texts, "doc_id long, text string"), most=most).collect()}
    assert {i: {k for s in r.spans for k in range(s.start, s.end)} for i, r in got.items()} == want
    assert {i: r.class_id for i, r in got.items()} == {i: of[i] for i in want}
    return want


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, of = covered(docs), classes(docs)
    for r in Q.op4_suffix_dedup(spark, SF).collect():
        mine = {k for s in filter(None, r.spans.split(",")) for k in range(*map(int, s.split("-")))}
        assert mine == want.get(r.doc_id, set()) and r.n_repeated == len(mine) and r.class_id == of.get(r.doc_id, r.doc_id)


def test_long_text_repeated_ids_and_clashing_columns(spark):
    rnd = random.Random(5)
    line = " ".join(f"w{rnd.randrange(900)}" for _ in range(60))
    texts = [(1, f"{line} " * 2000, "a"), (2, line, "b"), (3, "aa", "c"), (3, line, "d"), (4, "one two", None)]
    got = {r.doc_id: r for r in S.repeats(spark.createDataFrame(texts, "doc_id long, text string, key string"), most=50).collect()}
    assert {i: (r.n_repeated, r.class_id, len(r.spans)) for i, r in got.items()} == {1: (120_000, 1, 1), 2: (60, 1, 1), 3: (60, 1, 1)}


def test_frequent_passages_in_differing_contexts(spark):
    rnd = random.Random(8)
    say = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(90_000)}" for _ in range(n)]
    texts = []
    for n in (50, 51, 52, 55, 60, 73):
        for _ in range(4):
            passage = say(n)
            texts += [(len(texts) + i, " ".join(say(40) + passage + say(40))) for i in range(30)]
    assert len(exact(spark, texts, most=20)) == len(texts)


def test_boilerplate_with_varying_prefixes(spark):
    rnd = random.Random(9)
    say = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(90_000)}" for _ in range(n)]
    texts, pairs = [], 0
    for n in (10, 15, 20, 23):
        for _ in range(4):
            boilerplate, prefixes = say(50 - n), [say(n) for _ in range(6)]
            some = [(prefix, 2) for prefix in prefixes] + [(say(n), 1) for _ in range(25)]
            for prefix, times in some:
                texts += [(len(texts) + i, " ".join(say(30) + prefix + boilerplate + say(30))) for i in range(times)]
            pairs += 12
    rnd.shuffle(texts)
    assert len(exact(spark, texts, most=2000)) == pairs


def test_minimisers_follow_content():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 400, np.uint64)
    moved = np.concatenate([rng.integers(0, 2**63, 37, np.uint64), words])
    a, b = S.minimisers(words, 8, 24), S.minimisers(moved, 8, 24)
    assert set(a[a >= 24] + 37) <= set(b) and np.diff(a).max() <= 24
    assert (S._fold(words, 7)[5] == S._fold(words[5:12], 7)).all()
