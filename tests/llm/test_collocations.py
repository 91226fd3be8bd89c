import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuweave.llm import collocations as C

from .brute import low


def brute(rows, threshold, top=2000, longest=5):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i : i + n])] += 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= threshold:
            scores = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(scores)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score)
    out = []
    for lang in totals:
        kept = []
        for (x, p), row in found.items():
            if x == lang and not any(y == lang and len(q) > len(p) and 100 * r[0] >= 100 * row[0] and any(q[i : i + len(p)] == p for i in range(len(q))) for (y, q), r in found.items()):
                kept.append((" ".join(p), *row))
        kept.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(kept[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(C, "HELD", 500)  # many summaries
    words = ["the", "The", "new", "york", "çà", "a\x00b", "of", "in", *(f"w{i}" for i in range(40))]
    gaps = [" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", " ;", "!"]
    text = lambda n: "".join(x for _ in range(n) for x in (rnd.choices(words, [9, 3, 5, 5, 4, 3, 9, 9, *[1] * 40])[0], rnd.choice(gaps)))
    rows = [(rnd.choice(["en", "en", "a language of long name 1", "a language of long name 2", None, "und"]), text(rnd.randrange(120))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("en", text(20_000)), *[("en", "the same passage of a few words here. And this")] * 20]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit(1), "size": F.lit(2), "f": F.lit(3)})
    got = sorted(tuple(r) for r in C.collocations(df, threshold=8, top=60).collect())
    assert got == brute(rows, 8, 60)


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in C.collocations(docs, threshold=30).collect())
    assert got == brute([(r.lang, r.text) for r in docs.collect()], 30) and got


def test_packing_is_reversible():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5000):
        keys, counts = C.counted(rnd.integers(0, 2**63, n).astype(np.uint64), rnd.integers(1, 10**12, n))
        a, b = C.unpack(C.pack(keys, counts))
        assert (a == keys).all() and (b == counts).all() and len(a) == len(keys)


def test_summaries_keep_what_is_frequent_in_any_order_of_merging():
    rnd = np.random.default_rng(2)
    stream = np.concatenate([np.repeat(np.arange(50, dtype=np.uint64), 100), rnd.integers(1000, 2**60, 60_000).astype(np.uint64)])
    rnd.shuffle(stream)
    capacity, parts = 2 * len(stream) // 100, []
    for piece in np.array_split(stream, 7):
        parts.append(C.Summary(capacity))
        for some in np.array_split(piece, 20):
            parts[-1].add(*C.counted(some))
            parts[-1].settle()
    while len(parts) > 1:
        parts[0].merge(parts.pop(rnd.integers(1, len(parts))))
    assert set(range(50)) <= set(parts[0].frequent(100).tolist()) and len(parts[0].keys) <= capacity
    assert parts[0].mass == len(stream) and 0 < parts[0].error < 100
    small = C.Summary(10)
    small.add(*C.counted(stream))
    with pytest.raises(ValueError):
        small.frequent(100)
