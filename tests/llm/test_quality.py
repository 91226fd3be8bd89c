import math
import random
from collections import Counter, defaultdict

import pytest

from skuweave.llm import quality as K
from skuweave.llm import queries as Q

SF = "/root/testdata/sf0.01"


class Plain:
    """The same model, from its definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.tables, self.d = order, {}, {}
        top = Counter()
        for t in texts:
            s = K.START * (order - 1) + K.normal(t) + K.END
            top.update(s[i : i + order] for i in range(len(s) - order + 1))
        self.tables[order] = top
        for k in range(order - 1, 0, -1):
            self.tables[k] = Counter(g[1:] for g in self.tables[k + 1] if not g.endswith(K.START))
        for k, t in self.tables.items():
            n = [sum(c == i for c in t.values()) for i in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]] if all(n) else [0.5, 1.0, 1.5]
            self.d[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)] if all(n) else d
        self.sums = {k: defaultdict(lambda: [0, 0.0]) for k in self.tables}
        for k, t in self.tables.items():
            for g, c in t.items():
                self.sums[k][g[:-1]][0] += c
                self.sums[k][g[:-1]][1] += self.d[k][min(c, 3) - 1]

    def p(self, g):
        k = len(g)
        low = self.p(g[1:]) if k > 1 else 1 / (len(self.tables[1]) + 1)
        if g[:-1] not in self.sums[k]:
            return low
        total, cut = self.sums[k][g[:-1]]
        c = self.tables[k].get(g, 0)
        return (max(c - self.d[k][min(c, 3) - 1], 0) if c else 0) / total + cut / total * low

    def nll(self, t):
        s = K.START * (self.order - 1) + K.normal(t) + K.END
        return -sum(math.log(self.p(s[i : i + self.order])) for i in range(len(s) - self.order + 1))


@pytest.mark.parametrize(("shards", "chunk_chars"), [(1, 1_000_000), (5, 60)])
def test_scores_match_the_definition(spark, shards, chunk_chars):
    rnd = random.Random(2)
    say = lambda n: "".join(rnd.choice("aabbc d é") for _ in range(n))
    trusted = [say(rnd.randrange(1, 90)) for _ in range(40)]
    texts = trusted[:5] + [say(30) for _ in range(10)]
    model = K.train(spark.createDataFrame([(t,) for t in trusted], "text string"), 3)
    plain = Plain(trusted, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, " \n", ""])], "doc_id int, text string, nll string")
    got = {r.doc_id: r for r in K.score(docs, model, 3, shards, chunk_chars).collect()}
    for i, t in enumerate(texts):
        assert got[i].nll == pytest.approx(plain.nll(t), rel=1e-4) and got[i].n_scored == len(K.normal(t)) + 1
    assert [(got[i].nll, got[i].n_scored) for i in range(15, 18)] == [(0, 0)] * 3
    odd = next(iter(K.score(docs.limit(1).selectExpr("1 as doc_id", "'zzz' as text"), model, 3).collect()))
    assert math.isfinite(odd.nll) and odd.nll > 4


def test_query_separates_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    rows = Q.op8_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    passed = {q: [r.passes for r in rows if labels.get(r.doc_id) == q] for q in (0, 1)}
    assert sum(passed[1]) / len(passed[1]) > 0.99 and sum(passed[0]) / len(passed[0]) < 0.2


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text here", "en"), (2, None, "en"), (2, "", None), (None, "other", "xx")], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert K.classify(docs, ids).count() == 4 and all(r.passes for r in K.classify(docs, ids.filter("doc_id = 9")).collect())
    assert K.classify(docs.filter("doc_id = 9"), ids).count() == 0


def test_no_shard_is_hot_and_each_row_of_the_model_is_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = K.train(docs, 5)
    shards = 8
    rows = K.tables(model, 5, shards).groupBy("shard").count().collect()
    assert len(rows) == shards and max(r["count"] for r in rows) <= 2 * sum(r["count"] for r in rows) / shards
    whole = model[0].count() + model[1].filter("gram <> ''").count()
    assert sum(r["count"] for r in rows) <= 1.2 * whole
    plans = [K._score(d, model, 5, shards, 100_000, "text")[0]._jdf.queryExecution().optimizedPlan().toString() for d in (docs, docs.unionByName(docs))]
    assert all(p.count("Generate explode") == 1 for p in plans)  # only what is in every shard is copied
