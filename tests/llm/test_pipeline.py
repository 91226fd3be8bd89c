import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from skuweave.llm.common import written

from .brute import BLANKS, components, low, shingles, windows

SF = "/root/testdata/sf0.001"


def test_each_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        got = docs.collect()
        if name == "language":
            want = {i: r.text for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "exact_dedup":
            best = {}
            for i, r in sorted(rows.items()):
                best[low(r.text)] = i
            want = {i: rows[i].text for i in best.values()}
        elif name == "near_dedup":
            root = components({i: shingles(r.text, 5) for i, r in rows.items()}, 80)
            want = {i: r.text for i, r in rows.items() if root[i] == i}
        elif name == "decontaminate":
            hits = {i: windows(r.text, items) for i, r in rows.items()}
            want = {i: r.text for i, r in rows.items() if hits[i][1] == 0}
            cut = {i for i, (n, h, _) in hits.items() if 0 < h <= n / 2}
            assert {r.doc_id for r in got} == set(want) | cut
            assert all(windows(r.text, items)[1] == 0 or r.doc_id in cut for r in got)
            assert all(r.n_chars == len(r.text) < len(rows[r.doc_id].text) for r in got if r.doc_id in cut)
            got, shown = [r for r in got if r.doc_id not in cut], got
        if name != "mix":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in got} == want
            rows = {r.doc_id: r for r in (shown if name == "decontaminate" else got)}
    size = {i: len(BLANKS.findall(r.text)) for i, r in rows.items()}
    assert abs(sum(r.words for r in got) - sum(size.values())) <= 20
    assert all(0 < r.words <= size[r.doc_id] and 0 <= r.position <= 1 and r.copy in (0, 1, 2) for r in got)
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)


def test_language_rejects_junk_and_unlearned_languages(spark):
    rnd = random.Random(4)
    junk = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    finnish = "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto."
    polish = "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw, i powinni postepowac w duchu braterstwa."
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = [junk(n) for n in (20, 50, 200, 600) for _ in range(5)] + [finnish, polish]
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    rows = [(10**9 + i, t, None, "junk", len(t)) for i, t in enumerate(bad)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").select([F.col(f.name).cast(f.dataType) for f in docs.schema])
    assert {r.doc_id for r in P.language(spark, docs.unionByName(more), SF).collect()} == clean


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "words", "position"]
    positions = [r.position for r in out.select("position").collect()]
    assert positions == sorted(positions)
