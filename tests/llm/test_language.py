import zlib

import numpy as np
import pytest

from skuweave.llm import language_id as L
from skuweave.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op7_language(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es"}


def test_bundles_match_their_definition():
    e = L.Encoder(64, 3)
    text = "Ab, çA  x"
    s = e.symbols(text)
    letter = {p: np.random.Generator(np.random.Philox(key=[3, p])).integers(0, 2, 64, np.int8) * 2 - 1 for p in map(ord, " abçx")}
    plain = " ab ça x "
    want = sum(np.roll(letter[ord(a)], 2).astype(int) * np.roll(letter[ord(b)], 1) * letter[ord(c)] for a, b, c in zip(plain, plain[1:], plain[2:]))
    assert (e.sums([s, s[:0]], [0, 1], 2)[0] == want).all()
    many = [e.symbols("".join(chr(0x4E00 + (7 * i + k) % 300) for i in range(50))) for k in range(4)]
    assert len(e.tables[0]) > 160
    assert np.array_equal(e.sums(many, [0, 0, 1, 1], 2)[1], e.sums(many[2:], [0, 0], 1)[0])


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "the cat and the hat", "en"), (5, "der hund und die katze", "de"), (6, "und die und der", None), (6, "the and the", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    protos = L.learn(docs)
    assert list(protos) == ["de", "en"]
    got = sorted((r.doc_id, r.lang_pred) for r in L.predict(docs, protos).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "de"), (6, "en")]
    assert {r.lang_pred for r in L.predict(docs, {}).collect()} == {"und"} and L.predict(docs.limit(0), protos).count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        L.learn(docs, max_languages=1)
