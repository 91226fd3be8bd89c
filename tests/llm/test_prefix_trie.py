import hashlib
import random
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skuweave.llm import prefix_trie, queries
from skuweave.llm.prefix_trie import product

from .brute import BLANKS, sha

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())):
        own.setdefault(c, []).append((r or "", x or ""))
    whole = {}
    for c, said in own.items():
        h, b = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(b, [])[:h] + said[h:])
    members = {}
    for c, said in sorted(whole.items()):
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        children.setdefault(node, 0)
        leaves[node] = leaves.get(node, 0) + (children[node] == 0)
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * (len(BLANKS.findall(node[-1][1])) if node else 0)
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], sha(",".join(str(c) for c in m if len(whole[c]) == len(k)))) for k, m in members.items())


def shown(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(COLUMNS).collect())


def test_products_are_a_monoid():
    rnd = random.Random(2)
    a, b, c = ((rnd.randrange(prefix_trie.M), rnd.randrange(9)) for _ in range(3))
    assert product(product(a, b), c) == product(a, product(b, c)) and product((0, 0), a) == a == product(a, (0, 0))


@pytest.mark.parametrize("seed", range(3))
def test_small_conversations_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, -45, -40, *range(70)]), rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, "user", "assistant"]), rnd.choice([None, "", "a", "a b", " c\td\x0be f "])) for _ in range(300)]
    rows += [(200 + i, t, "user", "copy of many") for i in range(60) for t in range(3)] + [(2000, t, "user", "x") for t in range(40)] + [(2020, t, "user", "x") for t in range(41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit("z"), "d": F.lit(1), "value": F.lit(2)})
    out = prefix_trie.trie(df)
    assert shown(out) == brute(rows)
    assert {(r.turn_of is None) == (r.depth == 0) for r in out.collect()} == {True}


def test_one_conversation_spans_tasks(spark):
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(2000)] + [(45, t, "user", f"turn {t % 7}") for t in range(1500)] + [(7, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.prefixes(prefix_trie.turns(df)).filter("c = 5").orderBy("i").collect()
    want, at = [], (0, 0)
    for r in found:
        want.append((r.i - 1, at := product(at, (prefix_trie.fingerprint(r.sha), 1))))
    assert [(r.i - 1, (int.from_bytes(r.value, "big"), r.i)) for r in found] == want and len(found) == 2000
    assert shown(prefix_trie.trie(df)) == brute(rows)


def test_long_lists_of_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(i, 0, "user", "same") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert shown(prefix_trie.trie(df)) == brute(rows)


def test_equal_fingerprints_of_unequal_turns_are_an_error(spark):
    groups = spark.createDataFrame([(1, b"a", b"b", b"p", b"p")], "d long, sha binary, sha_too binary, parent binary, parent_too binary")
    with pytest.raises(PySparkException):
        prefix_trie.verified(groups).collect()


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(df).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(queries.op13_prefix_trie(spark, sf)) == brute(rows)
