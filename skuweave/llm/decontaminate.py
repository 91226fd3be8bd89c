"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased in A-Z. Each task streams the
words of its documents through the automaton, which gives for every word the longest match that ends there. A match of
min_len words is one occurrence of a window of an item; an item with fewer words is one window as a whole.

Items are dealt to shards of about shard_words words by the total of their words. Tasks build an automaton of each shard, and
one is broadcast for one pass over the documents, so that memory is bounded however large the benchmark is; between passes the
documents are written. An item longer than shard_words is a shard of its own at least; it alone may exceed the bound.

Defined cases: null and empty texts have no words and no hits; a long text is streamed whole; items without words never occur;
repeated items count once for each item_id; a null item_id is written as an empty string; without items nothing is hit;
document columns may have any names (n_words, spans and item_ids are replaced), ids may be null or repeated; an empty table
gives no rows.
"""

from __future__ import annotations

import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: A-Z to a-z; what is neither a word character nor beyond ASCII to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Automaton:
    """States by number; next[s] maps a word to a state. window[s] is the state of the last min_len words of s."""

    def __init__(self, items: list[tuple[str, list[bytes]]], min_len: int):
        self.min_len, self.next, self.link, self.length = min_len, [{}], [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._annotate(items)

    def _state(self, length: int, link: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state for the strings of q that are no longer than those of p with the word."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _annotate(self, items) -> None:
        m, order = self.min_len, sorted(range(len(self.next)), key=self.length.__getitem__)
        self.window = [-1] * len(order)
        for s in order:
            if self.length[s] >= m:
                up = self.link[s]
                self.window[s] = s if self.length[up] < m else self.window[up]
        self.items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            s = 0
            for w in words:
                s = self.next[s][w]
                if self.window[s] >= 0:
                    self.items.setdefault(self.window[s], set()).add(name)
            if len(words) < m:
                short.setdefault(s, []).append((len(words), name))
        self.short: dict[int, list[tuple[int, str]]] = {}  # with those of all suffixes
        for s in order[1:]:
            if found := short.get(s, []) + self.short.get(self.link[s], []):
                self.short[s] = found
        self.least = min([m, *(n for found in short.values() for n, _ in found)])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (merged, end exclusive) and the items whose windows occur."""
        trans, link, length, least, m = self.next, self.link, self.length, self.least, self.min_len
        s = n = 0
        spans, states, names = [], set(), set()
        for i, w in enumerate(words, 1):
            t = trans[s].get(w)
            if t is None:
                if not s:
                    continue
                while t is None and s:
                    s = link[s]
                    t = trans[s].get(w)
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s, n = t, n + 1
            if n < least:
                continue
            size = 0
            if n >= m:
                states.add(self.window[s])
                size = m
            for k, name in self.short.get(s, ()):
                if k <= n:
                    names.add(name)
                    size = max(size, k)
            if size:
                start = i - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, names.union(*(self.items[x] for x in states))


def automata(items: DataFrame, min_len: int, shard_words: int, id: str, text: str) -> DataFrame:
    """(shard, automaton), pickled: one of the items that hash to each shard."""
    rows = items.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * shard_words)))  # about six bytes a word
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).repartition(min(n, 2000), "shard")

    def build(key, table):
        named = zip(table["id"].to_pylist(), _texts(table["text"]), strict=True)
        made = pickle.dumps(Automaton([(i, words_of(t)) for i, t in named], min_len), pickle.HIGHEST_PROTOCOL)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "automaton": pa.array([made], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(build, "shard int, automaton binary")


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def scan(docs: DataFrame, items: DataFrame, min_len: int = 10, shard_words: int = 100_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, spans (array of start and end, in words) and item_ids (array of strings) as further columns, which
    replace columns of those names."""
    docs = docs.drop("n_words", "spans", "item_ids")
    out = docs.withColumns({"n_words": F.lit(0), "spans": F.array().cast(SPANS), "item_ids": F.array().cast("array<string>")})
    names, schema, sc = docs.columns, out.schema, docs.sparkSession.sparkContext
    made = written(automata(items, min_len, shard_words, item_id, item_text), "automata")
    shards = sorted(r.shard for r in made.select("shard").collect())  # a number for each shard
    held = None
    for k, shard in enumerate(shards):
        made_here = made.filter(F.col("shard") == shard).first().automaton
        held = sc.broadcast(pickle.loads(made_here))

        def run(batches, automaton=held):
            a = automaton.value
            for batch in batches:
                n_words, spans, ids = [], [], []
                for body, old, got in zip(_texts(batch.column(text)), batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True):
                    words = words_of(body)
                    hit, found = a.scan(words)
                    n_words.append(len(words))
                    spans.append(merged([(x["start"], x["end"]) for x in old] + hit) if old else [{"start": x, "end": y} for x, y in hit])
                    ids.append(sorted(found.union(got)))
                kinds = [batch.schema.field(x).type for x in ("n_words", "spans", "item_ids")]
                new = [pa.array(x, kind) for x, kind in zip((n_words, spans, ids), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *new], names=[*names, "n_words", "spans", "item_ids"])

        out = out.mapInArrow(run, schema)
        if k < len(shards) - 1:
            out = written(out, "scanned", compression="zstd")
            held.destroy()
    if shards:
        return out

    def counted(batches):
        for batch in batches:
            n = pa.array([len(words_of(x)) for x in _texts(batch.column(text))], pa.int32())
            yield batch.set_column(batch.schema.get_field_index("n_words"), "n_words", n)

    return out.mapInArrow(counted, schema)


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": x, "end": y} for x, y in out]


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def cut(body: str, spans: list[dict]) -> str:
    """The text without the hit words and what stands between them."""
    raw = body.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(TABLE))]
    out, last = [], 0
    for s in spans:
        out.append(raw[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, min_len: int = 10, max_coverage: float = 0.5, text: str = "text", length: str | None = "n_chars", **names) -> DataFrame:
    """The rows of docs without hit spans. A document of whose words more than max_coverage are hit goes as a whole. The
    column `length`, if there is one, gets the new number of characters; documents without hits stay as they are."""
    found = scan(docs, items, min_len, text=text, **names)
    found = found.filter(hit_words() <= F.col("n_words") * max_coverage)
    schema = found.schema

    def run(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            if any(spans):
                new = [cut(x, s) if s else x for x, s in zip(batch.column(text).to_pylist(), spans, strict=True)]
                k = batch.schema.get_field_index(text)
                batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
            yield batch

    out = found.mapInArrow(run, schema)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.size("spans") > 0, F.char_length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.select(docs.columns)
