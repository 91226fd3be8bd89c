"""Repeated passages through a sparse suffix array.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased in A-Z. Of all suffixes of all
texts only those are kept that begin at a minimiser: the position with the least hash of `gram` words among `window`
neighbours, so equal passages keep suffixes at equal places. Each run of min_len words belongs to one suffix, the minimiser of
its first `window` places, which min_len - window + 1 of its words follow; a suffix is keyed by the hash of so many words, and
suffixes whose key is unique go. Those left carry the hashes of all runs that belong to them. Equal runs belong to suffixes of
equal keys, at equal distances, so a run occurs again exactly if its key and hash do, whatever surrounds it. Neighbouring runs
that repeat are united.

Keys with at most `most` suffixes are compared in one task, where their rows are sorted by key. Runs of larger keys are counted
in tasks, added up by run, and each run looks up its count, so that no task holds all rows of a key. Both ways are exact and
give the same rows.

Each run that repeats names the smallest document that holds it (rep), so what shares a run is a star around that document;
the components of these links are the classes of documents that shared passages connect.

Defined cases: null and empty texts have no words and no repeats; long texts are hashed whole, and a key that one text has many
times is counted like any other; rows that share an id are one document (the last of them by text counts); rows with a null id
have no repeats; an empty table gives no rows; further columns are ignored. A passage that repeats inside one document is a
repeat too, which connects it with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import likely, lookup, written
from .decontaminate import TABLE
from .set_join import CHUNK, U, components, mixed, word_hashes


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _documents(texts: list[bytes]):
    """Yields the word hashes of each text."""
    part, n = [], 0
    for k, t in enumerate(texts):
        part.append(t)
        n += len(t) + 1
        if n > CHUNK or k == len(texts) - 1:
            words, first = word_hashes(part, TABLE)
            for a, b in zip(first[:-1], first[1:], strict=True):
                yield words[a:b]
            part, n = [], 0


def _fold(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; k is built up by halves."""
    if k == 1:
        return words
    half = _fold(words, k // 2)
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = mixed(half[:n] * U(3) + half[k // 2 : k // 2 + n])
    return mixed(out * U(5) + words[k - 1 : k - 1 + n]) if k % 2 else out


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of hashes the position of the least; the last of equal ones."""
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(1)


def minimisers(words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions with the least hash of a window; the last of equal ones."""
    h = _fold(words, gram)
    if len(h) < window:
        return np.zeros(0, np.int64) if not len(h) else np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    return np.unique(_least(h, window))


def _keys(words: np.ndarray, gram: int, window: int, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix to which runs of min_len words belong: its key, the start of the first run and the number of runs, which
    start one after the other."""
    n = len(words) - min_len + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, start, runs = np.unique(_least(_fold(words, gram), window)[:n], return_index=True, return_counts=True)
    return _fold(words, min_len - window + 1)[at].view(np.int64), start, runs


def suffixes(docs: DataFrame, gram: int, window: int, min_len: int, id: str, text: str) -> DataFrame:
    """(doc, key) of the kept suffixes."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for i, words in zip(batch.column(0).to_pylist(), _documents(_texts(batch.column(1))), strict=True):
                got = np.unique(_keys(words, gram, window, min_len)[0], return_counts=True)
                keys.append(np.repeat(got[0], np.minimum(got[1], 2)))  # a key that a text has twice is not unique
                ids.append(np.full(len(keys[-1]), i, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["doc", "key"])

    return docs.select(F.col(id).cast("long"), text).mapInArrow(run, "doc long, key long")


def contexts(docs: DataFrame, gram: int, window: int, min_len: int) -> DataFrame:
    """doc, key, n, the start of the first run and the hashes of all runs that belong to the suffix, as bytes. docs: doc, text,
    keys (array of key and n)."""

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for doc, wanted, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _documents(_texts(batch.column(1))), strict=True):
                counts = {w["key"]: w["n"] for w in wanted}
                hashes = _fold(words, min_len).tobytes()
                for k, a, m in zip(*(c.tolist() for c in _keys(words, gram, window, min_len)), strict=True):
                    if k in counts:
                        for c, v in zip(columns, (doc, k, counts[k], a, hashes[8 * a : 8 * (a + m)]), strict=True):
                            c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc", "key", "n", "start", "runs"])

    return docs.select("doc", "text", "keys").mapInArrow(run, "doc long, key long, n long, start long, runs binary")


def _runs(doc, key, start, runs) -> tuple[np.ndarray, ...]:
    """A place for each run: doc, key, start, hash, and the row that it comes from."""
    size = np.array([len(r) // 8 for r in runs], np.int64)
    row = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return np.asarray(doc)[row], np.asarray(key)[row], np.asarray(start)[row] + step, np.frombuffer(b"".join(runs), np.int64), row


def _groups(key: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, hash and doc, and where in it each group of equal runs starts and ends."""
    order = np.lexsort((doc, h, key))
    k, x = key[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])])) if len(k) else np.zeros(0, np.int64)
    return order, first, np.append(first[1:], len(k)) if len(k) else first


FOUND = "doc long, start long, end long, rep long"


def matches(rows: DataFrame, min_len: int) -> DataFrame:
    """(doc, start, end, rep) for neighbouring runs of a suffix that occur again and whose smallest document is the same."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = rows.select("key", "doc", "start", "runs").repartition(n, "key").sortWithinPartitions("key")

    def found(cols: list[list]):
        doc, key, start, h, row = _runs(cols[1], cols[0], cols[2], cols[3])
        order, first, last = _groups(key, h, doc)
        size = last - first
        again, rep = np.repeat(size > 1, size), np.empty_like(doc)
        rep[order] = np.repeat(doc[order][first], size)
        good = np.empty(len(order), bool)
        good[order] = again
        at = np.flatnonzero(good)
        if not len(at):
            return None
        head = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]]) | (rep[at[1:]] != rep[at[:-1]])]))
        tail = at[np.append(head[1:], len(at)) - 1]
        columns = [doc[at[head]], start[at[head]], start[tail] + min_len, rep[at[head]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "start", "end", "rep"])

    def run(batches):
        held: list[list] = [[] for _ in range(4)]
        for batch in batches:
            held = [t + c.to_pylist() for t, c in zip(held, batch.columns, strict=True)]
            keys = np.array(held[0], np.int64)
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
            if whole and (got := found([c[:whole] for c in held])):
                yield got
            held = [c[whole:] for c in held]
        if held[0] and (got := found(held)):
            yield got

    return flat.mapInArrow(run, FOUND)


def frequent_matches(rows: DataFrame, min_len: int) -> DataFrame:
    """The same for keys of any size, a row for each run: runs are counted in tasks and then by run."""
    rows = rows.select("doc", "key", "start", "runs")

    def single(batches):
        for batch in batches:
            doc, key, start, h, _ = _runs(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, key, h, start)], names=["doc", "key", "h", "start"])

    def counted(batches):
        for batch in batches:
            doc, key, _, h, _ = _runs(*(c.to_pylist() for c in batch.columns))
            order, first, last = _groups(np.asarray(key, np.int64), h, np.asarray(doc, np.int64))
            columns = [key[order][first], h[order][first], last - first, doc[order][first]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "h", "m", "rep"])

    of = F.struct("key", "h").alias("of")
    sums = rows.mapInArrow(counted, "key long, h long, m long, rep long").groupBy(of).agg(F.sum("m").alias("m"), F.min("rep").alias("rep"))
    sums = written(sums.filter("m > 1"), "runs")
    found = lookup(rows.mapInArrow(single, "doc long, key long, h long, start long").select("doc", "start", of), sums, "of", "m")
    return found.select("doc", "start", (F.col("start") + min_len).alias("end"), "rep")


def united(found: DataFrame) -> DataFrame:
    """(doc, spans, n_repeated): the spans of each document, those that meet united. A document has no more spans than runs."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def run(batches):
        for batch in batches:
            spans, total = [], []
            for rows in batch.column(1):
                flat = rows.values
                start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                head = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                first, last = start[head], reach[np.append(head[1:], len(start)) - 1]
                spans.append([{"start": a, "end": z} for a, z in zip(first.tolist(), last.tolist(), strict=True)])
                total.append(int((last - first).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch.schema.field(1).type), pa.array(total, pa.int64())], names=["doc", "spans", "n_repeated"])

    return found.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(run, f"doc long, spans {kind}, n_repeated long")


def repeats(docs: DataFrame, min_len: int = 50, gram: int = 8, window: int = 24, most: int = 2000, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with repeats: the id, spans (array of start and end, in words, merged), n_repeated (words in
    spans), class_id (the smallest id of the documents that shared passages connect with it)."""
    base = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    kept = written(suffixes(base, gram, window, min_len, "doc", "text"), "suffixes")
    counts = written(kept.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    wanted = lookup(kept, counts, "key", "n").groupBy("doc").agg(F.collect_set(F.struct("key", "n")).alias("keys"))
    wanted = written(wanted, "wanted")
    texts = likely(base, wanted.select(F.col("doc").alias("rep")), "doc").groupBy("doc").agg(F.max("text").alias("text"))
    rows = written(contexts(texts.join(wanted, "doc"), gram, window, min_len), "contexts")
    found = matches(rows.filter(F.col("n") <= most), min_len)
    if not counts.filter(F.col("n") > most).isEmpty():
        found = found.unionByName(frequent_matches(rows.filter(F.col("n") > most), min_len))
    found = written(found, "matches")
    linked = components(found.filter("doc <> rep").select(F.col("doc").alias("src"), F.col("rep").alias("dst")).distinct())
    out = united(found).join(linked, F.col("doc") == F.col("node"), "left")
    return out.select(F.col("doc").alias(id), "spans", "n_repeated", F.coalesce("component", "doc").alias("class_id"))
