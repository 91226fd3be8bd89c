"""Phrase collocations: frequent phrases of up to five words and their lowest score over all cuts, for each language.

First pass. Each task turns its texts into n-grams of 1 to max_words words and packs the hashes of these (with their language)
into summaries, one for each partition of the hash range; a summary is a sorted list of hashes and counts, sent as the
differences of neighbours, a byte or two each. Each partition merges its summaries into one Misra-Gries summary: when it holds
more than `capacity` counters, the count of the next largest is taken from all and what reaches 0 goes. No n-gram is counted
short by more than the sum of what was taken, and that is below mass / capacity, so with a capacity above mass / threshold
each n-gram of the threshold survives; capacity is set to twice that, from an upper bound of the mass, and a partition whose
error would reach the threshold (it cannot, unless hashes are dealt unevenly) stops the job.

Second pass. The hashes that survive are a bitmap, of at most 2 ** MOST_BITS bits, which tasks get by broadcast; where it
fills up, more n-grams than needed are counted, never fewer. N-grams that it lets through are counted exactly: in a task by
64-bit hash, then by their words in the partition of their hash, to which each task sends one compressed table. Every part of
a frequent phrase is as frequent, so its counts are there too. Scores are 38-digit decimals, which fail instead of
overflowing. A phrase that a longer one contains as often is also contained as often by one that is one word longer, so only
these are compared.

Defined cases: null texts are empty; a null language is `und`, and so is that value; words may hold any characters but those
that separate; a long text is read whole, by the task that holds it; ties of score and frequency go by UTF-8 bytes; repeated
rows count as often as they come; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, written
from .set_join import mixed, word_hashes

U = np.uint64
#: A-Z to a-z; blanks to a space; what ends a piece to a line break.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 32) else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: For word_hashes, which knows one separator.
WORDS = bytes(32 if c == 10 else c for c in TABLE)
CHUNK = 1 << 19  # bytes of text that are hashed together
HELD = 1 << 22  # n-grams that a task collects before it makes summaries of them
LEAST_PARTS, MOST_PARTS, MASS, MOST_BITS = 64, 1 << 15, 1 << 26, 30  # partitions, n-grams for each of them, bits of the bitmap


def n_grams(texts: list[bytes], salts: np.ndarray, max_words: int) -> tuple[bytes, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The joined texts with words in their final form, where each word starts and ends in it, and for each n the hashes of the
    n-grams by their first word (0 where there is none). salts: a number for each text, which its hashes depend on."""
    joined = b"\n".join(texts).translate(TABLE) + b"\n"
    words, first = word_hashes(texts, WORDS)
    data = np.frombuffer(joined, np.uint8)
    gap = (data == 32) | (data == 10)
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    pieces = np.cumsum(data == 10)[start]
    hashes, here = [], np.repeat(salts, np.diff(first))
    for n in range(1, max_words + 1):
        here = mixed(here[: max(len(words) - n + 1, 0)] * U(3) + words[n - 1 :])
        whole = pieces[: len(here)] == pieces[n - 1 :]
        hashes.append(np.where(whole, np.maximum(here, U(1)), U(0)))
    return joined, start, end, hashes


def _salts(langs: list[str]) -> np.ndarray:
    known = {x: U(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(langs)}
    return np.array([known[x] for x in langs], U)


def _texts(batches, max_words: int) -> Iterator[tuple]:
    """n_grams() of texts in chunks, with their languages and the numbers of their words by language."""
    for batch in batches:
        langs, texts, size, kinds = [], [], 0, batch.column(0)
        for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
            langs.append(kinds[i].as_py())
            texts.append(text.as_py())
            size += len(texts[-1]) + 1
            if size > CHUNK or i == batch.num_rows - 1:
                yield langs, texts, n_grams(texts, _salts(langs), max_words)
                langs, texts, size = [], [], 0


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts (of 1, if none are given)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[new], np.diff(np.append(new, len(keys)))
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class Summary:
    """A Misra-Gries summary of at most `capacity` counters. No count is short by more than `error`."""

    def __init__(self, capacity: int):
        self.capacity, self.error, self.mass = capacity, 0, 0
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        """Merges in what another summary has counted, and its error."""
        self.mass += int(counts.sum())
        self.error += error
        self.waiting.append((keys, counts))
        self.n += len(keys)
        if self.n > max(self.capacity, 1 << 20):
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.keys, self.counts = counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self.waiting, self.n = [], 0
        if len(self.keys) > self.capacity:
            taken = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts > taken
            self.keys, self.counts = self.keys[left], self.counts[left] - taken
            self.error += taken

    def merge(self, other: Summary) -> None:
        other.settle()
        self.add(other.keys, other.counts, other.error)
        self.mass += other.mass - int(other.counts.sum())

    def frequent(self, threshold: int) -> np.ndarray:
        """The keys that may have the threshold, all of those that have it among them."""
        self.settle()
        if self.error >= threshold:
            raise ValueError(f"{self.capacity} counters are too few for {self.mass} n-grams")
        return self.keys[self.counts + self.error >= threshold]


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts as bytes: differences of keys and counts less 1, seven bits a byte, compressed."""
    numbers = np.concatenate([keys[:1], np.diff(keys), (counts - 1).astype(U)])
    groups = np.maximum(1, np.ceil(np.log2(numbers.astype(np.float64) + 1) / 7 + 1e-9).astype(np.int64)) if len(numbers) else np.zeros(0, np.int64)
    ends = np.cumsum(groups)
    out, at = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), ends - groups
    for j in range(int(groups.max()) if len(groups) else 0):
        more = groups > j
        out[at[more] + j] = ((numbers[more] >> U(7 * j)) & U(127)).astype(np.uint8) | ((groups[more] > j + 1) * 128).astype(np.uint8)
    return len(keys).to_bytes(8, "little") + len(out).to_bytes(8, "little") + pa.compress(out.tobytes(), "lz4", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    data = np.frombuffer(pa.decompress(blob[16:], size, "lz4", asbytes=True), np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([np.zeros(min(len(ends), 1), np.int64), ends[:-1] + 1])
    numbers = np.zeros(len(ends), U)
    for j in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        more = ends - starts >= j
        numbers[more] |= (data[starts[more] + j] & 127).astype(U) << U(7 * j)
    return np.cumsum(numbers[:n], dtype=U), numbers[n:].astype(np.int64) + 1


def _table(rows) -> bytes:
    """Rows (part, lang, phrase, size, f) without the part, as compressed Arrow."""
    columns = list(zip(*rows, strict=True))[1:]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "size", "f"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def survivors(docs: DataFrame, threshold: int, max_words: int, parts: int, capacity: int, bits: int) -> DataFrame:
    """part, n, keys: for each partition of the hash range the hashes (their first `bits` bits) that may be frequent."""
    shift, low = U(64 - bits), bits - int(math.log2(parts))

    def summarise(batches):
        held, n = [], 0

        def packed():
            keys, counts = counted(np.concatenate(held))
            cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=U) << U(low))
            blobs = [pack(keys[a:b] & U((1 << low) - 1), counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "summary"])

        for _, _, (_, _, _, hashes) in _texts(batches, max_words):
            for h in hashes:
                held.append(h[h > 0] >> shift)
                n += len(held[-1])
            if n > HELD:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    def merge(batches):
        part, summary = None, None

        def told():
            keys = summary.frequent(threshold)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([pack(keys, np.ones(len(keys), np.int64))], pa.binary())], names=["part", "n", "keys"])

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    if summary:
                        yield told()
                    part, summary = p, Summary(capacity)
                summary.add(*unpack(blob.as_py()))
        if summary:
            yield told()

    sent = docs.mapInArrow(summarise, "part int, summary binary").repartition(parts, "part").sortWithinPartitions("part")
    return written(sent.mapInArrow(merge, "part int, n long, keys binary"), "survivors")


def bitmap(found: DataFrame, parts: int, bits: int) -> tuple[np.ndarray, int]:
    """The survivors as bits, and the number of a hash's first bits that tell its place."""
    n = found.agg(F.sum("n")).first()[0] or 0
    wide = max(int(math.log2(parts)) + 3, min(bits, MOST_BITS, math.ceil(math.log2(256 * n + 1))))  # one in 256 others gets through
    within = wide - int(math.log2(parts))
    less = U(bits - int(math.log2(parts)) - within)

    def run(batches):
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here = np.zeros(1 << within, bool)
                here[(unpack(blob.as_py())[0] >> less).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(here).tobytes()], pa.binary())], names=["part", "bits"])

    whole, size = np.zeros(1 << (wide - 3), np.uint8), 1 << (within - 3)
    for row in found.select("part", "keys").mapInArrow(run, "part int, bits binary").collect():  # at most 2 ** MOST_BITS bits in all
        whole[row.part * size : (row.part + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return whole, wide


def frequencies(docs: DataFrame, threshold: int, max_words: int) -> DataFrame:
    """lang, phrase, size (its words) and f, exact, for each phrase of the threshold; phrase '' has the number of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    mass = (docs.agg(F.sum((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 2)).first()[0] or 0) * max_words
    parts = min(MOST_PARTS, max(LEAST_PARTS, 1 << math.ceil(math.log2(mass / MASS + 1))))
    bits = min(63, max(32, math.ceil(math.log2(mass + 1)) + 1))
    capacity = math.ceil(2 * mass / parts / threshold) + 1000
    known, wide = bitmap(survivors(rows, threshold, max_words, parts, capacity, bits), parts, bits)
    sent, log = spark.sparkContext.broadcast(known), int(math.log2(parts))

    def count(batches):
        table, sizes, totals, n = sent.value, {}, {}, 0
        kept: list[tuple] = []  # hashes, counts, of one chunk after the other
        first: dict[int, tuple] = {}

        def told():
            rows = [(k >> (64 - log), *first[k], c) for k, c in sizes.items()]
            rows += [(0, lang, "", 0, c) for lang, c in totals.items()]
            rows.sort(key=lambda r: r[0])
            for part, some in itertools.groupby(rows, key=lambda r: r[0]):
                yield part, _table(some)

        def packed():
            some = list(told())
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([t for _, t in some], pa.binary())], names=["part", "counts"])

        for langs, texts, (joined, start, end, hashes) in _texts(batches, max_words):
            ends = np.cumsum([len(t) + 1 for t in texts])
            for i, m in enumerate(np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(texts)).tolist()):
                totals[langs[i]] = totals.get(langs[i], 0) + m
            for size, h in enumerate(hashes, 1):
                place = h >> U(64 - wide)
                hit = np.flatnonzero((table[(place >> U(3)).astype(np.int64)] >> (U(7) - (place & U(7))).astype(np.uint8)) & 1 & (h > 0))
                keys, at, counts = np.unique(h[hit], return_index=True, return_counts=True)
                for k, i, c in zip(keys.tolist(), hit[at].tolist(), counts.tolist(), strict=True):
                    if k in sizes:
                        sizes[k] += c
                    else:
                        sizes[k] = c
                        text = b" ".join(joined[start[j] : end[j]] for j in range(i, i + size))
                        first[k] = (langs[int(np.searchsorted(ends, start[i], side="right"))], text.decode("utf-8", "replace"), size)
            if len(sizes) > 500_000:
                yield packed()
                sizes, totals, first = {}, {}, {}
        if totals:
            yield packed()

    def add(batches):
        part, sums = None, {}

        def told():
            some = [(*k, n) for k, n in sums.items() if n >= threshold or not k[2]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*some, strict=True) if some else [[]] * 4, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "size", "f"])

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    if sums:
                        yield told()
                    part, sums = p, {}
                for *k, n in zip(*(c.to_pylist() for c in pa.ipc.open_stream(blob.as_buffer()).read_all().columns), strict=True):
                    sums[tuple(k)] = sums.get(tuple(k), 0) + n
        if sums:
            yield told()

    # what a task has counted goes to a partition of the hash range as one row
    sent_counts = rows.mapInArrow(count, "part int, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    return written(sent_counts.mapInArrow(add, "lang string, phrase string, size int, f long"), "frequencies")


def candidates(counts: DataFrame, threshold: int = 100) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score and inside (whether a longer candidate has as many occurrences)."""
    key = lambda phrase: F.concat(phrase, F.lit("\t"), F.col("lang"))  # noqa: E731  no word has a tab
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    many = counts.filter((F.col("size") >= 2) & (F.col("f") >= threshold)).select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = many.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = written(cuts.select("lang", "phrase", "size", "a", "k", key(joined(F.lit(1), F.col("k"))).alias("left"), key(joined(F.col("k") + 1, F.col("size") - F.col("k"))).alias("right")), "cuts")
    one = counts.filter("size > 0").select(key(F.col("phrase")).alias("key"), "f")
    uses = cuts.select(F.explode(F.array("left", "right")).alias("key")).groupBy("key").agg(F.count("*").alias("n_rows"))
    one = written(one.join(uses, "key"), "parts")
    with_left = lookup(cuts, one.select(F.col("key").alias("left"), F.col("f").alias("l"), "n_rows"), "left", "n_rows").drop("n_rows", "left")
    both = lookup(written(with_left, "left"), one.select(F.col("key").alias("right"), F.col("f").alias("r"), "n_rows"), "right", "n_rows").drop("n_rows", "right")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = lookup(both, totals.withColumn("n_rows", F.col("n")), "lang", "n_rows").withColumns({"top": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "bottom": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = many.filter("size > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = best.join(longer, ["lang", "phrase"], "left")
    return found.select("lang", "phrase", "size", "a", "best.l", "best.r", "n", "best.score", F.coalesce(F.col("longer") >= F.col("a"), F.lit(False)).alias("inside"))


def collocations(docs: DataFrame, threshold: int = 100, max_words: int = 5, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first `top` phrases of each language by score, frequency and phrase: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    found = candidates(frequencies(rows, threshold, max_words), threshold).filter("not inside")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
