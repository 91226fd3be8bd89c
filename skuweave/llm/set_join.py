"""Exact n-gram Jaccard self-join of documents, down to the connected components of its links.

A document's set holds the hashes (64 bits) of its distinct shingles of k words. Documents with equal sets form a class,
which its smallest id stands for; everything below works on classes.

Index. The tokens of all sets are ordered: first a fixed share of the hash range, by document frequency (in powers of two)
and hash, then the others by hash. Two sets that link share a token among the first n - ceil(n * threshold) + 1 of each
(the prefix), so only these are indexed, and only where another set has the token too. Document frequencies are counted over
all classes. Inverted lists are cut into blocks by position and size; a block is skipped with all its entries when no other
block of its list has sizes that its positions still allow.

Verification. Each list is named by a pivot, the member with the least hash of its id, which near copies share in most of
their lists; the members of all lists of one pivot are compared in one group, whole sets, in ranges of sizes. Groups of more
than `most_sets` sets or `most_tokens` tokens are cut into blocks that are compared pair by pair, so a task's memory is
bounded. Inside a group, the intersections of a set with all others are derived from those of the set before it, by the
tokens in which the two differ; members that links already connect need no further comparison, and a group emits at most one
edge for each member.

Components are found by Spark joins over those edges, with pointer jumping, in a few rounds.

Defined cases: null and empty texts have no shingles, link with nothing and are their own component; a text with fewer than k
words has one shingle, its whole sequence; a long text is one set, of whatever size, and is hashed and compared whole; rows
that share an id are one document, the last of them by text, which each of those rows reports; rows with a null id get a null
component and connect nothing; documents with equal sets are one class; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, likely, lookup, slices, without, written

#: A-Z to a-z, white space to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
CHUNK = 1 << 19  # bytes of text that are hashed together
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _series(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, up to n."""
    out = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@functools.cache
def _usual() -> tuple[np.ndarray, np.ndarray]:
    return _series(2 * CHUNK)


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and where in them each text begins (and the last one ends). table maps bytes;
    what it maps to a space separates words."""
    joined = b" ".join(texts).translate(table) + b" "
    data = np.frombuffer(joined, np.uint8)
    power, inverse = _usual() if len(data) <= 2 * CHUNK else _series(len(data))
    word = data != 32
    edge = np.diff(np.concatenate([[0], word.view(np.int8)]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * power[: len(data)], dtype=U)])
    words = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))
    return words, np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))


def _chunk_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    words, first = word_hashes(texts, TABLE)
    hashes = np.zeros(max(len(words) - k + 1, 0), U)
    for j in range(k):
        hashes = mixed(hashes * U(3) + words[j : j + len(hashes)])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            h = np.sort(hashes[a : b - k + 1])
            keep = np.ones(len(h), bool)
            keep[1:] = h[1:] != h[:-1]
            out.append(h[keep])
        elif b > a:
            h = np.full(1, b - a, U)
            for w in words[a:b]:
                h = mixed(h * U(5) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def sets_of(texts: list[bytes | None], k: int):
    """Yields the set of each text, in order."""
    part, n = [], 0
    for t in texts:
        part.append(t or b"")
        n += len(part[-1]) + 1
        if n > CHUNK:
            yield from _chunk_sets(part, k)
            part, n = [], 0
    if part:
        yield from _chunk_sets(part, k)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def prefix(n, percent: int):
    """Length of the prefix of a set of n tokens."""
    return n - (n * percent + 99) // 100 + 1


def profiles(docs: DataFrame, k: int, percent: int, share: float, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, set_a and set_b (a hash of the set), tokens: the set's hashes in the first `share` of the range, in order, at
    least as many as the prefix is long; n_first: how many of these are in that share."""
    limit = U(min(int(share * 2**64), 2**64 - 1))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, 4 << 20)):
            n, a, b, firsts, tokens = [], [], [], [], []
            for s in sets_of(batch.column(1).cast(pa.large_binary()).to_pylist(), k):
                first = int(np.searchsorted(s, limit))
                n.append(len(s))
                a.append(int(mixed(s + U(1)).sum(dtype=U).astype(np.int64)) if len(s) else 0)
                b.append(int(mixed(s ^ U(0xD6E8FEB86659FD93)).sum(dtype=U).astype(np.int64)) if len(s) else 0)
                firsts.append(first)
                tokens.append((s[: max(first, prefix(len(s), percent))] >> U(1)).astype(np.int64))
            ints = lambda x, kind: pa.array(x, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), ints(n, pa.int64()), ints(a, pa.int64()), ints(b, pa.int64()), ints(firsts, pa.int32()), _lists(tokens)],
                                             names=[id, "n", "set_a", "set_b", "n_first", "tokens"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, n long, set_a long, set_b long, n_first int, tokens array<long>")


def entries(classes: DataFrame, percent: int) -> DataFrame:
    """The index: token, rep, n, pos (in the set's order), lo and hi (the sizes that a partner may have)."""
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 40  # smaller sets link with their equals only
    small = classes.filter(F.col("n") >= least)
    tokens = small.select("rep", F.posexplode("tokens").alias("at", "token"))
    counts = written(small.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    shared = tokens.join(counts, "token").groupBy("rep").agg(F.collect_list(F.struct("token", "at", "df")).alias("rows"))
    first = lambda r: r["at"] < F.col("n_first")
    order = lambda r: F.struct(F.when(first(r), 0).otherwise(1).alias("late"), F.when(first(r), F.floor(F.log2(r["df"]))).otherwise(0).alias("often"), r["token"], r["at"])
    rows = shared.join(small.select("rep", "n", "n_first"), "rep").withColumn("rows", F.array_sort(F.transform("rows", order)))
    early = F.size(F.filter("rows", lambda r: r["late"] == 0))
    place = F.transform("rows", lambda r, i: F.struct(r["token"].alias("token"), F.when(r["late"] == 0, F.col("n_first") - early + i).otherwise(r["at"]).alias("pos")))
    listed = rows.select("rep", "n", F.inline(place))
    n, pos = F.col("n"), F.col("pos")
    listed = listed.filter(pos < n - F.floor((n * percent + 99) / 100) + 1)
    hi = F.least(F.floor(n * 100 / percent), F.floor((n - pos) * (100 + percent) / percent + 1e-9) - n)
    return listed.select("token", "rep", "n", "pos", F.ceil(n * percent / 100 - 1e-9).alias("lo"), hi.alias("hi")).filter("hi >= lo")


def memberships(index: DataFrame, percent: int) -> DataFrame:
    """(pivot, rep, n): which sets each group compares. Blocks of a list that no other block can link with are skipped."""
    blocked = index.withColumns({"pb": F.floor(F.log2(F.col("pos") + 1)), "sb": F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))})
    least = F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep")))
    blocks = blocked.groupBy("token", "pb", "sb").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("m"), least.alias("pivot"))
    row = F.struct("pb", "sb", "lo", "hi", "least", "most", "m", "pivot")
    lists = blocks.groupBy("token").agg(F.collect_list(row).alias("blocks"))
    fits = lambda x, y: (y["least"] <= x["hi"]) & (y["most"] >= x["lo"]) & (x["least"] <= y["hi"]) & (x["most"] >= y["lo"])
    other = lambda x, y: (x["m"] > 1) | (x["pb"] != y["pb"]) | (x["sb"] != y["sb"])
    live = F.filter("blocks", lambda x: F.exists("blocks", lambda y: fits(x, y) & other(x, y)))
    lists = lists.select("token", live.alias("blocks")).filter(F.size("blocks") > 0)
    lists = lists.select("token", F.array_min(F.transform("blocks", lambda x: x["pivot"]))["rep"].alias("pivot"), F.explode(F.transform("blocks", lambda x: F.struct(x["pb"], x["sb"]))).alias("b"))
    lists = lists.select("token", "pivot", "b.pb", "b.sb")
    return blocked.join(lists, ["token", "pb", "sb"]).select("pivot", "rep", "n").distinct()


def tasks(members: DataFrame, percent: int, most_sets: int, most_tokens: int) -> DataFrame:
    """(pivot, w, i, j, rep, n): what is compared in one piece: sets of size range w, with those of the range below that are
    large enough to link with them; i and j are the blocks of the group."""
    width = 8 * math.log(100 / percent)
    at = lambda n: F.floor(F.log(n.cast("double")) / width)
    up = at(F.floor(F.col("n") * 100 / percent))
    ranged = members.select("pivot", "rep", "n", F.explode(F.sequence(at(F.col("n")), up)).alias("w"))
    groups = ranged.groupBy("pivot", "w").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).filter("m > 1")
    groups = groups.withColumn("parts", F.greatest(F.ceil(F.col("m") / most_sets), F.ceil(F.col("tokens") / most_tokens)).cast("int"))
    dealt = ranged.join(groups.select("pivot", "w", "parts"), ["pivot", "w"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int"))
    pairs = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return pairs.select("pivot", "w", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "rep", "n")


def compare(sizes: np.ndarray, parts: np.ndarray, cross: bool, tokens: np.ndarray, owners: np.ndarray, percent: int) -> np.ndarray:
    """For each set of a group the first set that links connect it with. cross: only sets of different parts are compared."""
    m = len(sizes)
    label = np.arange(m)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number, minlength=1) > 1
    keep = often[number]
    number, owners = (np.cumsum(often) - 1)[number[keep]], owners[keep]
    ends = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=1))]) if len(number) else np.zeros(1, np.int64)
    by_set = np.argsort(owners, kind="stable")
    of = np.split(number[by_set], np.cumsum(np.bincount(owners, minlength=m))[:-1])
    counted = lambda ts: np.bincount(np.concatenate([owners[ends[t] : ends[t + 1]] for t in ts]), minlength=m) if len(ts) else np.zeros(m, np.int64)
    last, shared = np.zeros(0, np.int64), np.zeros(m, np.int64)
    for x in range(m):
        if not (label != label[x]).any():
            break  # all are connected
        gone, come = np.setdiff1d(last, of[x], True), np.setdiff1d(of[x], last, True)
        shared = shared + counted(come) - counted(gone) if len(gone) + len(come) < len(of[x]) else counted(of[x])
        last = of[x]
        linked = (100 + percent) * shared >= percent * (sizes + sizes[x])
        if cross:
            linked &= parts != parts[x]
        linked[x] = False
        if linked.any():
            known = np.unique(np.append(label[linked], label[x]))
            label[np.isin(label, known)] = known[0]
    return label


def edges(pieces: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(src, dst): links enough to connect what links connect. docs: rep and text, a row for each rep; the texts travel with
    the pieces, as they are smaller than their sets."""
    key = ["pivot", "w", "i", "j"]
    rows = pieces.join(docs, "rep").select(*key, "part", "rep", "n", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *key).sortWithinPartitions(*key, "n", "rep")

    def solved(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        if table.num_rows < 2:
            return
        reps = table["rep"].to_numpy()
        sets = list(sets_of(table["text"].cast(pa.large_binary()).to_pylist(), k))
        sizes = np.array([len(x) for x in sets])
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        label = compare(sizes, table["part"].to_numpy(), i != j, np.concatenate(sets), np.repeat(np.arange(len(reps)), sizes), percent)
        at = np.flatnonzero(label != np.arange(len(label)))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[label[at]])], names=["src", "dst"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(c[a] for c in cols) if b > a else last
                if held and here != last:
                    yield from solved(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
                    last = here
        if held:
            yield from solved(held)

    return rows.mapInArrow(run, "src long, dst long").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that links reach."""
    pairs = written(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    label = written(pairs.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("c")).select(F.col("src").alias("node"), "c"), "label")
    last = None
    for _ in range(most_rounds):
        seen = pairs.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("c").alias("near"))
        hooked = label.join(seen, F.col("node") == F.col("src")).select("node", "c", F.least("c", "near").alias("d"))
        hooked = written(hooked, "hooked")
        roots = hooked.groupBy(F.col("c").alias("root")).agg(F.min("d").alias("low"))
        better = hooked.join(roots, F.col("node") == F.col("root"), "left").select("node", "c", F.least("d", F.coalesce("low", "d")).alias("d"))
        better = written(better, "better")
        jump = better.select(F.col("node").alias("up"), F.col("d").alias("top"))
        after = written(better.join(jump, F.col("d") == F.col("up")).select("node", "c", F.col("top").alias("d")), "after")
        forget(hooked, better, label if last is None else last)
        label, last = after.select("node", F.col("d").alias("c")), after
        if after.filter("c <> d").isEmpty():
            forget(pairs)
            return label.withColumnRenamed("c", "component")
    raise RuntimeError("the components did not settle")


def join(docs: DataFrame, k: int = 5, percent: int = 80, share: float | None = None, most_sets: int = 1024, most_tokens: int = 500_000, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id. Two documents link when 100 times the intersection is
    at least `percent` times the union. share: of the hash range that is indexed by frequency (one and a half prefixes by
    default); it decides speed, not results."""
    share = min(1.0, 1.5 * (100 - percent) / 100 + 0.02) if share is None else share
    base = docs.select(F.col(id).cast("long").alias(id), text)
    again = written(base.groupBy(id).agg(F.count("*").alias("rows")).filter(f"rows > 1 and `{id}` is not null"), "again")
    if not again.isEmpty():
        ones = again.select(F.col(id).alias("rep"))
        last = likely(base, ones, id).join(again.select(id), id).groupBy(id).agg(F.max(text).alias(text))
        out = _joined(without(base, ones, id).unionByName(last), k, percent, share, most_sets, most_tokens, id, text)
        out = out.join(again, id, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1)).cast("int"))))
        return out.drop("rows", "_copy")
    return _joined(base, k, percent, share, most_sets, most_tokens, id, text)


def _joined(base: DataFrame, k: int, percent: int, share: float, most_sets: int, most_tokens: int, id: str, text: str) -> DataFrame:
    """join() of documents whose ids differ."""
    full = written(profiles(base, k, percent, share, id, text), "profiles")
    rows = written(full.select(id, "n", "set_a", "set_b"), "sets")
    classes = rows.filter("n > 0").groupBy("set_a", "set_b").agg(F.min(id).alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    # tokens stay where they are but for those of documents that may be copies
    others = rows.filter("n > 0").join(classes.select(F.col("rep").alias(id)), id, "left_anti").select(F.col(id).alias("rep"))
    firsts = without(full.filter(F.col(id).isNotNull() & (F.col("n") > 0)), written(others, "copies"), id)
    index = written(entries(firsts.withColumnRenamed(id, "rep"), percent), "index")
    forget(full)
    members = written(memberships(index, percent), "members")
    forget(index)
    pieces = written(tasks(members, percent, most_sets, most_tokens), "pieces")
    forget(members)
    texts = likely(base, pieces.select("rep").distinct(), id).select(F.col(id).alias("rep"), F.col(text).alias("text"))
    links = written(edges(pieces, texts, k, percent), "edges")
    forget(pieces)
    found = components(links)
    forget(links)
    named = classes.select("set_a", "set_b", "rep", "copies").join(found, F.col("rep") == F.col("node"), "left")
    named = named.select(F.struct("set_a", "set_b").alias("set"), F.coalesce("component", "rep").alias("c"), "copies")
    rows = rows.select(id, F.col("n").alias("n_shingles"), F.struct("set_a", "set_b").alias("set"))
    linked = lookup(rows.filter("n_shingles > 0"), named, "set", "copies").select(id, "n_shingles", F.when(F.col(id).isNotNull(), F.col("c")).alias("component_id"))
    return linked.unionByName(rows.filter("n_shingles = 0").select(id, "n_shingles", F.col(id).alias("component_id")))
