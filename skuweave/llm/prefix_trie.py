"""The prefix trie of conversations rebuilt from a shared head and their own turns, without building any of them.

A turn is referred to by its conversation and position; only SHA-256 of its role and text, its words and its fingerprint travel.
The fingerprint of a sequence is an element (value, length) of a monoid: (v, n) . (w, m) = (v * B ** m + w, n + m), with numbers
modulo the prime 2 ** 127 - 1. Products of all prefixes of the original conversations are found by one scan over rows that are
sorted by range, so one conversation may span tasks: each task starts at the neutral element, and the products of earlier tasks
are multiplied from the left. A rebuilt prefix is the base's head times the own turns after the head; with the products c(i) of
own prefixes its value is c(i) + (b(g) - c(h)) * B ** (i - h), where the bracket is one number for a conversation (g turns
of the base, h turns of its own replaced). Heads are at most three rows.

Nodes are groups of equal (depth, fingerprint). Each group verifies that its members' last turns have one SHA-256 and that
their parents are one node, so by induction over the depth that their sequences are equal; a group that differs stops the job
with an error (the base is a parameter). A tail that one conversation alone reaches is a chain with one leaf and nothing to
save; of the other nodes, sums over subtrees are found by doubling: in round k a node's sum goes to its ancestor 2 ** k levels
up, which is a row of the path of its least member, so rounds are the logarithm of the depth and no key is hot.

Lists of conversations that end in a node are hashed as streams: rows are sorted by range, joined to pieces of text (a long
list by several tasks), and a node's digest is fed with its pieces in order.

Defined cases: null roles and texts are empty; rows of equal turn come by role, then by SHA-256 of role and text, null turns
first; repeated rows are repeated turns; rows without an id belong to no conversation and are left out; of a negative id the
base is nearer to 0, as % is in SQL; long texts are read whole, by the task that holds them; an empty table has no conversation
and gives no node; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, written

M = 2**127 - 1
BASE = 0x5DEECE66D2545F4914F6CDD1D1B54A33 % M
PIECE = 1 << 16  # ids in a piece of a list
WORD = r"[^\x20\x09-\x0D]+"


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _bytes(n: int) -> bytes:
    return n.to_bytes(16, "big")


def product(a: tuple[int, int], b: tuple[int, int], base: int = BASE) -> tuple[int, int]:
    """The fingerprint of a sequence followed by another; (0, 0) is neutral."""
    return (a[0] * pow(base, b[1], M) + b[0]) % M, a[1] + b[1]


def fingerprint(sha: bytes) -> int:
    """Of one turn; never 0, so that no turn vanishes."""
    return _number(sha[:15]) + 1


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, turn, role, sha (of role and text, the role's length before them), words of the text."""
    field = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    named = rows.select(F.col(f"`{conv_id}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), field(role).alias("role"), field(text).alias("text")).filter("c is not null")
    sha = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return named.select("c", "turn", "role", sha.alias("sha"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def _out(columns: list[tuple[str, pa.DataType]], rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    schema, held = pa.schema(columns), []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def prefixes(rows: DataFrame, base: int = BASE) -> DataFrame:
    """For each turn its position i in its conversation (from 1), and value: of the turns up to it."""
    order = ["c", "turn", "role", "sha"]
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("c", "sha", "words", F.spark_partition_id().alias("task"))

    def scan(batches):
        def found():
            before, value, i = None, 0, 0
            for c, sha, words, task in _rows(batches):
                if c != before:
                    before, value, i = c, 0, 0
                value, i = (value * base + fingerprint(sha)) % M, i + 1
                yield c, sha, words, task, i, _bytes(value)

        yield from _out([("c", pa.int64()), ("sha", pa.binary()), ("words", pa.int64()), ("task", pa.int32()), ("i", pa.int64()), ("value", pa.binary())], found())

    local = written(dealt.mapInArrow(scan, "c long, sha binary, words long, task int, i long, value binary"), "prefixes")
    # conversations that span tasks: those that two tasks hold, so two rows for each task at most
    ends = local.groupBy("task").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    edges = ends.select("task", F.explode(F.array_distinct(F.array("first", "last"))).alias("c"))
    totals = local.join(F.broadcast(edges), ["task", "c"]).groupBy("c", "task").agg(F.max_by("value", "i").alias("value"), F.max("i").alias("n"))
    starts, at = [], {}
    for c, task, value, count in sorted((r.c, r.task, r.value, r.n) for r in totals.collect()):
        if c in at:
            starts.append((c, task, bytearray(_bytes(at[c][0])), at[c][1]))
        at[c] = product(at.get(c, (0, 0)), (_number(value), count), base)
    carry = spark.createDataFrame(starts, "c long, task int, start binary, before long")
    moved = local.join(F.broadcast(carry), ["c", "task"], "left").select("c", "sha", "words", "i", "value", "start", "before")

    def multiply(batches):
        def found():
            for c, sha, words, i, value, start, before in _rows(batches):
                if start is not None:
                    value = _bytes((_number(start) * pow(base, i, M) + _number(value)) % M)
                yield c, sha, words, i + (before or 0), value

        yield from _out([("c", pa.int64()), ("sha", pa.binary()), ("words", pa.int64()), ("i", pa.int64()), ("value", pa.binary())], found())

    if not starts:
        return local.select("c", "sha", "words", "i", "value")
    return moved.mapInArrow(multiply, "c long, sha binary, words long, i long, value binary")


def head_length(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 4


def paths(rows: DataFrame, base: int = BASE) -> DataFrame:
    """The rebuilt conversations: c, d (depth), value, parent (the value at d - 1), sha and words of the turn, and the turn's
    reference (of, i). d = 0 stands for the conversation without turns, once each."""
    own = written(prefixes(rows, base), "turns")
    ids = own.groupBy("c").agg(F.count("*").alias("n")).withColumns({"h": head_length(F.col("c")), "b": F.col("c") - F.col("c") % 20})
    ids = written(ids, "conversations")
    first = own.filter("i <= 3")  # heads: three rows of a base go to its twenty conversations
    heads = ids.filter("h > 0").select("c", "b", "h").join(first.select(F.col("c").alias("b"), "i", "sha", "words", F.col("value").alias("head")), "b").filter("i <= h")
    heads = written(heads.select("c", "b", "i", "sha", "words", "head"), "heads")
    b = heads.groupBy("c").agg(F.max("i").alias("g"), F.max_by("head", "i").alias("b_value"))
    replaced = ids.filter("h > 0").select("c", "h").join(first.select("c", "i", F.col("value").alias("c_value")), "c").filter("i = h").select("c", "c_value")
    constants = ids.filter("n > h").select("c", "n", "h").join(b, "c", "left").join(replaced, "c", "left").select("c", "n", "h", F.coalesce("g", F.lit(0)).alias("g"), "b_value", "c_value")
    constants = written(constants, "constants")
    columns = [("c", pa.int64()), ("d", pa.int64()), ("value", pa.binary()), ("parent", pa.binary()), ("sha", pa.binary()), ("words", pa.int64()), ("of", pa.int64()), ("i", pa.int64())]
    schema = "c long, d long, value binary, parent binary, sha binary, words long, of long, i long"
    inverse = pow(base, -1, M)

    def up(value: int, sha: bytes) -> bytes:
        return _bytes((value - fingerprint(sha)) * inverse % M)

    def compose(batches):
        def found():
            for c, sha, words, i, value, h, g, b_value, c_value in _rows(batches):
                whole = (_number(value) + (_number(b_value or b"") - _number(c_value or b"")) * pow(base, i - h, M)) % M
                yield c, g + i - h, _bytes(whole), up(whole, sha), sha, words, c, i

        yield from _out(columns, found())

    def headed(batches):
        yield from _out(columns, ((c, i, value, up(_number(value), sha), sha, words, of, i) for c, of, i, sha, words, value in _rows(batches)))

    tails = lookup(own, constants, "c", "n").filter("i > h").select("c", "sha", "words", "i", "value", "h", "g", "b_value", "c_value")
    none = F.lit(None)
    root = ids.select("c", F.lit(0).cast("long").alias("d"), F.lit(_bytes(0)).alias("value"), none.cast("binary").alias("parent"), none.cast("binary").alias("sha"), F.lit(0).cast("long").alias("words"), none.cast("long").alias("of"), none.cast("long").alias("i"))
    return tails.mapInArrow(compose, schema).unionByName(heads.mapInArrow(headed, schema)).unionByName(root)


def ends_of(steps: DataFrame) -> DataFrame:
    """d, value and ends_sha256 of the nodes in which conversations end."""
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = steps.groupBy("c").agg(F.max("d").alias("d"), F.max_by("value", "d").alias("value"))
    dealt = last.repartitionByRange(n, "d", "value", "c").sortWithinPartitions("d", "value", "c").select("d", "value", "c")

    def join(batches):
        def found():
            key, held = None, []
            for d, value, c in _rows(batches):
                if key != (d, value) or len(held) >= PIECE:
                    if held:
                        yield *key, held[0], ",".join(map(str, held))
                    key, held = (d, value), []
                held.append(c)
            if held:
                yield *key, held[0], ",".join(map(str, held))

        yield from _out([("d", pa.int64()), ("value", pa.binary()), ("c", pa.int64()), ("ids", pa.string())], found(), 100)

    def digest(batches):
        def found():
            key, sha = None, None
            for d, value, ids in _rows(batches):
                if key != (d, value):
                    if key:
                        yield *key, sha.hexdigest()
                    key, sha = (d, value), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if key:
                yield *key, sha.hexdigest()

        yield from _out([("d", pa.int64()), ("value", pa.binary()), ("ends_sha256", pa.string())], found())

    pieces = dealt.mapInArrow(join, "d long, value binary, c long, ids string")
    pieces = pieces.repartition("d", "value").sortWithinPartitions("d", "value", "c").select("d", "value", "ids")
    return pieces.mapInArrow(digest, "d long, value binary, ends_sha256 string")


def verified(groups: DataFrame) -> DataFrame:
    """The groups, or an error where a group's members differ in their last turn or in their parent."""
    same = F.col("sha").eqNullSafe(F.col("sha_too")) & F.col("parent").eqNullSafe(F.col("parent_too"))
    checked = F.when(~same, F.raise_error(F.lit("two sequences of turns have one fingerprint; choose another base")).cast("long")).otherwise(F.col("d"))
    return groups.withColumn("d", checked).drop("sha_too", "parent_too")


def subtree_sums(shared: DataFrame, steps: DataFrame) -> DataFrame:
    """d, value, n_leaves, saved_tokens: the sums of leaves and saved over each node of shared (d, value, c, leaves, saved) and
    those of its descendants that are in shared."""
    sums = shared.select("d", "value", "c", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    deepest, reach = sums.agg(F.max("d")).first()[0] or 0, 1
    while reach <= deepest:
        sums = written(sums, f"sums-{reach}")
        above = sums.filter(F.col("d") >= reach).select("c", (F.col("d") - reach).alias("d"), "n_leaves", "saved_tokens")
        above = above.join(steps.select("c", "d", "value"), ["c", "d"])
        added = above.groupBy("d", "value").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        sums = sums.join(added, ["d", "value"], "left").select(
            "d", "value", "c", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")
        )
        reach *= 2
    return sums.drop("c")


def trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", base: int = BASE) -> DataFrame:
    """One row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the reference to its last turn (turn_of, turn_at: a conversation and a position in it from 1; the root
    has none)."""
    steps = written(paths(turns(rows, conv_id, turn, role, text), base), "steps")
    last = F.min(F.struct("c", "of", "i", "words"))
    nodes = steps.groupBy("d", "value").agg(last.alias("least"), F.count("*").alias("n_convs"), F.min("sha").alias("sha"), F.max("sha").alias("sha_too"), F.min("parent").alias("parent"), F.max("parent").alias("parent_too"))
    nodes = written(verified(nodes).select("d", "value", "least.c", "least.of", "least.i", "least.words", "n_convs", "parent"), "nodes")
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("value")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("n_single"))
    known = nodes.join(children, ["d", "value"], "left").fillna(0, ["n_children", "n_single"])
    known = written(known.withColumn("key", F.concat(F.col("d").cast("string").cast("binary"), F.lit(b":"), "value")), "known")
    many = F.col("n_convs") > 1
    leaves = F.col("n_single") + (F.col("n_children") == 0).cast("long")
    shared = known.filter(many).select("d", "value", "c", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = subtree_sums(written(shared, "shared"), steps)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    told = known.join(sums, ["d", "value"], "left").join(ends_of(steps), ["d", "value"], "left")
    up = F.concat((F.col("d") - 1).cast("string").cast("binary"), F.lit(b":"), F.col("parent"))
    told = written(told.withColumn("up", up).drop("key", "value", "parent"), "told")
    parents = known.filter("n_children > 0").select(F.col("key").alias("up"), F.col("c").alias("parent_conv_id"), F.col("n_children").alias("n_rows"))
    top = told.filter("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    rest = lookup(told.filter("d > 0"), parents, "up", "n_rows").drop("n_rows")
    return top.unionByName(rest.select(top.columns)).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"), F.col("of").alias("turn_of"), F.col("i").alias("turn_at"),
    )
