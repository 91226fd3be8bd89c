"""Mixing sources to target weights along a time-varying curriculum.

A recipe gives each source a schedule: knots (t, w) of a piecewise linear weight over training time t from 0 to 1. The
integral of a schedule is the source's weight, which decides its target (in words); a target stops at max_epochs times
the source's size and the excess goes to the others by weight. Along time, the cumulative demand of a source is its target
times the integral of its schedule up to t over the whole integral. Documents of a source stand in hashed order, repeated
epoch after epoch; a copy that begins at word c gets the time at which the cumulative demand is c, by inverting that
integral (a quadratic in each segment). Sorting by time (ranges of it, over partitions) gives the training order.

Prefix sums inside a source run over buckets of the hashed order, about as many in all as four times the shuffle
partitions, so that a source with a third of all rows is spread; the order itself doesn't depend on the number of buckets.
The recipe has one row for each source, and is joined as a small table by Spark's own size check. Ranks and targets are windows
over it, in one task, so sources are meant to be a few millions at most: collections or sites, not single pages.

Defined cases: null or empty texts have size 0 and are not taken; a long text is counted whole and keeps one place; null is a
source of its own, after the others; equal documents may change places with each other, which changes no result; a schedule
that integrates to 0 takes nothing; an empty table gives no rows; further columns are ignored by `assign` and kept by `mix`,
but for copy, words and position, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"


def source_sizes(sized: DataFrame, source: str = "source") -> DataFrame:
    """source, source_size, n_rows, rank (from 1, by code point, null last). The window sees one row for each source."""
    totals = sized.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    return totals.withColumn("rank", F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())))


def segments(knots: Column) -> Column:
    """Of a schedule: array of (t0, dt, w0, w1, area before)."""
    area = lambda i: (knots[i]["w"] + knots[i + 1]["w"]) / 2 * (knots[i + 1]["t"] - knots[i]["t"])
    last = F.size(knots) - 2
    before = lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), F.lit(0.0), lambda s, j: s + area(j)))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        knots[i]["t"].alias("t0"), (knots[i + 1]["t"] - knots[i]["t"]).alias("dt"), knots[i]["w"].alias("w0"), knots[i + 1]["w"].alias("w1"), before(i).alias("before"), area(i).alias("area")))


def when_reached(segs: Column, area: Column) -> Column:
    """The time at which the integral of the schedule reaches area."""
    seg = F.try_element_at(F.filter(segs, lambda s: (s["before"] <= area) & (s["area"] > 0)), F.lit(-1))
    rest = F.least(F.greatest(area - seg["before"], F.lit(0.0)), seg["area"])
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2 * rest * (seg["w1"] - seg["w0"]) / seg["dt"], F.lit(0.0)))
    return seg["t0"] + F.when(rest == 0, F.lit(0.0)).otherwise(F.least(2 * rest / (seg["w0"] + root), seg["dt"]))


def targets(recipe: DataFrame, max_epochs: int = 3) -> DataFrame:
    """recipe (rank, source_size, weight) with target: in order of size over weight, a source is held at its limit as long
    as that ratio is at most what the rest would get per weight; the others share what is left."""
    cap, whole = F.col("source_size") * max_epochs, W.partitionBy()
    order = W.orderBy("_ratio", "rank")
    out = recipe.withColumn("_ratio", F.when(F.col("weight") > 0, cap / F.col("weight")))
    live = F.col("weight") > 0
    out = out.withColumn("_total", F.sum("source_size").over(whole))
    below = F.coalesce(F.sum(F.when(live, cap)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = F.sum(F.when(live, F.col("weight"))).over(order.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("_held", live & (F.col("_ratio") * above <= F.col("_total") - below))
    held = F.coalesce(F.sum(F.when(F.col("_held"), cap)).over(whole), F.lit(0))
    free = F.sum(F.when(live & ~F.col("_held"), F.col("weight"))).over(whole)
    share = F.when(~live, F.lit(0.0)).when(F.col("_held"), cap.cast("double")).otherwise(F.col("weight") * ((F.col("_total") - held) / free))
    return out.withColumn("target", share).drop("_ratio", "_total", "_held")


def assign(docs: DataFrame, schedule, max_epochs: int = 3, seed: int = 7, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, taken, copies (array of copy, words, position).
    schedule: from the column rank to the source's knots, an array of structs (t, w). The last copy of a source is cut at
    its target, which is rounded to whole words."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    sized = written(sized.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))), "sized")
    sources = source_sizes(sized).withColumn("knots", schedule(F.col("rank")))
    sources = sources.withColumn("segs", segments(F.col("knots"))).withColumn("weight", F.aggregate("segs", F.lit(0.0), lambda a, s: a + s["area"]))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") * parts / F.sum("n_rows").over(W.partitionBy())))
    sources = written(targets(sources, max_epochs).withColumn("buckets", buckets.cast("int")).drop("knots", "n_rows"), "sources")
    at = F.least(F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("buckets")), F.col("buckets") - 1).cast("int")
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("bucket", at)
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("rank", "bucket", before.alias("before"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = placed.join(sums, ["rank", "bucket"]).withColumn("start", F.col("before") + inside)
    end = F.round("target").cast("long")
    start = lambda e: F.col("start") + e * F.col("source_size")
    copies = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.struct(
        e.alias("copy"),
        F.greatest(F.least(F.col("size"), end - start(e)), F.lit(0)).cast("long").alias("words"),
        when_reached(F.col("segs"), start(e) / F.nullif("target", F.lit(0.0)) * F.col("weight")).alias("position")))
    out = begun.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return out.select(F.col("doc_id").alias(id), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken"), "copies")


def in_training_order(assigned: DataFrame, id: str = "doc_id") -> DataFrame:
    """Range-sorts by the first position (null if nothing is taken); what isn't taken comes last, in hashed order, so that it
    is spread over tasks."""
    first = F.try_element_at(F.col("copies.position"), F.lit(1))
    out = assigned.withColumns({"position": first, "_order": F.coalesce(first, 2.5 + F.xxhash64(F.lit(1), F.col(id)).cast("double") / F.lit(2.0**64))})
    n = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "_order").sortWithinPartitions("_order").drop("_order")


def mix(docs: DataFrame, schedule, max_epochs: int = 3, seed: int = 7, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The training sequence: the columns of docs with copy, words and position, a row for each copy, range-sorted by
    position. Rows that share an id and a size share one plan, the one with more copies."""
    plan = assign(docs, schedule, max_epochs, seed, id, text, source)
    plan = plan.groupBy(F.col(id).alias("_id"), F.col("size").alias("_size")).agg(F.max(F.struct(F.size("copies").alias("n"), F.col("copies").alias("c")))["c"].alias("copies"))
    plan = plan.select("_id", "_size", F.inline("copies"))
    plan = plan.withColumnsRenamed({"copy": "_copy", "words": "_words", "position": "_position"})
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.withColumn("_n", size).join(plan, F.col(id).eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size"))).drop("_n", "_id", "_size")
    out = out.drop(*[c for c in ("copy", "words", "position") if c in docs.columns]).withColumnsRenamed({"_copy": "copy", "_words": "words", "_position": "position"})
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "position").sortWithinPartitions("position", F.xxhash64(id))
