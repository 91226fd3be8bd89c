"""Exact dedup against a persistent digest index.

The index is a Spark table, bucketed and sorted by digest, with one row for each distinct text. A batch of documents is
hashed, grouped by digest, and the groups that the index lacks (a sort-merge anti-join, for which the buckets save the index
its shuffle) are appended. Each batch adds a file to each bucket; compact() makes one sorted file of them again. Texts are
equal when they are identical after lower-casing A-Z.

Defined cases: a null text counts as empty; a text of any length is hashed whole, and only its digest is shuffled; a null id
is less than any other; of rows with equal texts and equal ids one stays; an empty batch appends nothing; further columns,
whatever their names, are ignored by `dedup` and kept by `kept_rows`.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, delete, likely, lookup, masked, new_path, new_table, unlikely, unmasked, written


def digest_column(text: str):
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A table (digest, keep_id, keep_row, n, batch), bucketed and sorted by digest, in a folder of `path` (the shared folder by
    default). batch is the run that appended the row."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark, self.path = spark, path
        self.table = table or new_table("digest_index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _folder(self) -> str:
        return f"{self.path}/{uuid.uuid4().hex}" if self.path else new_path(self.spark, "digest_index")

    def rows(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def append(self, groups: DataFrame) -> str:
        """Adds the groups whose digest the index lacks, and returns the name of the batch."""
        name = uuid.uuid4().hex
        if (known := self.rows()) is not None:
            groups = groups.join(known.select("digest").hint("merge"), "digest", "left_anti")
        batch = groups.withColumn("batch", F.lit(name)).repartition(self.buckets, "digest")
        out = batch.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (out if known is not None else out.option("path", self._folder())).saveAsTable(self.table)
        return name

    def compact(self) -> None:
        """One sorted file for each bucket: the rows are written to a new table, which takes the name of the old one."""
        rows, new = self.rows(), f"{self.table}_{uuid.uuid4().hex}"
        if rows is not None:
            rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._folder()).saveAsTable(new)
            self.drop()
            self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.table}")

    def drop(self) -> None:
        """The table and its files."""
        if self.rows() is not None:
            place = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").filter("col_name = 'Location'").first().data_type
            self.spark.sql(f"DROP TABLE {self.table}")
            delete(self.spark, place)


def dedup(docs: DataFrame, index: DigestIndex, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the id, keep_id (of the row that stays), group_size (rows of that text in this
    batch), kept, text_sha256. A text that the index held before is dropped in favour of the id kept there."""
    rows = written(docs.select(F.col(id), digest_column(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    groups = rows.groupBy("digest").agg(F.max(F.struct(F.col(id), F.col("row"))).alias("keep"), F.count("*").alias("n"))
    groups = written(groups.select("digest", F.col(f"keep.{id}").alias("keep_id"), F.col("keep.row").alias("keep_row"), "n"), "groups")
    batch = index.append(groups)
    held = index.rows().select("digest", "keep_id", F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row"))
    sizes = groups.select("digest", "n").join(held, "digest")
    return lookup(rows, sizes, "digest", "n").select(
        F.col(id), "keep_id", F.col("n").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup_in_batches(docs: DataFrame, index: DigestIndex, batches: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """dedup() of rows that arrive as several batches, those of the largest ids first, so that the second and later ones meet the
    index by its anti-join. group_size counts the rows of all batches."""
    cuts = docs.agg(F.percentile_approx(id, [1 - (i + 1) / batches for i in range(batches - 1)] or [0.0], 10_000).alias("c")).first().c or []
    above, parts = None, []
    for cut in [*cuts[: batches - 1], None]:
        part = docs if cut is None else docs.filter(F.col(id) >= cut)
        part = part if above is None else part.filter(F.col(id).isNull() | (F.col(id) < above))
        parts.append(dedup(part, index, id, text).drop("group_size"))
        above = cut if cut is not None else above
    every = written(functools.reduce(lambda a, b: a.unionByName(b), parts), "batches")
    sizes = every.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
    return lookup(every, sizes, "text_sha256", "group_size").select(id, "keep_id", "group_size", "kept", "text_sha256")


def kept_rows(docs: DataFrame, index: DigestIndex, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows whose id is not among those of dropped rows stay where they are;
    the others are told apart by digest."""
    found = written(dedup(docs, index, id, text).select(F.col(id).alias("rep"), "kept", F.unhex("text_sha256").alias("digest")), "kept")
    gone = found.filter("not kept").select("rep")
    stay = likely(found.filter("kept"), gone, "rep")
    rows, names = masked(likely(docs, gone, id))
    hashed = rows.withColumn("_digest", digest_column(names[text]))
    same = F.col(names[id]).eqNullSafe(F.col("rep")) & (F.col("_digest") == F.col("digest"))
    met = hashed.join(stay, same, "left_semi").dropDuplicates([names[id], "_digest"])
    return unlikely(docs, gone, id).unionByName(unmasked(met, names))
