"""Substring search over products by an index of trigrams.

Rows of a posting table say for a trigram, a field and a block of 65,536 ids which ids of the block have it, and how many; rows of a
second table, in folders by block, hold the fields. A search counts its trigrams, reads the postings of the rarest only,
intersects them block by block, and verifies the candidates in the folders of their blocks. A batch of products, new or
changed, is appended with files of its own; what it makes stale is found out by the verification, which looks at the last
version of a product. Terms under three letters have no trigram and scan the fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FIELDS = ["product_name", "sku", "category"]
BLOCK = 16  # bits of an id inside its block
SPAN = 12  # bits of an id inside a range that one task cuts into trigrams
RAREST = 4  # trigrams of a term that are looked up


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    low = F.lower(text)
    n = F.char_length(low) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class SearchIndex:
    """Under path: rows and postings. buckets: files of postings that an append writes, by trigram."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def append(self, products: DataFrame, version: int) -> None:
        """Adds products (id, FIELDS and any other columns). Of the rows of an id those of the largest version count, so a batch
        that is appended again under its version changes nothing."""
        block = F.shiftright("id", BLOCK)
        lists = self.postings(products)
        part = F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")
        # rows last: a search sees a product only when its postings are there
        lists.withColumn("part", part).repartition(self.buckets, "part").sortWithinPartitions("gram").write.mode("append").partitionBy("part").parquet(f"{self.path}/postings")
        rows = products.withColumns({"_version": F.lit(version), "_block": block}).repartition(self._tasks(), "_block")
        rows.write.mode("append").partitionBy("_block").parquet(f"{self.path}/rows")

    def _tasks(self) -> int:
        """A few for each core: products are few bytes and much work, and Spark's own choice goes by bytes."""
        return max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def postings(self, products: DataFrame) -> DataFrame:
        """gram, field, block, ids and their number n. Products are dealt by short ranges of ids, whatever files they come from."""
        block = F.shiftright("id", BLOCK)
        dealt = products.select("id", *FIELDS).repartition(self._tasks(), F.shiftright("id", SPAN))
        fields = F.array(*(F.struct(F.lit(i).alias("field"), trigrams(F.col(c)).alias("grams")) for i, c in enumerate(FIELDS)))
        each = dealt.select("id", F.inline(fields)).select("id", "field", F.explode("grams").alias("gram"))
        low = F.col("id").bitwiseAND(F.lit(2**BLOCK - 1)).cast("int")
        return each.groupBy("gram", "field", block.alias("block")).agg(F.sort_array(F.collect_set(low)).alias("ids")).withColumn("n", F.size("ids"))  # 65,536 ids at most

    def remove(self, ids: DataFrame, version: int) -> None:
        """Takes products (id) out: their last version is empty."""
        kinds = {f.name: f.dataType for f in self._read("rows").schema if f.name not in ("id", "_version", "_block")}
        self.append(ids.select("id", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())), version)

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _postings(self, grams: list[str]) -> DataFrame:
        """Folders of the trigrams' parts, and in their files the row groups that have them."""
        parts = [r.p for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(self.buckets)).cast("int").alias("p")).distinct().collect()]
        return self._read("postings").filter(F.col("part").isin(parts) & F.col("gram").isin(grams))

    def candidates(self, term: str, fields: list[str]) -> DataFrame | None:
        """id of products that may hold the term in one of the fields; None where the term has no trigram."""
        low = term.lower()
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if not grams:
            return None
        numbers = [FIELDS.index(f) for f in fields]
        found = self._postings(grams).filter(F.col("field").isin(numbers))
        counts = {r.gram: r.n for r in found.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each trigram of the term
        if len(counts) < len(grams):
            return found.limit(0).select(F.lit(0).cast("long").alias("id"))
        rare = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        lists = found.filter(F.col("gram").isin(rare)).groupBy("field", "block", "gram").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        blocks = lists.groupBy("field", "block").pivot("gram", rare).agg(F.first("ids"))
        met = reduce(F.array_intersect, [F.col(f"`{g}`") for g in rare])
        ids = blocks.select(F.col("block"), F.explode(met).alias("low"))  # null, and so no row, where a trigram is missing
        return ids.select((F.shiftleft("block", BLOCK) + F.col("low")).alias("id")).distinct()

    def hits(self, term: str, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
        """The products, with all their columns, that hold the term in one of the fields, whatever the case."""
        rows, found = self._read("rows"), self.candidates(term, list(fields))
        if found is not None:
            blocks = [r.b for r in found.select(F.shiftright("id", BLOCK).alias("b")).distinct().collect()]  # one for 65,536 products
            rows = rows.filter(F.col("_block").isin(blocks) if blocks else F.lit(False)).join(found, "id", "left_semi")
        last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "_block")]), "_version").alias("r"))
        current = last.select("id", *(F.col(f"r.{c}").alias(c) for c in rows.columns if c not in ("id", "_block", "_version")))
        return current.filter(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False)) for c in fields]))
