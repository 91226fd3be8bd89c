"""Linking images to imported rows by four rules, applying the links, and merging completed templates.

images: path, filename, category. rows: row (their order), filename, category, sku, name, price and further columns, as text.
Where several rows fit an image, the first wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written

SKU_PATTERN = r"[A-Z]+-\d+"


def _equi(images: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    first = rows.filter(T.strip(F.col("sku")) != "").groupBy(F.lower(T.strip(F.col("sku"))).alias("_key")).agg(F.min("row").alias("row"))
    return images.withColumn("_k", key).join(first, F.col("_k") == F.col("_key")).select("path", "row")


def by_filename(images: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, row) where the file name without its extension is the SKU, case aside."""
    return _equi(images, rows, F.lower(T.without_extension(F.col("filename"))))


def by_sku_in_filename(images: DataFrame, rows: DataFrame, pattern: str = SKU_PATTERN) -> DataFrame:
    found = F.regexp_extract("filename", f"(?i){pattern}", 0)
    return _equi(images, rows, F.lower(F.when(found != "", found)))


def by_folder(images: DataFrame, rows: DataFrame) -> DataFrame:
    return _equi(images, rows, F.lower(F.col("category")))


def _fuzzy_pairs(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of distinct texts that can score at least `least` (over 0). Words meet if one lies in the other; distinct words
    find each other by their rarest pair of characters. A pair scores by its words only if so many words of a meet one of b that
    one of the rarest few of a does (all but least of them, and one more); if one text lies in the other, each of its words
    meets one, so its rarest does. So frequent words make no pairs by themselves."""
    every = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    long = lambda c: F.filter(every(c), lambda w: F.char_length(w) > 1)
    words = lambda c: F.when(F.size(long(c)) > 0, long(c)).otherwise(every(c))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, 2)))
    keep = F.size("ws") - F.ceil(least * F.size("ws") - 1e-9) + 1
    left = texts.withColumn("ws", words(F.col("a"))).withColumn("keep", F.when(F.size("ws") == F.size(F.array_distinct("ws")), F.greatest(keep, F.lit(1))).otherwise(F.size("ws")))
    left = left.select("a", "keep", F.explode(F.array_distinct("ws")).alias("v"))
    right = names.select("b", F.explode(F.array_distinct(words(F.col("b")))).alias("w"))
    known = left.select(F.col("v").alias("x")).union(right.select(F.col("w").alias("x"))).distinct()
    each = known.select("x", F.explode(grams(F.col("x"))).alias("g"))
    often = each.groupBy("g").agg(F.count("*").alias("n"))
    rare = each.join(often, "g").groupBy("x").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    inside = rare.join(each.withColumnRenamed("x", "y"), "g").filter(F.col("y").contains(F.col("x"))).select("x", "y")
    one = known.filter(F.char_length("x") == 1).select("x")  # at most 36 words of one character, which have no pair
    inside = inside.union(one.crossJoin(known.withColumnRenamed("x", "y")).filter(F.col("y").contains(F.col("x")))).distinct()
    met = written(inside.union(inside.select("y", "x")).distinct().toDF("v", "w"), "words")
    degree = met.join(right.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("v").agg(F.sum("n").alias("n"))
    ranked = left.join(degree, "v", "left").withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.coalesce("n", F.lit(0)), "v")))
    back = met.join(left.groupBy("v").agg(F.count("*").alias("n")), "v").groupBy("w").agg(F.sum("n").alias("n"))
    rarest = right.join(back, "w", "left").groupBy("b").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"))
    by_words = ranked.filter("r <= keep").select("a", "v").join(met, "v").join(right, "w").select("a", "b")
    return by_words.union(rarest.join(met, "w").join(left, "v").select("a", "b")).distinct()


def by_fuzzy_name(images: DataFrame, rows: DataFrame, least: float = 0.5) -> DataFrame:
    """The row with the best fuzzy score, `least` at least, of distinct pairs of texts that can reach it."""
    a = images.select("path", T.fuzzy_text(T.without_extension(F.col("filename"))).alias("a")).filter(F.char_length("a") >= 2)
    b = rows.select("row", T.fuzzy_text(F.col("name")).alias("b")).filter("b <> ''").groupBy("b").agg(F.min("row").alias("row"))
    texts = a.select("a").distinct()
    pairs = _fuzzy_pairs(texts, b.select("b"), least)
    scored = pairs.withColumn("score", T.fuzzy_score(F.col("a"), F.col("b"))).filter((F.col("score") > 0) & (F.col("score") >= least))
    best = scored.join(b, "b").groupBy("a").agg(F.max_by(F.struct("row", "score"), F.struct(F.col("score"), -F.col("row"))).alias("m"))
    return a.join(best, "a").select("path", F.col("m.row").alias("row"), F.col("m.score").alias("score"))


STRATEGIES = {"filename_equals_sku": by_filename, "filename_contains_sku": by_sku_in_filename, "folder_equals_sku": by_folder, "fuzzy_name": by_fuzzy_name}
FIELDS = ("category", "sku", "name", "price", "price_history", "performance_history")


def _filled(c: str) -> Column:
    return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c).cast("string"))


def apply(images: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """images with the fields of their linked rows; a field that the row lacks keeps the image's own value. linked tells."""
    new = rows.join(links.select("path", "row"), "row").select("path", *(_filled(c).alias(f"_{c}") for c in FIELDS if c in rows.columns), F.lit(True).alias("_linked"))
    out = images.join(new, "path", "left")
    own = lambda c: F.col(c).cast("string") if c in images.columns else F.lit(None).cast("string")
    out = out.withColumns({c: F.coalesce(f"_{c}", own(c)) for c in FIELDS if c in rows.columns} | {"linked": F.coalesce("_linked", F.lit(False))})
    return out.drop("_linked", *(f"_{c}" for c in FIELDS))


def run(images: DataFrame, rows: DataFrame, strategy: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images with fields, images without a row, rows without an image)."""
    links = STRATEGIES[strategy](images, rows)
    return apply(images, rows, links), unmatched_images(images, links), unmatched_rows(rows, links)


def manual(images: DataFrame, rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: path and row, chosen by hand."""
    return apply(images, rows, mapping)


def unmatched_images(images: DataFrame, links: DataFrame) -> DataFrame:
    return images.join(links, "path", "left_anti")


def unmatched_rows(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(links, "row", "left_anti")


def template_merge(products: DataFrame, template: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products with what a completed template fills in, template rows that no product has), by file name, case aside; the
    last row of a file name counts. template: row and text columns."""
    low = F.lower(T.strip(F.col("filename")))
    chosen = template.filter(low != "").groupBy(low.alias("_key")).agg(F.max_by(F.struct(*(c for c in FIELDS if c in template.columns)), "row").alias("t"), F.max("row").alias("row"))
    out = products.withColumn("_k", low).join(chosen, F.col("_k") == F.col("_key"), "left")
    names = [c for c in FIELDS if c in template.columns]
    own = lambda c: F.col(c).cast("string") if c in products.columns else F.lit(None).cast("string")
    out = out.withColumns({c: F.coalesce(F.when(F.col(f"t.{c}") != "", F.col(f"t.{c}")), own(c)) for c in names} | {"matched": F.col("_key").isNotNull()})
    lost = template.withColumn("_k", low).join(products.select(low.alias("_k")), "_k", "left_anti").drop("_k")
    return out.drop("_k", "_key", "t", "row"), lost
