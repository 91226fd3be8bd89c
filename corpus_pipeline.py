"""From raw documents to a training sequence, in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which
is written and read again as the next stage's docs.

Defined cases, for every stage: an empty table gives no rows; further columns are kept, but those that a stage makes on its way
(n_words, spans, item_ids; copy, words and position in the last) take the place of columns of these names; long
texts are handled whole. A null text has no letters, so the first stage drops it; later ones would keep it as an empty text (one
of all empty ones), and the last takes no words of it. A null id is a value like others for the first, second and fourth stage,
links with nothing in the third and is mixed like any other in the last. Null languages are not learned from, a null source is
a source of its own. Equal rows are one after the second stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuweave.llm import decontaminate, exact_dedup, language_id, mixing, set_join
from skuweave.llm.common import forget, masked, unmasked, without, written
from skuweave.llm.queries import curriculum, table

#: The least cosine with a language's prototype: four standard deviations of random vectors of 1,024 dimensions. Texts under 32
#: letters have too few trigrams to be told from noise; they take the second limit.
LEAST_COSINE, LEAST_OF_SHORT = 4 / 1024**0.5, 0.02


def shorter_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts take less memory when they hold fewer rows than Spark's default of 10,000."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that resemble no language: whose cosine is under LEAST_COSINE, or under half of
    the 1 % quantile of learned documents of that language and about as many letters (of all languages, if under 100 are)."""
    shorter_batches(spark)
    rows, names = masked(docs)
    id, text, lang = (F.col(names[c]) for c in ("doc_id", "text", "lang"))
    letters = F.char_length(F.regexp_replace(text, r"\P{L}+", ""))
    size = F.least(F.floor(F.log2(F.greatest(letters, F.lit(1)))), F.lit(12)).cast("int")
    # equal ids and equal texts have equal results
    named = rows.withColumns({"_key": F.concat_ws(":", id.cast("string"), F.md5(text.cast("binary"))), "_size": size})
    prototypes = language_id.learn(docs.filter(~language_id.held_out()))
    asked = named.select("_key", "_size", lang.alias("_lang"), (~language_id.held_out(names["doc_id"])).alias("_learned"), text.alias("text"))
    found = written(language_id.predict(asked, prototypes, keep_text=False), "languages")
    known = found.filter("_learned and _lang = lang_pred")
    low = F.percentile_approx("score", 0.01, 10_000)
    own = known.groupBy("lang_pred", "_size").agg(low.alias("_own"), F.count("*").alias("_n")).filter("_n >= 100").drop("_n")
    every = known.groupBy("_size").agg(low.alias("_every"))
    # at most 13 rows for each language
    found = found.join(F.broadcast(own), ["lang_pred", "_size"], "left").join(F.broadcast(every), "_size", "left")
    least = F.when(F.col("_size") >= 5, LEAST_COSINE).otherwise(LEAST_OF_SHORT)
    limit = F.greatest(least, F.coalesce("_own", "_every", F.lit(0.0)) / 2)
    gone = written(found.filter((F.col("lang_pred") == "und") | (F.col("score") < limit)).select(F.col("_key").alias("rep")), "rejected")
    return unmasked(without(named.drop("_size"), gone, "_key"), names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.kept_rows(docs, exact_dedup.DigestIndex(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 0.8 over five-word shingles connect, that with the smallest doc_id stays."""
    shorter_batches(spark)
    drop = written(set_join.join(docs, k=5, percent=80).filter("doc_id <> component_id").select(F.col("doc_id").alias("rep")), "near")
    return without(docs, drop, "doc_id").select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 10 words and more that benchmark items have; drops documents that consist of them by more than half."""
    shorter_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_len=10, max_coverage=0.5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, with copy, words and position, range-sorted by position."""
    return mixing.mix(docs, curriculum)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("mix", mixture)]
#: Profiles of languages and links of near copies are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
