"""k nearest neighbours by cosine, exact (operators.vector_index has the approximate search).

Queries and catalog are cut into blocks inside their categories; each pair of blocks is one group of a cogroup,
multiplied as float matrices in Arrow batches, and gives the best k of each query; a window then ranks what the blocks gave.
A block holds about block_rows vectors, so memory is bounded; a large category becomes many pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.vectors import feature_error, scaled
from .candidates import keyed_catalog, keyed_queries

SCORES = 1_000_000  # cosines that a task holds at once


def _blocks(df: DataFrame, rows: int, deal: str) -> DataFrame:
    """df with block, by a hash of the column deal, and blocks, their number in the key."""
    n = df.groupBy("key").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    return df.join(n, "key").withColumn("block", F.pmod(F.xxhash64(deal), F.col("blocks")).cast("int"))


def usable(df: DataFrame) -> DataFrame:
    """The rows whose vectors are numbers throughout; null, empty, NaN and infinite ones are no candidates."""
    return df.filter(feature_error(F.col("embedding")).isNull())


def block_pairs(a: DataFrame, b: DataFrame, block_rows: int, other_rows: int | None = None, deal: str = "id") -> tuple[DataFrame, DataFrame]:
    """Blocks, dealt by a hash of the column deal, of block_rows of a and of other_rows (else as many) of b. Both sides (id, key and further columns) with key, q_block and c_block, a row for each pair of blocks that it is part of.
    Keys that only one side has are gone."""
    a, b = _blocks(a, block_rows, deal), _blocks(b, other_rows or block_rows, deal)
    na, nb = a.select("key", F.col("blocks").alias("na")).distinct(), b.select("key", F.col("blocks").alias("nb")).distinct()
    left = a.withColumnRenamed("block", "q_block").join(nb, "key").withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    right = b.withColumnRenamed("block", "c_block").join(na, "key").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    right = right.drop("blocks", "na")
    return left.drop("blocks", "nb"), right.select(*(F.col(c).alias(c) for c in right.columns))  # names of its own, if both are one table


def tasks(spark: SparkSession) -> int:
    """Into how many partitions pairs of blocks are dealt: a few for each core, as Spark's own choice goes by bytes, not by work."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def matrix_of(t: pa.Table, column: str) -> np.ndarray:
    return t[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def nearest(qi, qm, q_fine, ci, cm, c_fine, k: int, least_cosine: float) -> list[tuple]:
    """For each query of a block its id, and the ids, cosines and usability of its best k, all if k is 0. ci ascends. Queries are
    multiplied in slices, so that SCORES cosines are held at once, whatever the block."""
    out, step = [], max(1, SCORES // max(1, len(ci)))
    for a in range(0, len(qi), step):
        ids = qi[a : a + step]
        scores = np.clip(np.round(qm[a : a + step] @ cm.T, 12), -1, 1)  # equal vectors get equal scores wherever they stand
        scores[ids[:, None] == ci[None, :]] = -np.inf
        scores[scores < least_cosine] = -np.inf
        for i in range(len(ids)):
            row = scores[i]
            edge = np.partition(row, -k)[-k] if 0 < k < len(row) else -np.inf
            at = np.flatnonzero((row >= edge) & (row > -np.inf))
            at = at[np.argsort(-row[at], kind="stable")][: k or None]
            out.append((np.full(len(at), ids[i]), ci[at], row[at], c_fine[at] & q_fine[a + i]))
    return out


def best(queries: DataFrame, catalog: DataFrame, k: int, least_cosine: float = -1.0, block_rows: int = 4096) -> DataFrame:
    """(q_id, c_id, cosine, usable): the best k of each query in each block of its key, all if k is 0. Vectors meet only those of
    the same length. usable: whether neither vector is zero; a zero vector has cosine 0 with all."""
    # vectors travel as they are and are doubles in the matrices only; a longer block of the catalog sends the best k less often
    long = lambda df: usable(df).select("id", F.struct("key", F.size("embedding").alias("dims")).alias("key"), "embedding")
    left, right = block_pairs(long(queries), long(catalog), block_rows, 4 * block_rows if k else block_rows)

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        m = matrix_of(t, "embedding")
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, 1), size[:, 0] > 0

    def found(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and c.num_rows:
            qi, ci = q["id"].to_numpy(), c["id"].to_numpy()
            order = np.argsort(ci)
            (qm, q_fine), (cm, c_fine) = matrix(q), matrix(c)
            ci, cm, c_fine = ci[order], cm[order], c_fine[order]
            out = nearest(qi, qm, q_fine, ci, cm, c_fine, k, least_cosine)
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * 4
        kinds = {"q_id": pa.int64(), "c_id": pa.int64(), "cosine": pa.float64(), "usable": pa.bool_()}
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), cols, strict=True)})

    key = ["key", "q_block", "c_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(found, "q_id long, c_id long, cosine double, usable boolean")


def knn_join(queries: DataFrame, catalog: DataFrame, k: int, least_cosine: float = -1.0, block_rows: int = 4096) -> DataFrame:
    """(q_id, c_id, cosine, rank). queries and catalog: id, key, embedding. Rows meet where their keys and the lengths of their
    vectors are equal; an id does not match itself; zero vectors have cosine 0 with all; rows whose vectors are null, empty,
    NaN or infinite are left out (functions.vectors.feature_error names them)."""
    found = best(queries, catalog, k, least_cosine, block_rows).drop("usable")
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("cosine"), "c_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def catalog_knn(queries: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig(), block_rows: int = 4096) -> DataFrame:
    """The index search of the visual mode: the nearest catalog rows of each query among its categories, by the keys of
    operators.match; scaled to a score."""
    q, c = keyed_queries(queries, catalog, cfg), keyed_catalog(catalog)
    found = knn_join(q, c, cfg.limit, block_rows=block_rows)
    return found.withColumn("score", scaled(F.col("cosine"), cfg.score_scale))


def index_statistics(catalog: DataFrame) -> DataFrame:
    """Vectors and megabytes (four bytes a number) of each category."""
    return catalog.groupBy("category").agg(F.count("embedding").alias("vectors"), F.round(F.sum(F.size("embedding") * 4) / 1e6, 3).alias("mb"))
