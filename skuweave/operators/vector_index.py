"""A persistent vector index for approximate nearest neighbours by cosine: coarse cells, short codes, exact ranking of what is left.

Fit. A sample of at most sample_rows vectors, the first by a hash of their ids, gives `cells` centroids (k-means on unit vectors) and
a codebook of at most 256 words for each piece of PIECE numbers of what a vector differs from its cell's centroid. On the sample the
fit also measures how many cells must be probed (probes) and how many codes ranked exactly (refine) for a recall of `target` at
ten neighbours; tune() measures both against exact neighbours among all rows of the index. The model is one row.

Append. Every row of any batch is coded, without a new fit: its cell and a byte for each piece. Rows of a key and cell are dealt
into bins of about BIN_ROWS rows, so that copies of one vector, a large cell or a large category are many bins. The rows are a
table bucketed and sorted by bin; a second table lists the bins. An append that died before it listed its bins left rows that
no search meets.

Search. The codes alone are read, dealt by id into shelves of about SHELF_ROWS rows of a key, and met by blocks of Q_ROWS queries.
A query scores those of its nearest cells by table look-ups, and at most `refine` rows for each query leave a shelf, so what is
shuffled grows with shelves, not with cells or rows. The best `refine` of a query over all shelves are then multiplied with its
vector, exactly; the bucketed table of vectors stays where it is.

Rows whose vectors are null, empty, NaN or infinite, or of another length than the model's, are no candidates. An id does not match
itself.
"""

from __future__ import annotations

import functools
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written
from .knn import block_pairs, knn_join, tasks, usable

PIECE, WORDS, BIN_ROWS, MOST_CELLS = 4, 256, 4096, 4096
Q_ROWS, SHELF_ROWS, AT_ONCE = 512, 32_768, 64  # queries and codes that a task holds, queries scored at once


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def centres(m: np.ndarray, n: int, rng: np.random.Generator, spherical: bool, rounds: int = 12) -> np.ndarray:
    """n means of the rows of m; of unit length, if spherical. A mean that loses all its rows moves to the row farthest from its own."""
    c = m[rng.choice(len(m), n, replace=False)].copy()
    for _ in range(rounds):
        scores = m @ c.T - (0 if spherical else (c * c).sum(1) / 2)
        at = scores.argmax(1)
        sums, counts = np.zeros_like(c), np.bincount(at, minlength=n)
        np.add.at(sums, at, m)
        c = sums / np.maximum(counts, 1)[:, None]
        lost = np.flatnonzero(counts == 0)
        c[lost] = m[np.argsort(scores.max(1), kind="stable")[: len(lost)]]
        c = unit(c) if spherical else c
    return c


class Model:
    """Centroids and codebooks of one fit."""

    def __init__(self, sample: np.ndarray, cells: int | None = None, target: float = 0.95, seed: int = 5):
        rng, m = np.random.default_rng(seed), unit(sample)
        self.dims = m.shape[1]
        n = min(MOST_CELLS, max(1, int(2 * np.sqrt(len(m)))) if cells is None else cells, len(m))
        self.cells = centres(m, n, rng, True)
        self.cuts = list(range(0, self.dims, PIECE)) + [self.dims]
        rest = m - self.cells[self.cell(m)]
        self.books = [centres(rest[:, a:b], min(WORDS, len(m)), rng, False) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.probes, self.refine = self._measured(m, target, rng)

    def cell(self, m: np.ndarray) -> np.ndarray:
        return (m @ self.cells.T).argmax(1)

    def near(self, m: np.ndarray) -> np.ndarray:
        """For each row the cells, nearest first."""
        return np.argsort(-(m @ self.cells.T), axis=1, kind="stable")

    def codes(self, m: np.ndarray) -> np.ndarray:
        rest = m - self.cells[self.cell(m)]
        parts = [rest[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        return np.stack([(p @ w.T - (w * w).sum(1) / 2).argmax(1) for p, w in zip(parts, self.books, strict=True)], 1).astype(np.uint8)

    def guessed(self, q: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of each query with each code, from tables of the query's products with the centroids and all code words."""
        out = (self.cells @ q.T).astype(np.float32).take(cells, axis=0)
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (self.books[j] @ q[:, a:b].T).astype(np.float32).take(codes[:, j], axis=0)
        return out.T

    def _measured(self, m: np.ndarray, target: float, rng: np.random.Generator, k: int = 10) -> tuple[int, int]:
        """Probes and refine that together reach the target on the sample."""
        asked = rng.choice(len(m), min(len(m), 200), replace=False)
        q, k = m[asked], min(k, len(m) - 1)
        if k < 1:
            return len(self.cells), 10
        own = np.arange(len(asked)), asked
        exact = q @ m.T
        exact[own] = -2
        best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        aim = np.sqrt(target)  # each step loses about as much
        place = np.argsort(np.argsort(-(q @ self.cells.T), axis=1, kind="stable"), axis=1)
        needed = np.take_along_axis(place, self.cell(m)[best], 1)
        probes = int(np.searchsorted(np.cumsum(np.bincount(needed.ravel(), minlength=len(self.cells))), aim * needed.size)) + 1
        guess = self.guessed(q, self.cell(m), self.codes(m))
        guess[own] = -9
        guess[place[:, self.cell(m)] >= probes] = -9
        rank = np.argsort(np.argsort(-guess, axis=1, kind="stable"), axis=1)
        ranks = np.sort(np.take_along_axis(rank, best, 1)[needed < probes])
        return probes, max(2 * k, int(ranks[min(len(ranks) - 1, int(np.ceil(aim * len(ranks))))]) + 1)


@functools.cache
def _model(blob: bytes) -> Model:
    return pickle.loads(blob)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) if len(column) else np.zeros((0, dims))


class VectorIndex:
    """An index in the folder `path`, which all executors share: model, bins and rows. buckets decides the partitions of a search."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._table: str | None = None
        self._held: bytes | None = None

    def fit(self, rows: DataFrame, sample_rows: int = 20_000, cells: int | None = None, target: float = 0.95) -> None:
        """rows: id, embedding. Writes the model; refused where there is one."""
        sample = usable(rows).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        got = sample.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("embedding").toArrow()["embedding"].combine_chunks()
        sizes = np.diff(got.offsets.to_numpy()) if len(got) else np.zeros(0, np.int64)
        if not len(sizes):
            raise ValueError("there is no vector to learn from")
        dims = int(np.bincount(sizes).argmax())
        made = Model(_matrix(got.take(pa.array(np.flatnonzero(sizes == dims))), dims), cells, target)
        self._write(pickle.dumps(made), 0, "errorifexists")

    def _write(self, blob: bytes, version: int, mode: str = "append") -> None:
        self.spark.createDataFrame([(version, bytearray(blob))], "version int, model binary").coalesce(1).write.mode(mode).parquet(f"{self.path}/model")
        self._held = None

    @property
    def model(self) -> bytes:
        if self._held is None:
            self._held = bytes(self.spark.read.parquet(f"{self.path}/model").orderBy(F.desc("version")).first().model)
        return self._held

    def tune(self, queries: DataFrame, k: int = 10, target: float = 0.95, most_queries: int = 200) -> tuple[int, int]:
        """Sets probes and refine to what the exact neighbours of at most most_queries rows of queries (by a hash of their ids) ask
        for, over all rows of the index."""
        model = _model(self.model)
        asked = written(queries.orderBy(F.xxhash64("id"), "id").limit(most_queries), "asked")
        rows = self.rows()
        exact = written(knn_join(asked, rows.select("id", "key", "embedding"), k).select("q_id", "c_id"), "exact")
        n, aim = exact.count(), target**0.5
        if n:
            place = self.probed(asked, len(model.cells)).select("q_id", "bin", "place").join(rows.select("bin", F.col("id").alias("c_id")).join(exact.select("c_id").distinct(), "c_id"), "bin")
            places = exact.join(place, ["q_id", "c_id"]).groupBy("place").count().orderBy("place").collect()  # a row for each cell at most
            seen, probes = 0, len(model.cells)
            for r in places:
                seen += r["count"]
                if seen >= aim * n:
                    probes = r.place + 1
                    break
            refine, total = 16 * k, rows.count()
            while True:
                met = self.guesses(asked, refine, probes).join(exact, ["q_id", "c_id"]).groupBy("rank").count().orderBy("rank").collect()  # `refine` rows at most
                seen, enough = 0, None
                for r in met:
                    seen += r["count"]
                    if enough is None and seen >= aim * aim * n:
                        enough = r["rank"]
                if enough or refine >= total:
                    model.probes, model.refine = probes, max(2 * k, enough or refine)
                    break
                refine *= 4
            version = self.spark.read.parquet(f"{self.path}/model").agg(F.max("version")).first()[0]
            self._write(pickle.dumps(model), version + 1)
        return model.probes, model.refine

    def _coded(self, rows: DataFrame) -> DataFrame:
        """id, key, embedding, cell, codes."""
        blob, dims = self.spark.sparkContext.broadcast(self.model), _model(self.model).dims
        chosen = usable(rows).filter(F.size("embedding") == dims).select("id", "key", F.col("embedding").cast("array<float>").alias("embedding"))

        def run(batches):
            model = _model(blob.value)
            for batch in batches:
                m = unit(_matrix(batch.column(2), dims))
                codes = model.codes(m)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.cell(m), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "cell", "codes"])

        return chosen.mapInArrow(run, f"{chosen._jdf.schema().toDDL()}, cell int, codes binary")

    def append(self, rows: DataFrame) -> None:
        """Adds rows (id, key, embedding); each append has its own bins."""
        batch = uuid.uuid4().hex
        staged = f"{self.path}/staged-{batch}"
        self._coded(rows).write.parquet(staged)  # coded once, though it is counted first
        coded = self.spark.read.parquet(staged)
        sizes = coded.groupBy("key", "cell").agg(F.ceil(F.count("*") / BIN_ROWS).cast("int").alias("slots"))
        slot = F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")
        name = F.xxhash64(F.lit(batch), "key", "cell", "slot")
        counts = sizes.select(F.col("key").alias("s_key"), F.col("cell").alias("s_cell"), "slots")
        dealt = coded.join(counts, F.col("key").eqNullSafe(F.col("s_key")) & (F.col("cell") == F.col("s_cell"))).withColumn("slot", slot)
        dealt = dealt.select("id", "key", name.alias("bin"), "cell", "embedding", "codes").repartition(self.buckets, "bin")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "bin").sortBy("bin").option("path", f"{self.path}/rows").saveAsTable(self._named())
        slots = sizes.select("key", "cell", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        slots.select("key", "cell", name.alias("bin")).write.mode("append").parquet(f"{self.path}/bins")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def _named(self) -> str:
        """The rows as a table of this session, over the files of earlier ones."""
        if self._table is None:
            self._table = f"vector_rows_{uuid.uuid4().hex}"
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
            if folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
                schema = self.spark.read.parquet(f"{self.path}/rows")._jdf.schema().toDDL()
                self.spark.sql(f"CREATE TABLE {self._table} ({schema}) USING parquet CLUSTERED BY (bin) SORTED BY (bin) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")
        return self._table

    def rows(self) -> DataFrame:
        return self.spark.table(self._named())

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """q_id, bin, place (0 for the nearest cell), embedding: the bins that each query meets, by its key and nearest cells.
        queries: id, key, embedding."""
        blob, dims = self.spark.sparkContext.broadcast(self.model), _model(self.model).dims
        probes = probes or _model(self.model).probes
        chosen = usable(queries).filter(F.size("embedding") == dims).select(F.col("id").alias("q_id"), "key", F.col("embedding").cast("array<float>").alias("embedding"))

        def run(batches):
            model = _model(blob.value)
            for batch in batches:
                near = model.near(unit(_matrix(batch.column(2), dims)))[:, :probes]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "cells"])

        near = chosen.mapInArrow(run, f"{chosen._jdf.schema().toDDL()}, cells array<int>").select("q_id", "key", "embedding", F.posexplode("cells").alias("place", "cell"))
        bins = self.spark.read.parquet(f"{self.path}/bins").withColumnsRenamed({"key": "b_key", "cell": "b_cell"})
        return near.join(bins, F.col("key").eqNullSafe(F.col("b_key")) & (F.col("cell") == F.col("b_cell"))).select("q_id", "bin", "place", "embedding")

    def guesses(self, queries: DataFrame, refine: int | None = None, probes: int | None = None) -> DataFrame:
        """q_id, bin, c_id, rank: the pairs that are worth an exact product, at most `refine` for each query."""
        refine = refine or _model(self.model).refine
        rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("guess"), "c_id"))
        return self.scored(queries, refine, probes).withColumn("rank", rank).filter(F.col("rank") <= refine).select("q_id", "bin", "c_id", "rank")

    def scored(self, queries: DataFrame, refine: int, probes: int | None = None) -> DataFrame:
        """q_id, bin, c_id, guess: at most `refine` pairs of each query and shelf."""
        blob, dims = self.spark.sparkContext.broadcast(self.model), _model(self.model).dims
        probes = probes or _model(self.model).probes

        def run(q: pa.Table, rows: pa.Table) -> pa.Table:
            model, out = _model(blob.value), []
            if q.num_rows and rows.num_rows:
                ids, cells, bins = (rows[c].to_numpy() for c in ("id", "cell", "bin"))
                codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
                vectors = unit(_matrix(q["embedding"].combine_chunks(), dims))
                near = model.near(vectors)[:, :probes]
                order = np.argsort(near[:, 0], kind="stable")  # queries of one cell share their cells
                asked, vectors, near = q["id"].to_numpy()[order], vectors[order], near[order]
                for a in range(0, len(asked), AT_ONCE):
                    own = asked[a : a + AT_ONCE]
                    met = np.zeros((len(own), len(model.cells)), bool)
                    met[np.arange(len(own))[:, None], near[a : a + AT_ONCE]] = True
                    here = np.flatnonzero(met.any(0)[cells])
                    scores = model.guessed(vectors[a : a + AT_ONCE], cells[here], codes[here])
                    scores = np.where(met[:, cells[here]] & (own[:, None] != ids[here][None]), scores, -np.inf)
                    col = np.argpartition(-scores, refine - 1, axis=1)[:, :refine] if len(here) > refine else np.tile(np.arange(len(here)), (len(own), 1))
                    got = np.take_along_axis(scores, col, 1).ravel()
                    row, col, fine = np.repeat(np.arange(len(own)), col.shape[1]), here[col.ravel()], got > -np.inf
                    out.append((own[row[fine]], bins[col[fine]], ids[col[fine]], got[fine].astype(np.float64)))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * 4
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("q_id", "bin", "c_id", "guess"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})

        key = F.struct("key").alias("key")
        chosen = usable(queries).filter(F.size("embedding") == dims).select("id", key, F.col("embedding").cast("array<float>").alias("embedding"))
        listed = self.spark.read.parquet(f"{self.path}/bins").select("bin")
        coded = self.rows().join(listed, "bin", "left_semi").select("id", key, "bin", "cell", "codes")
        asked, rows = block_pairs(chosen, coded, Q_ROWS, SHELF_ROWS)
        by, n = ["key", "q_block", "c_block"], tasks(self.spark)
        return asked.repartition(n, *by).groupBy(*by).cogroup(rows.repartition(n, *by).groupBy(*by)).applyInArrow(run, "q_id long, bin long, c_id long, guess double")

    def search(self, queries: DataFrame, k: int, refine: int | None = None) -> DataFrame:
        """(q_id, c_id, cosine, rank) of the k nearest that are found, with exact cosines."""
        dims = _model(self.model).dims
        pairs = self.guesses(queries, max(refine or _model(self.model).refine, k)).drop("rank")
        rows = self.rows().select("bin", F.col("id").alias("c_id"), F.col("embedding").alias("vector"))
        asked = usable(queries).select(F.col("id").alias("q_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        whole = pairs.join(rows, ["bin", "c_id"]).join(asked, "q_id").select("q_id", "c_id", "embedding", "vector")

        def products(batches):
            for batch in batches:
                scores = (unit(_matrix(batch.column(2), dims)) * unit(_matrix(batch.column(3), dims))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(np.round(scores, 12), -1, 1))], names=["q_id", "c_id", "cosine"])

        found = whole.mapInArrow(products, "q_id long, c_id long, cosine double")
        rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("cosine"), "c_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def statistics(self) -> DataFrame:
        """key, vectors, cells, bins, code_mb and vector_mb of what is indexed."""
        model = _model(self.model)
        sizes = self.rows().groupBy("bin").agg(F.count("*").alias("n"))
        bins = self.spark.read.parquet(f"{self.path}/bins").join(sizes, "bin")
        mb = lambda width: F.round(F.sum("n") * width / 1e6, 3)
        return bins.groupBy("key").agg(F.sum("n").alias("vectors"), F.count_distinct("cell").alias("cells"), F.count("*").alias("bins"), mb(len(model.books)).alias("code_mb"), mb(4 * model.dims).alias("vector_mb"))
