"""Helpers that several operators share: shared folders, word rules, joins on skewed keys, scans over arrays."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_folder: list[str] = []


_written: list[str] = []
_tables: list[str] = []
_paths: dict[int, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder on a
    single machine; on a cluster an error, as no other folder is known to be shared."""
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir"):
        return base
    if conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="skuweave-"))
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives a lost executor. Results read these
    tables, so they stay until remove_written()."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() has made, once all that was computed from them is written as well."""
    for df in tables:
        held, path = _paths.pop(id(df), (lambda: None, None))
        if held() is df and path in _written:
            _written.remove(path)
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether there was one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))


def slices(batch: pa.RecordBatch, column: int | str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `most` bytes of text."""
    if batch.num_rows:
        at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def new_table(name: str) -> str:
    _tables.append(f"{name}_{uuid.uuid4().hex}")
    return _tables[-1]


def remove_written(spark: SparkSession) -> int:
    """Deletes what this process has written to the shared folder, and its own tables (not an index that a caller has named);
    for the time when results have been used. The number of folders and tables."""
    n = 0
    while _written:
        n += delete(spark, _written.pop())
    while _tables:
        n += spark.catalog.tableExists(_tables[-1])
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    return n


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Spark's lower() does the same, faster, to texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def heavy_keys(counts: DataFrame, key: str, n: str, most: int = 2048) -> DataFrame:
    """The keys that hold more than one part in `most` of all rows. Fewer than `most` keys can do so, whatever the input,
    so this side may be broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) > total / most)


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str, most: int = 2048) -> DataFrame:
    """rows joined with the one row that table has for each key (inner; no null keys). The column n of the table counts
    the rows of a key. Keys with many rows are joined by a broadcast of at most `most` table rows, so that their rows stay
    where they are; the others are shuffled by key."""
    heavy = heavy_keys(table, key, n, most)
    marked = rows.join(F.broadcast(heavy.select(key, F.lit(True).alias("_heavy"))), key, "left")
    few = marked.filter("_heavy").drop("_heavy").join(F.broadcast(heavy), key)
    rest = marked.filter("_heavy is null").drop("_heavy").join(table, key)
    return few.unionByName(rest)


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of other names, which clash with none, and these names by the old ones."""
    names = {c: f"_column{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def unmasked(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()))


def _met(docs: DataFrame, wanted: DataFrame, id: str, there: bool) -> DataFrame:
    """The rows of docs whose hashed id is (or isn't) among those of wanted (rep). The hashes are a bitmap of 2 ** 25 bits, 64 in
    a row: at most 2 ** 19 rows are broadcast, whatever the input."""
    rows, names = masked(docs)
    place = lambda c: F.xxhash64(F.col(c)).bitwiseAND(F.lit(2**25 - 1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    words = wanted.select(F.shiftright(place("rep"), 6).alias("_word"), bit("rep").alias("b")).groupBy("_word").agg(F.bit_or("b").alias("_bits"))
    met = rows.withColumns({"_at": F.shiftright(place(names[id]), 6), "_bit": bit(names[id])}).join(F.broadcast(words), F.col("_at") == F.col("_word"), "inner" if there else "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return unmasked(met.filter(hit if there else ~hit), names)


def likely(docs: DataFrame, wanted: DataFrame, id: str) -> DataFrame:
    """The rows of docs whose hashed id is among those of wanted (rep): all of those wanted and few others, so that few texts
    are shuffled."""
    return _met(docs, wanted, id, True)


def unlikely(docs: DataFrame, wanted: DataFrame, id: str) -> DataFrame:
    """The other rows: surely none of those wanted."""
    return _met(docs, wanted, id, False)


def without(docs: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    """The rows of docs whose id is not among those of gone (rep). Only rows that may be among them are shuffled."""
    rows, names = masked(likely(docs, gone, id))
    rest = rows.join(gone.select("rep").distinct(), F.col(names[id]).eqNullSafe(F.col("rep")), "left_anti")
    return unlikely(docs, gone, id).unionByName(unmasked(rest, names))


def bound(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, highest: bool = False) -> Column:
    """For each place of an array of numbers (bigint) the sum of the values before it (or the highest of them, at least 0).
    Arrays are cut into about sqrt(n) pieces, so that the time for n values is about n * sqrt(n)."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    add = (lambda a, b: F.greatest(a, b)) if highest else (lambda a, b: a + b)
    state = F.struct(zero.alias("at"), none.alias("out"))
    scan = lambda xs: F.aggregate(xs, state, lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def pieces(xs, step):
        last = F.floor((F.size(xs) - 1) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: scan(F.slice(xs, i * step + 1, step)))

    def moved(ps):
        starts = scan(F.transform(ps, lambda p: p["at"]))["out"]
        return F.flatten(F.zip_with(ps, starts, lambda p, start: F.transform(p["out"], lambda v: add(v, start))))

    step = lambda xs: F.ceil(F.sqrt(F.size(xs))).cast("int")
    return bound(values, lambda xs: F.when(F.size(xs) > 0, bound(step(xs), lambda n: bound(pieces(xs, n), moved))).otherwise(none))
