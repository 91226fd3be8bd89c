"""Catalog snapshots: folders of Parquet tables, and a log of commits that says which folders each snapshot is made of.

A snapshot is written in two steps: the folders of its tables, under names that no other has, then one row of the log, one file that
appears as a whole. A run that dies in between leaves folders that nothing names (vacuum() deletes them) and can be repeated.
Tables that a new snapshot does not change are the folders of the old one. Nothing is ever written twice in one place, so readers of
a snapshot are never disturbed.
"""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.maintain import numbered

TABLES = ["products", "features", "price_history", "performance_history", "matches"]
META = "name string, created_at timestamp, version string, description string, is_historical boolean, tags array<string>, last_modified timestamp"
COMMIT = f"{META}, number long, commit string, gone boolean, folders map<string, array<string>>"
ACTIVE = "number long, side string, snapshot string, loaded_at timestamp"


class Snapshots:
    """Under root: _data/<table>-<name of its own>, _commits with a row for each commit, _active with the rows of each choice of
    active snapshots; the log is as long as the history of snapshots, and read by the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _live(self) -> dict:
        """The commit that holds for each name: the first since its last removal, so of two runs that create one name one wins."""
        live: dict = {}
        for r in sorted(self._read(f"{self.root}/_commits", COMMIT).collect(), key=lambda r: (r.number, r.commit)):
            if r.gone:
                live.pop(r.name, None)
            else:
                live.setdefault(r.name, r)
        return live

    def _commit(self, row: tuple, folders: dict[str, list[str]], gone: bool = False) -> None:
        number = (self._read(f"{self.root}/_commits", COMMIT).agg(F.max("number")).first()[0] or 0) + 1
        commit = uuid.uuid4().hex
        self.spark.createDataFrame([(*row, number, commit, gone, folders)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")
        if not gone and self._live()[row[0]]["commit"] != commit:
            raise ValueError(f"another run has created the snapshot {row[0]}")

    def _put(self, table: str, rows: DataFrame) -> list[str]:
        folder = f"{table}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/_data/{folder}")
        return [folder]

    def create(self, name: str, catalog: dict[str, DataFrame], is_historical: bool, as_of: datetime.datetime, description: str = "", tags: tuple[str, ...] = ()) -> None:
        """Writes the tables of one side; an existing name is refused."""
        if name in self._live():
            raise ValueError(f"SNAPSHOT_EXISTS: the snapshot {name} exists")
        products = catalog["products"].filter(F.col("is_historical") == is_historical)
        ids = products.select(F.col("id").alias("product_id"))
        folders = {"products": self._put("products", products)}
        for table in TABLES[1:4]:
            if table in catalog:
                folders[table] = self._put(table, catalog[table].join(ids, "product_id", "left_semi").select(catalog[table].columns))
        self._commit((name, as_of, "1.0", description, is_historical, list(tags), as_of), folders)

    def derive(self, name: str, base: str, changed: dict[str, DataFrame], as_of: datetime.datetime, description: str = "") -> None:
        """A snapshot that shares the tables of base but for those in changed."""
        live = self._live()
        if name in live:
            raise ValueError(f"SNAPSHOT_EXISTS: the snapshot {name} exists")
        old = live[base]
        folders = {**old.folders, **{t: self._put(t, rows) for t, rows in changed.items()}}
        self._commit((name, as_of, old.version, description, old.is_historical, list(old.tags), as_of), folders)

    def free_name(self, stem: str) -> str:
        """stem, with a number if snapshots of that name exist."""
        live, n, name = self._live(), 1, stem
        while name in live:
            n += 1
            name = f"{stem}_{n}"
        return name

    def save_before(self, catalog: dict[str, DataFrame], is_historical: bool, as_of: datetime.datetime) -> str:
        """The snapshot that a replacement of one side takes first: auto_<time>, which is returned."""
        name = self.free_name(f"auto_{as_of:%Y%m%d_%H%M%S}")
        self.create(name, catalog, is_historical, as_of, "Before a replacement")
        return name

    def load(self, name: str) -> dict[str, DataFrame]:
        live = self._live()
        if name not in live:
            raise ValueError(f"there is no snapshot {name}")
        return {t: self.spark.read.option("mergeSchema", True).parquet(*(f"{self.root}/_data/{f}" for f in live[name].folders[t])) for t in TABLES if t in live[name].folders}

    def files(self, name: str) -> dict[str, list[str]]:
        """The folders of a snapshot's tables."""
        return dict(self._live()[name].folders)

    def remove(self, name: str, as_of: datetime.datetime) -> None:
        if name not in self._live():
            raise ValueError(f"there is no snapshot {name}")
        self._commit((name, as_of, "1.0", "", None, [], as_of), {}, gone=True)

    def vacuum(self) -> int:
        """Deletes the folders that no snapshot names, and returns their number; not while a run creates one."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        data = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_data")
        fs, n = data.getFileSystem(conf), 0
        named = {f for r in self._live().values() for fs_ in r.folders.values() for f in fs_}
        for status in fs.listStatus(data) if fs.exists(data) else []:
            if status.getPath().getName() not in named:
                n += fs.delete(status.getPath(), True)
        return n

    def list(self) -> DataFrame:
        """By side, newest first."""
        names = [c.split()[0] for c in META.split(", ")]
        rows = [tuple(r[c] for c in names) for r in self._live().values()]
        return self.spark.createDataFrame(rows, META).orderBy(F.desc("is_historical"), F.desc("created_at"), "name")

    def info(self, name: str) -> DataFrame:
        """(snapshot, category, n), and the count of all as a row with the category `*`."""
        return info({name: self.load(name)["products"]})

    def merge(self, names: list[str], new_name: str, is_historical: bool, as_of: datetime.datetime) -> None:
        """One snapshot of several. Products are numbered anew in the order of the snapshots; tables of the first that this
        leaves as they are, because its ids are 1 to n and its side is the new one, are shared."""
        if len(names) < 2:
            raise ValueError("a merge takes two snapshots at least")
        live = self._live()
        if new_name in live:
            raise ValueError(f"SNAPSHOT_EXISTS: the snapshot {new_name} exists")
        catalogs, first = [self.load(n) for n in names], live[names[0]]
        size = catalogs[0]["products"].agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
        whole = first.is_historical == is_historical and size.n == size.ids == size.hi and size.lo == 1
        shared = [t for t in TABLES[:4] if t in catalogs[0]] if whole else []
        if "features" in shared and not catalogs[0]["features"].groupBy("product_id").count().filter("count > 1").isEmpty():
            shared.remove("features")
        folders = {}
        for table, rows in merged(catalogs, is_historical).items():
            if table in shared:
                column = "id" if table == "products" else "product_id"
                folders[table] = [*first.folders[table], *self._put(table, rows.filter(F.col(column) > size.n))]
            else:
                folders[table] = self._put(table, rows)
        self._commit((new_name, as_of, "1.0", f"Merged from {', '.join(names)}", is_historical, [], as_of), folders)

    def set_active(self, historical: list[str], new: list[str], as_of: datetime.datetime) -> None:
        number = (self._read(f"{self.root}/_active", ACTIVE).agg(F.max("number")).first()[0] or 0) + 1
        rows = [(number, "historical", n, as_of) for n in historical] + [(number, "new", n, as_of) for n in new]
        self.spark.createDataFrame(rows or [(number, None, None, as_of)], ACTIVE).coalesce(1).write.mode("append").parquet(f"{self.root}/_active")

    def active(self) -> DataFrame:
        rows = self._read(f"{self.root}/_active", ACTIVE)
        last = rows.agg(F.max("number")).first()[0]
        return rows.filter((F.col("number") == F.lit(last)) & F.col("side").isNotNull()).drop("number")

    def active_union(self, side: str) -> DataFrame:
        names = [r.snapshot for r in self.active().filter(F.col("side") == side).orderBy("snapshot").collect()]
        if not names:
            raise ValueError(f"no active snapshot on the side {side}")
        return union({n: self.load(n)["products"] for n in names})

    def load_as_main(self, name: str, main: dict[str, DataFrame], as_of: datetime.datetime) -> dict[str, DataFrame]:
        """The main catalog with the snapshot in place of its side; the side is saved first, as backup_<time>."""
        side = self._live()[name].is_historical
        self.create(self.free_name(f"backup_{as_of:%Y%m%d_%H%M%S}"), main, side, as_of, f"Before loading {name}")
        loaded = self.load(name)
        other = main["products"].filter(F.col("is_historical") != side)
        keep = other.select(F.col("id").alias("product_id"))
        out = {t: main[t].join(keep, "product_id", "left_semi").select(main[t].columns) for t in TABLES[1:4] if t in main}
        return merged([{"products": other, **out}, loaded])


def union(snapshots: dict[str, DataFrame]) -> DataFrame:
    """Products of several snapshots, with the column snapshot."""
    parts = [p.withColumn("snapshot", F.lit(n)) for n, p in snapshots.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def info(snapshots: dict[str, DataFrame]) -> DataFrame:
    rows = union(snapshots).groupBy("snapshot", F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(F.count("*").alias("n"))
    return rows.unionByName(rows.groupBy("snapshot").agg(F.lit("*").alias("category"), F.sum("n").alias("n")).select("snapshot", "category", "n"))


def merged(catalogs: list[dict[str, DataFrame]], is_historical: bool | None = None) -> dict[str, DataFrame]:
    """One catalog: products with new ids in the order of the catalogs and their old ids, the first feature row of each, and
    histories. is_historical overwrites the side."""
    tag = lambda table: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c[table].withColumn("_from", F.lit(i)) for i, c in enumerate(catalogs) if table in c])
    products = tag("products").withColumnRenamed("id", "_old")
    products = numbered(products, 0, ["_from", "_old"])
    ids = products.select("_from", F.col("_old").alias("product_id"), F.col("id").alias("_new"))
    if is_historical is not None:
        products = products.withColumn("is_historical", F.lit(is_historical))
    out = {"products": products.select(["id", *(c for c in catalogs[0]["products"].columns if c != "id")])}
    for table in TABLES[1:4]:
        if any(table in c for c in catalogs):
            rows = tag(table).join(ids, ["_from", "product_id"]).withColumn("product_id", F.col("_new")).drop("_from", "_new")
            if table == "features":
                first = F.row_number().over(W.partitionBy("product_id").orderBy(*[c for c in ("created_at", "id") if c in rows.columns] or [F.lit(0)]))
                rows = rows.withColumn("_r", first).filter("_r = 1").drop("_r")
            out[table] = rows
    return out


def main_stats(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("total"), F.count_if("is_historical").alias("historical"), F.count_if(~F.col("is_historical")).alias("new"))
