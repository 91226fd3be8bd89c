"""Catalog CSV in and out. Files of any separator are read as text columns, cleaned and typed by Column functions."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import history as H
from ..functions import text as T
from . import csv_ranges

COLUMNS = ["filename", "category", "sku", "name", "price", "price_history", "performance_history"]
KNOWN = ["filename", "category", "sku", "name", "price", "product", "file"]


def separator(line: str) -> str:
    """The most frequent of tab, semicolon and comma outside quotes."""
    plain = "".join(line.split('"')[::2])
    return max(",\t;", key=lambda s: (plain.count(s), s == ","))


FEW_FILES, HEAD_BYTES = 1000, 1 << 16


def _heads(spark: SparkSession, files: list[str]) -> dict[str, str] | None:
    """The first line of each file that is not blank, from its first bytes; None where that cannot be told from them: for many
    files, which tasks should read, compressed ones, and lines longer than that."""
    if len(files) > FEW_FILES or any(f.rsplit(".", 1)[-1] in ("gz", "bz2", "zst", "snappy", "lz4", "deflate") for f in files):
        return None
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        stream = path.getFileSystem(conf).open(path)
        try:
            data = bytes(stream.readNBytes(HEAD_BYTES))
        finally:
            stream.close()
        lines = re.split("\r\n|\r|\n", data.decode("utf-8", "replace").removeprefix("\ufeff"))
        whole = lines if len(data) < HEAD_BYTES else lines[:-1]
        line = next((x for x in whole if x.strip()), None)
        if line is None and len(data) == HEAD_BYTES:
            return None
        out[f] = line or ""
    return out


def layouts(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(first line, files) for each first line that files under path begin with. The driver holds the files' names, as it does
    to read them, and one line for each layout; of up to FEW_FILES files it reads the first bytes, of more the tasks read all."""
    text = spark.read.text(path)
    if (heads := _heads(spark, text.inputFiles())) is not None:
        found: dict[str, list[str]] = {}
        for f, line in sorted(heads.items()):
            found.setdefault(line, []).append(f)
        return sorted(found.items())
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.filter("at = 0").withColumn("n", F.monotonically_increasing_id())
    bom = F.regexp_replace("value", "^\ufeff", "")
    first = lines.groupBy("file").agg(F.min_by(bom, F.when(F.trim(bom) != "", F.col("n"))).alias("line"))
    rows = first.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("line").collect()
    return [(r.line or "", r.files) for r in rows]


def read(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of files as text: row (their order: files by name, then lines), the standard columns that a file's header names, or
    by position without a header. Each file may have its own separator and header. multi_line: cells may hold line breaks
    (sources.csv_ranges). Large files are split either way. Empty rows stay; clean() drops them."""
    found = [(head, [_key(f) for f in files]) for head, files in layouts(spark, path)]
    order = {f: i for i, f in enumerate(sorted(f for _, files in found for f in files))}
    parts = [_read(spark, head, files, multi_line) for head, files in found]
    if not parts:
        return spark.createDataFrame([], ", ".join(["row long", *(f"{c} string" for c in COLUMNS)]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    places = spark.createDataFrame(list(order.items()), "_file string, _place long")
    # a whole split is a partition of its own, so the number in a partition is less than where the next split of the file begins
    row = F.call_function("shiftleft", F.col("_place"), F.lit(42)) + F.col("_at") + F.col("_n")
    named = [c for c in out.columns if not c.startswith("_")]
    return out.withColumn("_file", F.regexp_replace("_file", "^file:/+", "file:/")).join(places, "_file").select(row.alias("row"), *named)


def _key(file: str) -> str:
    """A file's name as Spark's metadata column has it."""
    return re.sub("^file:/+", "file:/", file)


def _read(spark: SparkSession, head: str, files: list[str], multi_line: bool) -> DataFrame:
    """The rows of files that begin with one line; _file, _at (where their split begins) and _n (number in the partition)."""
    files = [unquote(f) for f in files]
    sep = separator(head)
    cells = [c.strip().strip('"').lower() for c in head.split(sep)]
    has_header = any(k in c for c in cells for k in KNOWN)
    width = max(len(cells), len(COLUMNS)) if not has_header else len(cells)
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    if multi_line:
        raw = csv_ranges.records(spark, files, sep)
        if has_header:  # the first record that is not blank
            head = raw.filter((F.col("at") == 0) & (F.trim(F.regexp_replace("value", "^\ufeff", "")) != "")).groupBy("file").agg(F.min("n").alias("_head"))
            raw = raw.join(F.broadcast(head), "file", "left").filter(~((F.col("at") == 0) & (F.col("n") <= F.coalesce("_head", F.lit(-1)))))  # a row for each file
        cells_of = F.from_csv(F.regexp_replace("value", "^\ufeff", ""), F.lit(schema), {k: str(v) for k, v in options.items()})
        raw = raw.filter(F.col("value") != "").select("file", "at", "n", cells_of.alias("c")).select("file", "at", "n", "c.*")
        file, at, n = F.col("file"), F.col("at"), F.col("n")
    else:
        raw = spark.read.schema(schema).options(encoding="UTF-8", header=has_header, enforceSchema=True, **options).csv(files)
        file, at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        n = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    if has_header:
        names: dict[str, str] = {}
        for i, c in enumerate(cells):
            names.setdefault(T.header_name(c) or f"column_{i}", f"c{i}")
    else:
        names = {c: f"c{i}" for i, c in enumerate(COLUMNS)}
    return raw.select(file.alias("_file"), at.alias("_at"), n.alias("_n"), *(F.col(v).alias(k) for k, v in names.items()), *(F.lit(None).cast("string").alias(c) for c in COLUMNS if c not in names))


def clean(raw: DataFrame) -> DataFrame:
    """Cells sanitized, empty rows gone, price a number (null if unreadable) with price_error."""
    cells = [c for c in COLUMNS if c in raw.columns]
    out = raw.withColumns({c: T.sanitize_field(F.col(c)) for c in cells})
    some = F.lit(False)
    for c in cells:
        some = some | (F.col(c) != "")
    price = T.parse_price(F.col("price"))
    return out.filter(some).withColumns({"price_error": (F.col("price") != "") & price.isNull(), "price": price})


def last_by_filename(rows: DataFrame) -> DataFrame:
    """The last row of each file name; rows without one go."""
    rest = [c for c in rows.columns if c not in ("filename", "row")]
    last = rows.filter("filename <> ''").groupBy("filename").agg(F.max_by(F.struct("row", *rest), "row").alias("r"))
    return last.select("filename", *(F.col(f"r.{c}").alias(c) for c in ["row", *rest]))


def split_line(line: Column, sep: str = ",") -> Column:
    """Cells of a text column that holds single lines."""
    names = [f"c{i}" for i in range(len(COLUMNS))]
    got = F.from_csv(line, F.lit(", ".join(f"{n} string" for n in names)), {"sep": sep, "quote": '"', "escape": '"'})
    return F.array(*(T.sanitize_field(got[n]) for n in names))


def typed(rows: DataFrame, as_of: Column) -> DataFrame:
    """Cleaned rows with parsed histories (arrays, null without entries)."""
    return rows.withColumns({"prices": H.price_history(F.col("price_history"), as_of), "sales_history": H.performance_history(F.col("performance_history"), as_of)})


def to_csv_columns(rows: DataFrame) -> DataFrame:
    """The seven columns of a catalog CSV from typed rows."""
    return rows.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COLUMNS[:5]),
        F.coalesce(H.write_prices(F.col("prices")), F.lit("")).alias("price_history"), F.coalesce(H.write_sales(F.col("sales_history")), F.lit("")).alias("performance_history"),
    )


def write(rows: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    rows.write.mode(mode).options(header=True, sep=sep, quote='"', escape='"', emptyValue="").csv(path)


def template(images: DataFrame) -> DataFrame:
    """A row to fill in for each image."""
    return images.select("filename", F.coalesce("category", F.lit("")).alias("category"), *(F.lit("").alias(c) for c in COLUMNS[2:]))

