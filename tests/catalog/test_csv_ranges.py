import random

import pytest
from pyspark.sql import functions as F

from skuweave.sources import csv, csv_ranges

COLUMNS = ["filename", "category", "sku", "name", "price"]


@pytest.fixture
def small_ranges(spark):
    """Ranges of about a kilobyte."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell(rnd, sep):
    text = rnd.choice(["plain", "", 'say ""hi""', "two\nlines", "a\n\n\nb", f"x{sep}y", "end\n", "\nstart", "é" * 20, f'q"" {sep}\n""', "long\n" * 30])
    return f'"{text}"' if any(x in text for x in ('"', "\n", sep)) else rnd.choice([text, f'"{text}"', f' "{text}" ', '5" pipe' if text == "plain" else text])


@pytest.mark.parametrize(("sep", "end"), [(",", "\n"), (";", "\r\n"), ("\t", "\n")])
def test_ranges_equal_whole_files(spark, tmp_path, small_ranges, sep, end):
    rnd = random.Random(8)
    for f in range(3):
        lines = [sep.join(COLUMNS)] + [sep.join([f"f{f}-{i}.jpg", *(cell(rnd, sep) for _ in range(3)), "1.5"]) for i in range(200)]
        (tmp_path / f"in {f}.csv").write_bytes(("﻿" * (f == 1) + end.join(lines) + end * (f != 2)).encode())
    options = {"sep": sep, "quote": '"', "escape": '"', "header": True, "multiLine": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    want = {tuple(r) for r in spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).options(**options).csv(str(tmp_path)).collect()}
    found = csv.read(spark, str(tmp_path), multi_line=True)
    rows = found.orderBy("row").collect()
    assert {tuple(r[c] for c in COLUMNS) for r in rows} == want and len(rows) == 600
    assert [r.filename for r in rows] == [f"f{f}-{i}.jpg" for f in range(3) for i in range(200)]
    ranges = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).distinct().count()
    assert ranges > 30  # a file is many tasks


def test_a_cell_spans_ranges(spark, tmp_path, small_ranges):
    text = "\n".join(f"line {i} without end" for i in range(400))
    (tmp_path / "a.csv").write_text(f'filename,name,price\na.jpg,"{text}",1\nb.jpg,after,2\n')
    rows = csv.read(spark, str(tmp_path / "a.csv"), multi_line=True).orderBy("row").collect()
    assert [(r.filename, r.name, r.price) for r in rows] == [("a.jpg", text, "1"), ("b.jpg", "after", "2")]


def test_a_quote_that_is_never_closed(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(csv_ranges, "MOST_LINES", 50)
    (tmp_path / "a.csv").write_text('filename,name\na.jpg,"open\n' + "more\n" * 300)
    with pytest.raises(Exception, match="never closed"):
        csv.read(spark, str(tmp_path / "a.csv"), multi_line=True).collect()


def test_heads_are_read_from_the_first_bytes(spark, tmp_path, monkeypatch):
    for i, head in enumerate(("filename,sku", "\n\n  \nfilename;name", "")):
        (tmp_path / f"{i}.csv").write_text(head + "\nx,y\n" * bool(head))
    want = [("", 1), ("filename,sku", 1), ("filename;name", 1)]
    assert [(h, len(f)) for h, f in csv.layouts(spark, str(tmp_path))] == want
    monkeypatch.setattr(csv, "FEW_FILES", 0)
    assert [(h, len(f)) for h, f in csv.layouts(spark, str(tmp_path))] == want[1:]  # a file without any line has none to show
    (tmp_path / "long.csv").write_text("x" * 100_000)
    monkeypatch.setattr(csv, "FEW_FILES", 9)
    assert ("x" * 100_000, 1) in [(h, len(f)) for h, f in csv.layouts(spark, str(tmp_path))]


@pytest.mark.parametrize(("line", "out", "inside"), [("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, True), ('b",c', False, False), ('b","c', True, False), ('5" pipe', False, True), ('x,"a""', True, False), ('"', True, False)])
def test_states(line, out, inside):
    q = csv_ranges.Quotes(",")
    assert q.after(line, False) == out
    if line.startswith(("a,b", "b")):
        assert q.after(line, True) == (inside if line != 'b","c' else True)
