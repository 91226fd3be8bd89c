"""Reading CSV with line breaks inside quotes by byte ranges, so that a large file is many tasks.

Spark's text source deals out ranges of lines. Whether a line stands inside quotes depends on all lines before it, but for each
line that is a function of two states (in or out), and such functions compose. A first pass finds the function of each range,
and the line at which a record that is open at its end began; composed in order of the ranges, these tell each range its state.
A second pass marks the lines: most are whole records and stay where they are; only lines of records with line breaks are
shuffled, by where their record began, and joined.

A quote opens a cell only at its start and closes it only at its end, so stray quotes inside cells change nothing. Line breaks
in cells become \\n. A record of more than MOST_LINES lines is taken for a quote that is never closed, and is an error.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_LINES = 10_000


class Quotes:
    """How lines change the state. sep: the separator of cells."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        self.closed = re.compile(rf'(^|{s})[ \t]*"(?:[^"]|"")*"(?=[ \t]*(?:{s}|$))')
        self.open = re.compile(rf'(?:^|{s})[ \t]*"(?:[^"]|"")*$')
        self.close = re.compile(rf'^(?:[^"]|"")*"(?=[ \t]*(?:{s}|$))')

    def after(self, line: str, inside: bool) -> bool:
        """Whether a line leaves a cell open, from its state before."""
        if inside:
            if not (m := self.close.match(line)):
                return True
            line = "x" + line[m.end() :]  # the rest of a cell is no start of one
        return bool(self.open.search(self.closed.sub(r"\1", line)))


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, at (where the range begins), value. The lines of a range follow each other in one task."""
    rows = spark.read.text(files)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _ranges(batches):
    """(file, at, number of the first line here, lines) for each run of lines of one range in a batch."""
    last, n = None, 0
    for batch in batches:
        files, ats = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(ats) != 0) | (np.diff(codes) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                key = (files[a].as_py(), int(ats[a]))
                n = n if key == last else 0
                yield *key, n, batch.column(2).slice(a, b - a)
                last, n = key, n + b - a


def _summaries(lines: DataFrame, sep: str) -> DataFrame:
    """For each range its number of lines and, from either state before it: the state after it, and the line where a record that
    is open then began (-1: before the range)."""

    def run(batches):
        quotes, out = Quotes(sep), {}
        for file, at, first, values in _ranges(batches):
            state = out.setdefault((file, at), [0, False, -1, True, -1])
            state[0] = first + len(values)
            for i in np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist():
                line = values[i].as_py()
                for k in (1, 3):
                    before, state[k] = state[k], quotes.after(line, state[k])
                    if state[k] and not before:
                        state[k + 1] = first + i
        rows = [(*key, *state) for key, state in out.items()]
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "at", "n", "out", "out_line", "in", "in_line"])

    return lines.mapInArrow(run, "file string, at long, n long, out boolean, out_line long, `in` boolean, in_line long")


def starts(summaries: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each range whether it begins inside a cell, and where the record of that cell began (range, line). A row for each range
    is no more than the driver holds to read the files."""
    by_file, found = defaultdict(list), {}
    for r in summaries:
        by_file[r["file"]].append(r)
    for file, rows in by_file.items():
        inside, at, line = False, 0, 0
        for r in sorted(rows, key=lambda r: r["at"]):
            found[file, r["at"]] = (inside, at, line)
            began = r["in_line"] if inside else r["out_line"]
            inside = r["in"] if inside else r["out"]
            if inside and began >= 0:
                at, line = r["at"], began
    return found


def records(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """file, at, n (where a record begins: range and line) and value, its text with line breaks, for each record of the files."""
    lines = _lines(spark, files)
    known = spark.sparkContext.broadcast(starts(_summaries(lines, sep).collect()))

    def run(batches):
        quotes, last, open_ = Quotes(sep), None, None
        for file, at, first, values in _ranges(batches):
            if (file, at) != last:
                inside, *began = known.value[file, at]
                open_, last = tuple(began) if inside else None, (file, at)
            start_at, start_n, whole = np.full(len(values), at, np.int64), first + np.arange(len(values), dtype=np.int64), np.ones(len(values), bool)
            quoted, done = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist(), 0
            for i in [*quoted, len(values)]:
                if open_:  # lines without quotes change nothing
                    start_at[done:i], start_n[done:i], whole[done:i] = open_[0], open_[1], False
                if i < len(values):
                    line = values[i].as_py()
                    after = quotes.after(line, bool(open_))  # a line that closes one cell and opens another is of one record
                    if open_:
                        start_at[i], start_n[i], whole[i] = open_[0], open_[1], False
                    elif after:
                        whole[i] = False
                    open_ = (open_ or (at, first + i)) if after else None
                done = i + 1
            seq = first + np.arange(len(values), dtype=np.int64)
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(start_at), pa.array(start_n), pa.array(whole), pa.array(np.full(n, at, np.int64)), pa.array(seq), values.cast(pa.string())], names=["file", "at", "n", "whole", "own_at", "own_n", "value"])

    marked = lines.mapInArrow(run, "file string, at long, n long, whole boolean, own_at long, own_n long, value string")
    single = marked.filter("whole").select("file", "at", "n", "value")
    pieces = marked.filter("not whole").groupBy("file", "at", "n").agg(F.sort_array(F.collect_list(F.struct("own_at", "own_n", "value"))).alias("lines"))
    long = F.size("lines") > MOST_LINES
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    joined = pieces.select("file", "at", "n", F.when(long, F.raise_error(F.concat("file", F.lit(": a quote is never closed"))).cast("string")).otherwise(text).alias("value"))
    return single.unionByName(joined)
