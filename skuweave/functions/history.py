"""Price and sales histories in text: parsing, dating and writing them, as Column functions.

`as_of` is the day from which undated entries are dated back; nothing here reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_number, strip

KEEP = 12
PRICES = "array<struct<date:date,price:double>>"
SALES = "array<struct<date:date,sales:bigint,views:bigint,conversion_rate:double,revenue:double>>"


def parse_date(c: Column) -> Column:
    """ISO, then month/day/year, then a few spelled forms; null otherwise."""
    x = strip(c)
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))
    us = F.when(x.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(x, "M/d/yyyy"))
    rest = F.when(~x.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}/\d{1,2}/\d{4}$"), F.coalesce(*(F.try_to_date(x, p) for p in ("yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss"))))
    return F.coalesce(iso, us, rest)


def _parts(c: Column) -> Column:
    return F.filter(F.split(strip(c), "[;,]"), lambda x: strip(x) != "")


def last(rows: Column, n: int = KEEP) -> Column:
    """The n latest; rows begin with their date."""
    ordered = F.array_sort(rows)
    return F.slice(ordered, F.greatest(F.size(ordered) - n + 1, F.lit(1)), n)


def none_if_empty(rows: Column) -> Column:
    return F.when(F.size(rows) > 0, rows)


def price_history(c: Column, as_of: Column) -> Column:
    """`date:price` entries, or prices alone, which are a month apart and end at as_of; ';' or ',' between them. The twelve
    latest by date; null if none is valid."""
    parts = _parts(c)
    pair = lambda x: F.split(x, ":")
    dated = F.transform(parts, lambda x: F.struct(parse_date(F.get(pair(x), 0)).alias("date"), parse_number(F.get(pair(x), 1)).alias("price")))
    bare = F.transform(parts, lambda x, i: F.struct(F.add_months(as_of, i - F.size(parts) + 1).alias("date"), parse_number(x).alias("price")))
    rows = F.when(c.contains(":"), dated).otherwise(bare)
    rows = F.filter(rows, lambda r: r["date"].isNotNull() & (r["price"] >= 0))
    return none_if_empty(last(rows)).cast(PRICES)


def price_pairs(c: Column) -> Column:
    """Strict `date:price;...`; entries without a date or with a price of 0 go."""
    rows = F.transform(F.split(c, ";"), lambda x: F.struct(F.get(F.split(x, ":"), 0).alias("date"), parse_number(F.get(F.split(x, ":"), 1)).alias("price")))
    return F.filter(rows, lambda r: (r["date"] != "") & (r["price"] != 0))


def sales_array(c: Column, as_of: Column) -> Column:
    """A JSON array of sales; the months end at as_of."""
    got = F.from_json(c, "array<double>")
    rows = F.transform(got, lambda x, i: F.struct(F.add_months(as_of, i - F.size(got) + 1).alias("date"), F.coalesce(x, F.lit(0)).cast("long").alias("sales"),
                                                   F.lit(0).cast("long").alias("views"), F.lit(0.0).alias("conversion_rate"), F.lit(0.0).alias("revenue")))
    return rows.cast(SALES)


def performance_history(c: Column, as_of: Column) -> Column:
    """A JSON array of sales, or `date:sales:views:conversion:revenue` entries, or the same without dates, which are dated
    back month by month from as_of. Values out of range drop the entry; the twelve latest by date; null if none."""
    split = F.transform(_parts(c), lambda x: F.split(x, ":"))
    whole = lambda x: F.coalesce(parse_number(x).cast("long"), F.lit(0).cast("long"))
    real = lambda x: F.coalesce(parse_number(x), F.lit(0.0))
    dated = lambda p: (F.size(p) >= 5) & strip(F.get(p, 0)).rlike(r"^\d{4}-\d{2}-\d{2}$")
    usable = F.filter(split, lambda p: F.size(p) >= 4)

    def row(p: Column) -> Column:
        k = F.when(dated(p), 1).otherwise(0)
        return F.struct(F.when(dated(p), F.try_to_date(strip(F.get(p, 0)), "yyyy-MM-dd")).alias("date"), whole(F.get(p, k)).alias("sales"), whole(F.get(p, k + 1)).alias("views"),
                        real(F.get(p, k + 2)).alias("conversion_rate"), real(F.get(p, k + 3)).alias("revenue"))

    valid = F.filter(F.transform(usable, row), lambda r: (r["sales"] >= 0) & (r["views"] >= 0) & r["conversion_rate"].between(0, 100) & (r["revenue"] >= 0))
    filled = F.transform(valid, lambda r, i: F.struct(F.coalesce(r["date"], F.add_months(as_of, -i)).alias("date"), r["sales"], r["views"], r["conversion_rate"], r["revenue"]))
    array = F.when(strip(c).startswith("["), sales_array(c, as_of))
    return none_if_empty(last(F.coalesce(array, filled.cast(SALES))))


def monthly(values: Column, as_of: Column) -> Column:
    """Values dated a calendar month apart, the last at as_of."""
    return F.transform(values, lambda x, i: F.struct(F.add_months(as_of, i - F.size(values) + 1).alias("date"), x.alias("value")))


def every_30_days(values: Column, as_of: Column) -> Column:
    """Sales dated 30 days apart, the last at as_of; negative ones go, but keep their place."""
    rows = F.transform(values, lambda x, i: F.struct(F.date_add(as_of, (i - F.size(values) + 1) * 30).alias("date"), x.cast("long").alias("sales")))
    return F.filter(rows, lambda r: r["sales"] >= 0)


def pasted_prices(c: Column, as_of: Column) -> Column:
    """Lines of `date,price` (tab, comma or semicolon) or of a price alone, which is dated by its line."""
    lines = F.filter(F.split(strip(c), "\r?\n"), lambda x: strip(x) != "")
    cells = lambda x: F.split(strip(x), "[\t,;]")
    rows = F.transform(lines, lambda x, i: F.when(F.size(cells(x)) >= 2, F.struct(parse_date(F.get(cells(x), 0)).alias("date"), parse_number(F.get(cells(x), 1)).alias("price")))
                       .otherwise(F.struct(F.add_months(as_of, i - F.size(lines) + 1).alias("date"), parse_number(x).alias("price"))))
    return F.filter(rows, lambda r: r["date"].isNotNull() & (r["price"] >= 0))


def pasted_sales(c: Column) -> Column:
    lines = F.transform(F.split(strip(c), "\r?\n"), lambda x: parse_number(x).cast("long"))
    return F.filter(lines, lambda x: x >= 0)


def write_prices(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["date"].cast("string"), r["price"].cast("string"))), ";")


def write_sales(rows: Column) -> Column:
    return F.to_json(F.transform(rows, lambda r: r["sales"]))


def min_max_scaled(values: Column) -> Column:
    """Values from 0 to 1; a series of equal values is 0 throughout, as its range counts as 1."""
    low, high = F.array_min(values), F.array_max(values)
    width = F.when(high == low, 1).otherwise(high - low)
    return F.transform(values, lambda x: (x - low) / width)
