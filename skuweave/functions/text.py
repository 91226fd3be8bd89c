"""Text rules of the catalog as Column functions: cleaning, validation, and the similarity scores (0 to 100)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results.
NO_CATEGORY = ["", "unknown", "uncategorized", "none", "n/a", "na"]
NULL_CELLS = ["null", "NULL", "undefined", "UNDEFINED", "N/A", "n/a", "NA", "na", "-", ""]
COMMON_WORDS = ["the", "a", "an", "and", "or", "of", "in", "on", "at", "by", "for", "with"]
GENERIC_FOLDERS = ["historical_products", "new_products", "products", "images", "uploads"]
HEADERS = {
    "productname": "name", "itemname": "name",
    "productsku": "sku", "itemsku": "sku", "productid": "sku", "itemid": "sku",
    "file": "filename", "image": "filename", "imagename": "filename",
    "cat": "category", "productcategory": "category",
    "unitprice": "price", "cost": "price", "amount": "price",
}
WEIGHT_STARTS = {"sku": 40, "name": 50, "category": 50, "price": 60, "performance": 60}
DUPLICATE, HIGH, MEDIUM = 90, 70, 50


def strip(c: Column) -> Column:
    """Without white space at either end, any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def half_up(x: Column, digits: int) -> Column:
    """Rounded in binary arithmetic, alike in all engines."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def rounded(x: Column, digits: int) -> Column:
    """F.round of a double, without decimals where a double tells which way to round: not near the middle of two results."""
    big = x * 10.0**digits
    low = F.floor(big)
    near = (big - low).between(0.499, 0.501)
    return F.when((F.abs(big) < 1e9) & (x >= 0) & ~near, F.when(big - low < 0.5, low).otherwise(low + 1) / 10.0**digits).otherwise(F.round(x, digits))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def normalize_category(c: Column) -> Column:
    x = F.lower(strip(c))
    return F.when(~x.isin(NO_CATEGORY), x)


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "[ -]", "")


def _edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 0.0).otherwise((1 - F.levenshtein(a, b) / longest) * 100)


def comparable_sku(c: Column) -> Column:
    return F.upper(strip(c))


def comparable_sku_similarity(a: Column, b: Column) -> Column:
    """Of two SKUs as comparable_sku() gives them."""
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0)
        .when(a == b, 100.0)
        .when(F.abs(F.char_length(a) - F.char_length(b)) > 5, 0.0)
        .otherwise(_edit_similarity(a, b))
    )


def sku_similarity(a: Column, b: Column) -> Column:
    return comparable_sku_similarity(comparable_sku(a), comparable_sku(b))


def clean_name(c: Column) -> Column:
    """Lower case, punctuation to spaces, common words gone; null when there is no name at all."""
    low = F.lower(strip(c))
    words = F.split(F.regexp_replace(low, r"(?U)[^\w\s]", " "), r"(?U)\s+")
    kept = F.filter(words, lambda w: ~w.isin([*COMMON_WORDS, ""]))
    return F.when(low != "", F.array_join(kept, " "))


def cleaned_name_similarity(a: Column, b: Column) -> Column:
    """Of two names as clean_name() gives them."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    x, y = words(a), words(b)
    both, any_, least = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)), F.least(F.size(x), F.size(y))
    jaccard = F.when(any_ > 0, both / any_ * 100).otherwise(0.0)
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 100.0)
        .when((least > 0) & (jaccard >= 50), jaccard)
        .when((least > 0) & (both >= least * 0.7), both / least * 100)
        .otherwise(_edit_similarity(a, b))
    )


def name_similarity(a: Column, b: Column) -> Column:
    return cleaned_name_similarity(clean_name(a), clean_name(b))


def normalized_category_similarity(a: Column, b: Column) -> Column:
    """Of two categories as normalize_category() gives them."""
    return (
        F.when(a.isNull() & b.isNull(), 50.0)
        .when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 100.0)
        .when(F.levenshtein(a, b) <= 2, _edit_similarity(a, b))
        .otherwise(0.0)
    )


def category_similarity(a: Column, b: Column) -> Column:
    return normalized_category_similarity(normalize_category(a), normalize_category(b))


def price_similarity(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return (
        F.when(a.isNull() | b.isNull() | (a <= 0) | (b <= 0) | F.isnan(a) | F.isnan(b), 50.0)
        .when(a == b, 100.0)
        .otherwise(F.greatest(F.lit(0.0), 100 - F.abs(a - b) / ((a + b) / 2) * 100))
    )


def performance_similarity(a: Column, b: Column) -> Column:
    """Of the latest sales; null where a product has no record."""
    a, b = a.cast("double"), b.cast("double")
    return (
        F.when(a.isNull() | b.isNull(), 50.0)
        .when((a == 0) & (b == 0), 50.0)
        .when((a == 0) | (b == 0), 25.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(a, b) / F.greatest(a, b) * 100))
    )


def asymmetric(score: Column, weight: float, start: float) -> Column:
    """Full weight from start on, half of it below."""
    return F.when(score >= start, score * weight).otherwise(score * (weight * 0.5))


def is_duplicate(score: Column) -> Column:
    return score > DUPLICATE


def score_class(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def trend_arrow(trend: Column) -> Column:
    return F.when(trend == "up", "↑").when(trend == "down", "↓").otherwise("→")


def duplicate_advice(score: Column) -> Column:
    return F.when(score > 95, "Very likely duplicate").otherwise("Possible duplicate")


def normalize_sku(c: Column) -> Column:
    x = F.upper(strip(c))
    return F.when(x != "", x)


def valid_sku(c: Column) -> Column:
    """At most 50 letters, digits, hyphens and underscores; null and blank are valid, as a SKU is optional."""
    x = strip(c)
    return F.coalesce((x == "") | ((F.char_length(x) <= 50) & x.rlike("^[A-Za-z0-9_-]+$")), F.lit(True))


def valid_category(c: Column) -> Column:
    x = strip(c)
    return F.coalesce((x == "") | ((F.char_length(x) <= 100) & x.rlike(r"(?U)^[\w\s-]+$")), F.lit(True))


def sanitize_name(c: Column) -> Column:
    """Without tags; null when blank. Names over 200 characters are left to valid_name()."""
    x = strip(F.regexp_replace(c, "<[^>]+>", ""))
    return F.when(x != "", x)


def valid_name(c: Column) -> Column:
    return F.coalesce(F.char_length(strip(c)) <= 200, F.lit(True))


def sanitize_search(c: Column) -> Column:
    return F.substring(F.regexp_replace(strip(c), r"""[;'"\\]""", ""), 1, 200)


def parse_number(c: Column) -> Column:
    """The number that a text begins with, or null."""
    return F.regexp_extract(strip(c), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")


def parse_price(c: Column) -> Column:
    """Without currency signs, thousands separators and white space; two decimals, half up; null if negative or no number."""
    x = parse_number(F.regexp_replace(c, r"(?U)[$€£¥₹,\s]", ""))
    return F.when(~F.regexp_replace(c, r"(?U)[$€£¥₹,\s]", "").startswith("-") & (x >= 0) & (x < float("inf")), F.floor(x * 100 + 0.5) / 100)


def sanitize_field(c: Column) -> Column:
    x = strip(F.coalesce(c, F.lit("")))
    quoted = x.rlike("(?s)^(\".*\"|'.*')$") | x.isin('"', "'")
    inner = F.when(quoted, F.substring(x, F.lit(2), F.greatest(F.char_length(x) - 2, F.lit(0)))).otherwise(x)
    return F.when(inner.isin(NULL_CELLS), "").otherwise(inner)


def header_name(header: str) -> str:
    """The standard name of a column, of a file's header."""
    plain = "".join(x for x in header.lower() if "a" <= x <= "z" or "0" <= x <= "9")
    return HEADERS.get(plain) or "".join(x for x in header.lower() if "a" <= x <= "z" or "0" <= x <= "9" or x == "_")


def folder_category(path: Column, least_parts: int = 3) -> Column:
    """The parent folder; of a generic one its parent. least_parts: parts that a path needs to have a category."""
    parts = F.split(path, "/")
    parent = F.try_element_at(parts, F.lit(-2))
    return (
        F.when(F.size(parts) < max(2, least_parts), None)
        .when(F.lower(parent).isin(GENERIC_FOLDERS), F.try_element_at(parts, F.lit(-3)))
        .otherwise(parent)
    )


def fuzzy_text(c: Column) -> Column:
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[_\-.]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", ""), r"\s+", " "))


def fuzzy_score(a: Column, b: Column) -> Column:
    """0 to 1, of two texts as fuzzy_text() gives them; not symmetric."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: F.char_length(w) > 1)
    x, y = words(a), words(b)
    met = F.size(F.filter(x, lambda v: F.exists(y, lambda w: v.contains(w) | w.contains(v))))
    la, lb = F.char_length(a), F.char_length(b)
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(a.contains(b) | b.contains(a), F.least(la, lb) / F.greatest(la, lb))
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .otherwise(met / F.greatest(F.size(x), F.size(y)))
    )


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+$", "")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def missing_fields(image_path: Column, name: Column, sku: Column) -> Column:
    gone = lambda c, label: F.when(c.isNull() | (c == ""), F.lit(label))
    return F.array_compact(F.array(gone(image_path, "image_path"), gone(name, "product_name"), gone(sku, "sku")))
