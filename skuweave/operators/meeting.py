"""Metadata matches with a limit, scored in blocks: the best candidates of each query without forming all its pairs.

Catalog rows of a key with one cleaned name are a group (operators.bounds), queries alike in category and cleaned name are a kind.
Names and categories are scored for kinds and groups. The best groups of a kind that together hold more products than the limit
are met first; the k-th score found there (or the threshold) is what the bound of any other group must reach for a query to meet
its rows. Queries and rows of a group meet in blocks, as numpy matrices in Arrow batches: SKUs are compared once for each pair of
distinct ones of a block, and only the best of each query leave a block. No row of a pair, nor of a query and a group, is shuffled.

Scores are those of functions.text, number for number: the same operations in the same order.
"""

from __future__ import annotations

import os.path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import text as T
from ..shared import written
from .bounds import SLACK, groups
from .candidates import NONE
from .knn import block_pairs, tasks

Q_BLOCK, C_BLOCK = 4096, 8192  # rows of a block
ELEMENTS = 262_144  # pairs that are scored at once
NEAR = 0.01  # more than float32 can round off a score
PAIRS_PER_TASK = 8_000_000  # about; decides partitions, not results
BLOCK_PAIRS, SOME_PAIRS, SOME_TASKS = 16_000_000, 400_000, 200  # the same where pairs stay in the engine; less for so many tasks
MANY_PAIRS, LONGER = 8_000_000_000, 16  # pairs for each Q_BLOCK of a longer block, and how many at most
NAMES = 200_000  # pairs of names that are sent to all tasks, at most
LOW_Q, LOW_C, LOW_PAIRS = (2048, 65_536), 32_768, 10_000_000  # rows of a block where pairs are only counted
ACROSS, DOWN = 64, 2048  # queries and rows of the catalog that are counted at once
SCORES = ["sku_score", "name_score", "category_score", "price_score", "performance_score", "similarity_score"]
FOUND = "q_id long, c_id long, c_m long, " + ", ".join(f"{s} double" for s in SCORES)
ASKED = ["q_id", "q_nsku", "q_price", "q_sales"]
GROUP = ["price_lo", "price_hi", "odd_price", "sales_lo", "sales_hi", "no_sales", "zero_sales", "odd_sales", "sku_lo", "sku_hi"]


def edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of texts of one length with texts of another, all with all; a row of codes is a text."""
    (n, x), (m, y) = a.shape, b.shape
    kind = np.uint8 if x + y < 250 else np.int32
    if not x or not y:
        return np.full((n, m), max(x, y), kind)
    out, step, turned = np.empty((n, m), kind), max(1, ELEMENTS // 8 // max(1, m)), np.ascontiguousarray(b.T)
    for at in range(0, n, step):
        part = a[at : at + step]
        above = [np.full((len(part), m), j, kind) for j in range(y + 1)]
        for i in range(x):
            row = [np.full((len(part), m), i + 1, kind)]
            for j in range(y):
                here = np.minimum(above[j + 1], row[j])
                here += 1
                other = (part[:, i, None] != turned[j]).view(np.uint8)
                row.append(np.minimum(here, np.add(above[j], other, out=other) if kind is np.uint8 else above[j] + other, out=here))
            above = row
        out[at : at + step] = above[y]
    return out


class Skus:
    """The distinct SKUs of both sides of a block as codes, by their lengths; what all begin with changes no distance."""

    def __init__(self, a: list[str], b: list[str]):
        texts = [x for x in (*a, *b) if x]
        self.same = len(os.path.commonprefix(texts)) if texts else 0
        letters = {x: i for i, x in enumerate(sorted(set("".join(x[self.same :] for x in texts))))}
        self.kind = np.uint8 if 2 * max(map(len, texts), default=0) < 250 else np.int32
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        sizes = lambda side: sorted({len(x) for x in side if x})
        coded = lambda rows: np.array([[letters[x] for x in t[self.same :]] for t in rows], np.uint8 if len(letters) <= 256 else np.int32).reshape(len(rows), -1)
        self.a = {n: coded([x for x in a if len(x) == n]) for n in sizes(a)}
        self.b = {n: (np.flatnonzero(self.b_size == n), coded([x for x in b if len(x) == n])) for n in sizes(b)}
        self.place = np.zeros(len(a), np.int64)  # among those of its length
        for n in self.a:
            at = self.a_size == n
            self.place[at] = np.arange(at.sum())

    def of(self, some: np.ndarray, weighed=None) -> tuple[np.ndarray, np.ndarray]:
        """Distances of some SKUs of a (by their places) with all of b where they are scored, and weighed(scores) in float32."""
        far, out = np.zeros((len(some), len(self.b_size)), self.kind), np.zeros((len(some), len(self.b_size)), np.float32)
        for n, codes in self.a.items():
            rows = np.flatnonzero(self.a_size[some] == n)
            for m, (cols, others) in self.b.items() if len(rows) else ():
                if abs(n - m) <= 5:
                    found, at = edits(codes[self.place[some[rows]]], others), np.ix_(rows, cols)
                    far[at] = found
                    if weighed:
                        out[at] = weighed((1 - np.arange(max(n, m) + 1) / max(n, m)) * 100).astype(np.float32).take(found)
        return far, out

    def score(self, far: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """functions.text.comparable_sku_similarity of SKUs i of a with j of b, of their distances."""
        n, m = self.a_size[i], self.b_size[j]
        return np.where((n > 0) & (m > 0) & (np.abs(n - m) <= 5), (1 - far / np.maximum(1, np.maximum(n, m))) * 100, 0.0)


def sku_table(a: list[str], b: list[str]) -> np.ndarray:
    """functions.text.comparable_sku_similarity of all with all."""
    table, every = Skus(a, b), np.arange(len(a))
    return table.score(table.of(every)[0], every[:, None], np.arange(len(b))[None])


def price_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """functions.text.price_similarity; NaN stands for null, too."""
    with np.errstate(all="ignore"):
        out = np.maximum(0.0, 100 - np.abs(a - b) / ((a + b) / 2) * 100)
        out[np.equal(a, b)] = 100.0
        return np.where(~(a > 0) | ~(b > 0), 50.0, out)


def sales_scores(a: np.ndarray, a_none: np.ndarray, b: np.ndarray, b_none: np.ndarray) -> np.ndarray:
    """functions.text.performance_similarity; none: which are null."""
    with np.errstate(all="ignore"):
        out = np.maximum(0.0, np.minimum(a, b) / np.maximum(a, b) * 100)
        zeros = (a == 0).astype(np.int8) + (b == 0)
        out[zeros == 1], out[zeros == 2] = 25.0, 50.0
        return np.where(a_none | b_none, 50.0, out)


def part(score: np.ndarray, weight: float, start: float) -> np.ndarray:
    """functions.text.asymmetric; a NaN is above all."""
    return np.where(score < start, score * (weight * 0.5), score * weight)


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    return t[column].to_numpy().astype(np.float64)


def _flags(t: pa.Table, column: str) -> np.ndarray:
    return t[column].to_numpy().astype(bool)


def _skus(t: pa.Table, column: str) -> tuple[np.ndarray, list[str]]:
    """For each row the place of its SKU among the distinct ones; null is as blank."""
    coded = t[column].combine_chunks().fill_null("").dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _floor(cfg: MatchConfig) -> float:
    return cfg.threshold if cfg.threshold > 0 else float("-inf")


def _parts(cfg: MatchConfig):
    w, starts = cfg.metadata_weights, T.WEIGHT_STARTS
    return lambda name, score: part(score, w[name], starts[name])


def upper_bounds(q: pa.Table, g: pa.Table, cfg: MatchConfig) -> np.ndarray:
    """Of the scores of each query with any row of each group, as operators.bounds.upper_bound."""
    weighed = _parts(cfg)
    price, sales, none = (x[:, None] for x in (_numbers(q, "q_price"), _numbers(q, "q_sales"), q["q_sales"].is_null().to_numpy()))
    size = np.array([len(x or "") for x in q["q_nsku"].to_pylist()], float)[:, None]
    near = lambda x, lo, hi: np.maximum(lo, np.minimum(hi, x))
    with np.errstate(all="ignore"):
        lo, hi = _numbers(g, "price_lo")[None], _numbers(g, "price_hi")[None]
        prices = np.maximum(np.where(_flags(g, "odd_price")[None] | ~(price > 0), 50.0, 0.0), np.nan_to_num(price_scores(price, near(price, lo, hi)), nan=np.inf))
        prices = np.where(np.isinf(price) | np.isinf(hi), np.inf, prices)  # an infinite number scores NaN with a finite one
        lo, hi = _numbers(g, "sales_lo")[None], _numbers(g, "sales_hi")[None]
        some = np.where(np.isnan(lo), 0.0, sales_scores(sales, none, near(sales, lo, hi), np.zeros_like(lo, bool)))
        zero = np.where(_flags(g, "zero_sales")[None], sales_scores(sales, none, np.zeros_like(lo), np.zeros_like(lo, bool)), 0.0)
        best = np.fmax(np.fmax(some, zero), np.where(_flags(g, "no_sales")[None] | none, 50.0, 0.0))
        best = np.where(_flags(g, "odd_sales")[None] | (sales < 0) | np.isinf(sales) | np.isinf(hi) | (np.isnan(sales) & ~none), np.inf, best)
        lo, hi = _numbers(g, "sku_lo")[None], _numbers(g, "sku_hi")[None]
        far = np.abs(near(size, lo, hi) - size)
        skus = np.where((size > 0) & (far <= 5), (1 - far / np.maximum(near(size, lo, hi), size)) * 100, 0.0)
    named = weighed("name", _numbers(g, "name_score"))[None] + weighed("category", _numbers(g, "category_score"))[None]
    return weighed("sku", skus) + named + weighed("price", prices) + weighed("performance", best) + SLACK


def _weighed(score: np.ndarray, weight: float, start: float, unsure: np.ndarray | None = None) -> np.ndarray:
    """part() of float32 scores, in place: not under it but for rounding. unsure: gets true where rounding may decide the weight."""
    full = score >= np.float32(start - NEAR)
    if unsure is not None:
        unsure |= full ^ (score >= np.float32(start + NEAR))
    full = full.astype(np.float32)
    full += 1
    score *= full
    score *= np.float32(weight / 2)
    return score


class Near:
    """Near upper bounds, in float32, of what SKU, price and sales add to the scores of queries with all rows of a block. Prices and
    sales that are null, zero, negative or no numbers are scored by the rules."""

    def __init__(self, c_price: np.ndarray, c_sales: np.ndarray, c_none: np.ndarray, cfg: MatchConfig):
        self.w, self.price, self.sales, self.none = cfg.metadata_weights, c_price, c_sales, c_none
        self.odd_price, self.odd_sales = self._odd(c_price), self._odd(c_sales) | c_none

    @staticmethod
    def _odd(x: np.ndarray) -> np.ndarray:
        return ~((x > 1e-30) & (x < 1e30))

    @staticmethod
    def _filled(out: np.ndarray, q_odd: np.ndarray, c_odd: np.ndarray, exact) -> np.ndarray:
        """out with the odd rows and columns by exact(rows, columns)."""
        every = slice(None)
        if c_odd.any():
            out[:, c_odd] = exact(every, c_odd)
        if q_odd.any():
            out[q_odd] = exact(q_odd, every)
        return out

    def of(self, skus: np.ndarray, price: np.ndarray, sales: np.ndarray, none: np.ndarray, unsure: np.ndarray | None = None) -> np.ndarray:
        """unsure: gets true where the bound may be too high by more than rounding and NEAR."""
        w, starts = self.w, T.WEIGHT_STARTS
        with np.errstate(all="ignore"):
            a, b = price.astype(np.float32)[:, None], self.price.astype(np.float32)[None]
            out, both = a - b, a + b
            np.abs(out, out=out)
            out /= both
            out *= -200
            out += 100
            np.maximum(out, 0, out=out)
            out = self._filled(out, self._odd(price), self.odd_price, lambda r, o: price_scores(price[r, None], self.price[None, o]))
            total = _weighed(out, w["price"], starts["price"], unsure)
            out = sales.astype(np.float32)[:, None] / self.sales.astype(np.float32)[None]
            np.minimum(out, np.reciprocal(out, out=both), out=out)
            out *= 100
            out = self._filled(out, self._odd(sales) | none, self.odd_sales, lambda r, o: sales_scores(sales[r, None], none[r, None], self.sales[None, o], self.none[None, o]))
            total += _weighed(out, w["performance"], starts["performance"], unsure)
            total += skus
            total += np.float32(NEAR)
        total[np.isnan(total)] = np.inf
        return total


def found_in(q: pa.Table, c: pa.Table, cfg: MatchConfig, k: int) -> pa.Table:
    """The best k rows of a block of a group for each query of another: by score, equal ones by id. Only pairs whose bounds reach
    the k-th score are scored."""
    weighed, out = _parts(cfg), []
    kinds = [("q_id", pa.int64()), ("c_id", pa.int64()), ("c_m", pa.int64()), *((s, pa.float64()) for s in SCORES)]
    if q.num_rows and c.num_rows:
        c = c.sort_by("c_id")
        ci, cm, (c_code, c_skus) = c["c_id"].to_numpy(), c["c_m"].to_numpy(), _skus(c, "c_nsku")
        c_price, c_sales, c_none = _numbers(c, "c_price"), _numbers(c, "c_sales"), c["c_sales"].is_null().to_numpy()
        near, one_each = Near(c_price, c_sales, c_none, cfg), len(c_skus) == len(c_code)  # then codes ascend by row
        q_code, q_skus = _skus(q, "q_nsku")
        table, step = Skus(q_skus, c_skus), max(1, ELEMENTS // c.num_rows)
        for at in range(0, q.num_rows, step):
            s = q.slice(at, step)
            some, code = np.unique(q_code[at : at + step], return_inverse=True)
            far, skus = table.of(some, lambda x: weighed("sku", x))
            price, sales, none, name, category, least = (_numbers(s, "q_price"), _numbers(s, "q_sales"), s["q_sales"].is_null().to_numpy(), *(_numbers(s, x) for x in ("name_score", "category_score", "least")))
            given = weighed("name", name) + weighed("category", category)

            def exact(row, col, some=some, code=code, far=far, price=price, sales=sales, none=none, name=name, category=category):
                """The scores of pairs, one by one."""
                skus, prices = table.score(far[code[row], c_code[col]], some[code[row]], c_code[col]), price_scores(price[row], c_price[col])
                sold = sales_scores(sales[row], none[row], c_sales[col], c_none[col])
                total = weighed("sku", skus) + weighed("name", name[row]) + weighed("category", category[row]) + weighed("price", prices) + weighed("performance", sold)
                return skus, prices, sold, total

            skus = skus if np.array_equal(code, np.arange(len(some))) else skus[code]
            bound = near.of(skus if one_each else skus[:, c_code], price, sales, none)
            edge = np.full(len(code), -np.inf)
            if k < len(ci):
                first = np.argpartition(bound, -k, axis=1)[:, -k:]
                total = exact(np.repeat(np.arange(len(code)), k), first.ravel())[3]
                edge = np.where(np.isnan(total), np.inf, total).reshape(-1, k).min(1)
            edge = np.maximum(edge, least)
            row, col = np.nonzero(bound >= np.where(np.isinf(edge), edge, edge - given - NEAR)[:, None])
            skus, prices, sold, total = exact(row, col)
            order = np.where(np.isnan(total), np.inf, total)
            fine = np.flatnonzero(order >= edge[row])
            by = fine[np.lexsort((col[fine], -order[fine], row[fine]))]
            keep = np.arange(len(by)) - np.searchsorted(row[by], row[by]) < k
            by = by[keep]
            row, col = row[by], col[by]
            out.append((s["q_id"].to_numpy()[row], ci[col], cm[col], skus[by], name[row], category[row], prices[by], sold[by], total[by]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * len(kinds)
    return pa.table({n: pa.array(x, t, from_pandas=False) for (n, t), x in zip(kinds, cols, strict=True)})


def low_in(q: pa.Table, c: pa.Table, names: dict, cfg: MatchConfig, threshold: float) -> pa.Table:
    """For each query of a block how many products of another (c_m for a row) score less than the threshold. Near bounds decide all
    pairs but those next to the threshold or to a change of weights, which are scored. names: for each key the places of the names of
    both sides in a matrix of their scores, and the matrix."""
    weighed, out, n = _parts(cfg), [], c.num_rows
    if q.num_rows and n:
        q_place, c_place, scores = names[q["key"][0].as_py()]
        q = q.take(pa.array(np.argsort(_skus(q, "q_nsku")[0], kind="stable")))
        (q_code, q_skus), (c_code, c_skus) = _skus(q, "q_nsku"), _skus(c, "c_nsku")
        q_name, c_name = (np.array([place[x] for x in t[f"{side}_clean"].to_pylist()]) for side, place, t in (("q", q_place, q), ("c", c_place, c)))
        c_price, c_sales, c_none, held = _numbers(c, "c_price"), _numbers(c, "c_sales"), c["c_sales"].is_null().to_numpy(), _numbers(c, "c_m")
        q_price, q_sales, q_none, category = _numbers(q, "q_price"), _numbers(q, "q_sales"), q["q_sales"].is_null().to_numpy(), _numbers(q, "category_score")
        table, edge = Skus(q_skus, c_skus), np.float32(threshold)
        # rows of the catalog go down, so that what a pair gets from its SKUs and names is copied for many queries at once
        named, given = np.ascontiguousarray(weighed("name", scores).astype(np.float32).T), weighed("category", category).astype(np.float32)
        low, count = np.zeros(q.num_rows), np.float32 if held.sum() < 2**24 else np.float64
        held, few = held.astype(count), ACROSS * max(1, ELEMENTS * 16 // ACROSS // max(1, len(c_skus)))
        for first in range(0, q.num_rows, few):
            some, code = np.unique(q_code[first : first + few], return_inverse=True)
            far, skus = table.of(some, lambda x: weighed("sku", x))
            skus = np.ascontiguousarray(skus.T)
            for at in range(first, min(first + few, q.num_rows), ACROSS):
                s, own = slice(at, min(at + ACROSS, first + few)), code[at - first : at - first + ACROSS]
                near, of_sku, of_name = Near(q_price[s], q_sales[s], q_none[s], cfg), skus[:, own], named[:, q_name[s]] + given[s]
                for top in range(0, n, DOWN):
                    part_of = slice(top, top + DOWN)
                    total = of_sku.take(c_code[part_of], axis=0)
                    total += of_name.take(c_name[part_of], axis=0)
                    unsure = np.zeros(total.shape, bool)
                    total = near.of(total, c_price[part_of], c_sales[part_of], c_none[part_of], unsure)
                    under = total < edge
                    unsure |= total < np.float32(threshold + 2 * NEAR)
                    unsure &= ~under
                    low[s] += held[part_of] @ under.astype(count)
                    col, i = np.divmod(np.flatnonzero(unsure), len(own))
                    if len(col):
                        col, row = col + top, i + at
                        sku = table.score(far[own[i], c_code[col]], some[own[i]], c_code[col])
                        exact = weighed("sku", sku) + weighed("name", scores[q_name[row], c_name[col]]) + weighed("category", category[row])
                        exact = exact + weighed("price", price_scores(q_price[row], c_price[col])) + weighed("performance", sales_scores(q_sales[row], q_none[row], c_sales[col], c_none[col]))
                        low[s] += np.bincount(i, np.where(exact < threshold, held[col], 0.0), len(own))
        out = low.astype(np.int64)
    return pa.table({"q_id": q["id"].cast(pa.int64()) if len(out) else pa.array([], pa.int64()), "low": pa.array(out, pa.int64())})


def _by_sku(df: DataFrame, sku: str, rows: int) -> DataFrame:
    """df (id, key) with deal, by which its blocks hold few distinct SKUs: the SKU, and for one with more than a fourth of a block a
    part of its rows, too."""
    sku = F.coalesce(F.col(sku), F.lit(""))
    large = df.groupBy("key", sku.alias("large")).agg(F.ceil(4 * F.count("*") / rows).alias("parts")).filter("parts > 1")
    out = df.withColumn("large", sku).join(large, ["key", "large"], "left")
    return out.withColumn("deal", F.xxhash64("large", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))).drop("large", "parts")


def low_counts(left: DataFrame, right: DataFrame, names: DataFrame, cfg: MatchConfig, threshold: float) -> DataFrame:
    """(q_id, low): how many products (c_m for a row of right) that each row of left meets score less than the threshold. Both sides
    meet in blocks inside their keys, and no pair is a row. names, NAMES rows at most, are sent to all tasks."""
    found: dict = {}
    for r in names.collect():
        q_place, c_place, scores = found.setdefault(r["key"], ({}, {}, {}))
        scores[q_place.setdefault(r["q_clean"], len(q_place)), c_place.setdefault(r["c_clean"], len(c_place))] = r["name_score"]
    for key, (q_place, c_place, scores) in found.items():
        matrix = np.zeros((len(q_place), len(c_place)))
        matrix[tuple(np.array(list(scores)).T)] = list(scores.values())
        found[key] = q_place, c_place, matrix
    other = F.when(F.col("key") != NONE, F.col("key"))
    a = left.select("key", F.col("q_id").alias("id"), "q_clean", "q_nsku", "q_price", "q_sales", T.normalized_category_similarity(F.col("q_ncategory"), other).alias("category_score"))
    b = right.select("key", F.col("c_id").alias("id"), "c_m", "c_clean", "c_nsku", "c_price", "c_sales")
    sizes = lambda df, n: df.groupBy("key").agg(F.count("*").alias(n))
    pairs = sizes(a, "n").join(sizes(b, "m"), "key").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    # many pairs: longer blocks of queries, so that rows of the catalog are sent as often
    rows = min(LOW_Q[1], max(LOW_Q[0], pairs // LOW_PAIRS))
    a, b = block_pairs(_by_sku(a, "q_nsku", rows), _by_sku(b, "c_nsku", LOW_C), rows, LOW_C, "deal")
    keys, n = ["key", "q_block", "c_block"], max(tasks(left.sparkSession), 2 * pairs // (rows * LOW_C))
    found_in_blocks = a.repartition(n, *keys).groupBy(*keys).cogroup(b.repartition(n, *keys).groupBy(*keys)).applyInArrow(lambda x, y: low_in(x, y, found, cfg, threshold), "q_id long, low long")
    return found_in_blocks.groupBy("q_id").agg(F.sum("low").alias("low"))


def dealt(left: DataFrame, right: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides cut into blocks inside their groups, each with a row for every block of the other side, and the columns to join
    them on. q_m and c_m: the products that a row stands for; blocks hold about Q_BLOCK (up to LONGER times as many) and C_BLOCK of them,
    and both sides are dealt by blocks, so that a task has about BLOCK_PAIRS pairs of products, or those of a longer block."""
    held = lambda df, x: df.groupBy(*group).agg(F.sum(f"{x}_m").alias(f"{x}_held"))
    sizes = written(held(left, "q").join(held(right, "c"), group), "sizes")
    pairs = sizes.agg(F.sum(F.col("q_held") * F.col("c_held"))).first()[0] or 0
    # queries are read one by one, so their blocks may be longer where pairs are many, and rows of the catalog are sent less often
    longer = min(LONGER, max(1, pairs // MANY_PAIRS))
    for x, rows in (("q", Q_BLOCK * longer), ("c", C_BLOCK)):
        sizes = sizes.withColumn(f"{x}_blocks", F.ceil(F.col(f"{x}_held") / rows).cast("int"))
    n = max(1, -(-pairs // BLOCK_PAIRS), min(-(-pairs // SOME_PAIRS), SOME_TASKS))
    sizes, keys = sizes.drop("q_held", "c_held"), [*group, "q_block", "c_block"]

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(f"{own}_id"), F.col(f"{own}_blocks")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        out = df.join(sizes, group).withColumn(f"{own}_block", block).withColumn(f"{other}_block", each)
        return out.drop("q_blocks", "c_blocks", f"{own}_m").repartition(n, *keys)

    return side(left, "q", "c"), side(right, "c", "q"), keys


class Met:
    """The best of each query (left: q_* columns of profiles with key) among the profiles of a catalog (right: c_*, with c_m, the
    products that one stands for): at least as many as cfg.limit + 1 products, as a query may be among its own candidates. names: key,
    q_clean, c_clean, name_score, for all pairs of distinct cleaned names."""

    def __init__(self, left: DataFrame, right: DataFrame, names: DataFrame, cfg: MatchConfig):
        self.cfg, self.k, self.right = cfg, cfg.limit + 1, right
        self.left = left.withColumn("q_kind", F.coalesce("q_ncategory", F.lit(NONE)))
        kinds = self.left.groupBy("q_kind", "key", "q_clean").agg(F.count("*").alias("n"), F.any_value("q_ncategory").alias("q_ncategory"))
        met = kinds.join(names, ["key", "q_clean"]).join(groups(right), ["key", "c_clean"])
        met = met.withColumn("category_score", T.normalized_category_similarity(F.col("q_ncategory"), F.col("c_ncategory")))
        w, starts = cfg.metadata_weights, T.WEIGHT_STARTS
        met = met.withColumn("sure", T.asymmetric(F.col("name_score"), w["name"], starts["name"]) + T.asymmetric(F.col("category_score"), w["category"], starts["category"]))
        order = W.partitionBy("q_kind", "q_clean").orderBy(F.desc("sure"), "key", "c_clean").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("held").over(order), F.lit(0))
        self.kinds = written(met.withColumn("seed", before <= cfg.limit).drop("q_ncategory", "c_ncategory", "one_id", "sure"), "kinds")

    def _found(self, chosen: DataFrame) -> DataFrame:
        """The best of each query in each pair of blocks. chosen: ASKED, the group (key, c_clean), name_score, category_score and least,
        the score to reach."""
        group = ["key", "c_clean"]
        blocks = lambda df, rows, name: df.groupBy(*group).agg(F.count("*").alias(f"{name}_rows"), F.ceil(F.count("*") / rows).cast("int").alias(f"{name}_blocks"))
        sizes = written(blocks(chosen, Q_BLOCK, "q").join(blocks(self.right, C_BLOCK, "c"), group), "sizes")
        pairs = sizes.agg(F.sum(F.col("q_rows") * F.col("c_rows"))).first()[0] or 0
        sizes = sizes.select(*group, "q_blocks", "c_blocks")
        own = lambda side: F.pmod(F.xxhash64(f"{side}_id"), F.col(f"{side}_blocks")).cast("int").alias(f"{side}_block")
        each = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_blocks") - 1)).alias(f"{side}_block")
        keys = [*group, "q_block", "c_block"]
        n = max(1, -(-pairs // PAIRS_PER_TASK))
        q = chosen.join(sizes, group).select(*group, own("q"), each("c"), *ASKED, "name_score", "category_score", "least").repartition(n, *keys)
        c = self.right.join(sizes, group).select(*group, each("q"), own("c"), "c_id", "c_m", "c_nsku", "c_price", "c_sales").repartition(n, *keys)
        cfg, k = self.cfg, self.k
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(lambda a, b: found_in(a, b, cfg, k), FOUND)

    def _open(self, reached: DataFrame) -> DataFrame:
        """The further groups of each query whose bounds reach the score that its first ones gave, as chosen."""
        kind, cfg = ["q_kind", "key", "q_clean"], self.cfg
        worst = F.when(F.isnan("worst"), float("inf")).otherwise(F.coalesce("worst", F.lit(float("-inf"))))
        least = F.greatest(worst, F.lit(_floor(cfg))).alias("least")
        rest = self.kinds.filter("not seed")
        sizes = self.kinds.groupBy(*kind).agg(F.count_if(~F.col("seed")).alias("rest"), F.ceil(F.first("n") / (4 * Q_BLOCK)).cast("int").alias("blocks")).filter("rest > 0").drop("rest")
        block = F.pmod(F.xxhash64("q_id"), F.col("blocks")).cast("int").alias("block")
        asked = self.left.join(sizes, kind).join(reached, "q_id", "left").select(*kind, block, *ASKED, least)
        offered = rest.join(sizes, kind).select(*kind, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "c_clean", "m", "name_score", "category_score", *GROUP)

        def opened(q: pa.Table, g: pa.Table) -> pa.Table:
            own, of_group = q.select([*ASKED, "key", "least"]), g.select(["c_clean", "m", "name_score", "category_score"])
            rows, cols, step = [np.empty(0, int)], [np.empty(0, int)], max(1, ELEMENTS // max(1, g.num_rows))
            for at in range(0, q.num_rows if g.num_rows else 0, step):
                s = q.slice(at, step)
                row, col = np.nonzero(upper_bounds(s, g, cfg) >= _numbers(s, "least")[:, None])
                rows.append(row + at)
                cols.append(col)
            own, of_group = own.take(pa.array(np.concatenate(rows))), of_group.take(pa.array(np.concatenate(cols)))
            return pa.table({t.field(i).name: t[i] for t in (own, of_group) for i in range(t.num_columns)})

        key = [*kind, "block"]
        schema = "q_id long, q_nsku string, q_price double, q_sales double, key string, least double, c_clean string, m long, name_score double, category_score double"
        return asked.groupBy(*key).cogroup(offered.groupBy(*key)).applyInArrow(opened, schema)

    def best(self, rank) -> DataFrame:
        """rank(scored pairs): the best of each query, with similarity_score."""
        first = self.kinds.filter("seed").select("q_kind", "key", "q_clean", "c_clean", "name_score", "category_score")
        chosen = self.left.join(first, ["q_kind", "key", "q_clean"]).select(*ASKED, "key", "c_clean", "name_score", "category_score", F.lit(_floor(self.cfg)).alias("least"))
        seeds = written(rank(self._found(chosen)), "seeds")
        held = F.sum("c_m").over(W.partitionBy("q_id").orderBy("rank"))
        reached = seeds.withColumn("held", held).filter(F.col("held") >= self.k).groupBy("q_id").agg(F.max("similarity_score").alias("worst"))
        self.rest = written(self._open(reached), "rest")
        return rank(seeds.drop("rank").unionByName(rank(self._found(self.rest)).drop("rank")))

    def report(self) -> DataFrame:
        """After best(): pairs, seeded, formed."""
        pairs: Column = F.col("n") * F.col("m")
        total = self.kinds.agg(F.sum(pairs).alias("pairs"), F.sum(F.when(F.col("seed"), pairs)).alias("seeded"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        more = self.rest.agg(F.sum("m").alias("more"))
        return total.crossJoin(more).select(zero("pairs").alias("pairs"), zero("seeded").alias("seeded"), (zero("seeded") + zero("more")).alias("formed"))  # one row each
