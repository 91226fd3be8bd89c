"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point and the seed. A trigram is bound from the vectors of
its three letters, the first permuted twice, the second once (a permutation is a cyclic shift), by elementwise products. A
text is the sum (bundle) of its trigrams, a language's prototype the sum of its texts; a text gets the language whose
prototype has the largest cosine with it. What isn't a letter separates words and counts as one space.

Prototypes: every task sums the vectors of each language over its rows, and Spark adds those up by language and dimension.
The driver holds dimensions x languages numbers; more than max_languages values in the label column raise an error.

Defined cases: a null text, a text without letters, or a table without any label gives `und` and score 0; null labels are
not learned from; of equal cosines the language that comes first by code point wins; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CHUNK = 300_000  # characters of texts that are counted together
SPACE = 32


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Encoder:
    """Sums of trigram vectors. Letters get a place in the tables when they are first seen."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.place = np.full(0x110000, -1, np.int32)
        self.tables = [np.zeros((0, dims), np.int8)] * 3
        self._add([SPACE])

    def _add(self, points) -> None:
        rows = [np.random.Generator(np.random.Philox(key=[self.seed, int(p)])).integers(0, 2, self.dims, np.int8) * 2 - 1 for p in points]
        self.place[points] = np.arange(len(self.tables[0]), len(self.tables[0]) + len(rows))
        new = np.array(rows, np.int8).reshape(-1, self.dims)
        self.tables = [np.concatenate([t, np.roll(new, k, 1)]) for k, t in enumerate(self.tables)]

    def symbols(self, text: str) -> np.ndarray:
        """Places of the letters, with one space before, between and after words."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        points = np.concatenate([[SPACE], np.where(letters()[points], points, SPACE), [SPACE]])
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE)
        places = self.place[points := points[keep]]
        if (places < 0).any():
            self._add(np.unique(points[places < 0]))
            places = self.place[points]
        return places

    def sums(self, symbols: list[np.ndarray], group: list[int], n: int) -> np.ndarray:
        """The bundles of n groups; group: of each text."""
        size = len(self.tables[0])
        if not symbols:
            return np.zeros((n, self.dims), np.float32)
        codes = [(s[:-2].astype(np.int64) * size + s[1:-1]) * size + s[2:] for s in symbols]
        of = np.repeat(np.asarray(group), [len(c) for c in codes])
        codes = np.concatenate(codes)
        if size <= 160:
            seen = np.zeros(size**3, bool)
            seen[codes] = True
            kinds = np.flatnonzero(seen)
            at = np.empty(size**3, np.int32)
            at[kinds] = np.arange(len(kinds))
            at = at[codes]
        else:
            kinds, at = np.unique(codes, return_inverse=True)
        out = np.zeros((n, self.dims), np.float32)
        step = max(1, 2_000_000 // max(n, self.dims))  # trigrams whose vectors and counts are held at once
        for a in range(0, len(kinds), step):
            part = kinds[a : a + step]
            here = (at >= a) & (at < a + step) if len(kinds) > step else slice(None)
            counts = np.bincount(of[here] * len(part) + (at[here] - a), minlength=n * len(part)).reshape(n, -1).astype(np.float32)
            first, second, third = part // (size * size), part // size % size, part % size
            vectors = self.tables[2][first]
            vectors *= self.tables[1][second]
            vectors *= self.tables[0][third]
            out += counts @ vectors.astype(np.float32)
        return out


def _chunks(texts: list[str], encoder: Encoder):
    """Indices and symbols of texts, so many at a time that their characters stay bounded."""
    at, got, n = [], [], 0
    for i, text in enumerate(texts):
        s = encoder.symbols(text) if text else np.zeros(0, np.int32)
        if len(s) > 2:
            at.append(i)
            got.append(s)
            n += len(s)
        if n > CHUNK:
            yield at, got
            at, got, n = [], [], 0
    if at:
        yield at, got


def learn(docs: DataFrame, dims: int = 1024, seed: int = 11, max_languages: int = 1000, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each language in docs, of length 1."""

    def run(batches):
        encoder, sums = Encoder(dims, seed), {}
        for batch in (part for whole in batches for part in slices(whole, 0)):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            for at, got in _chunks(batch.column(0).to_pylist(), encoder):
                for name, v in zip(names, encoder.sums(got, [number[langs[i]] for i in at], len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dims), pa.array(range(dims), pa.int32()), pa.array(v)], names=["lang", "dim", "v"])

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    parts = rows.mapInArrow(run, "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    got = parts.limit(max_languages * dims + 1).toPandas()
    if len(got) > max_languages * dims:
        raise ValueError(f"{lang} has more than {max_languages} values")
    out = {}
    for name, part in got.groupby("lang"):
        v = part.sort_values("dim")["v"].to_numpy()
        if norm := float(np.sqrt(v @ v)):
            out[str(name)] = (v / norm).astype(np.float32)
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = 11, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 at least), which replace columns of those names. keep_text: whether the
    text is among the columns of the result."""
    docs = docs.drop("lang_pred", "score")
    kept = [c for c in docs.columns if keep_text or c != text]
    names = list(prototypes)
    dims = len(prototypes[names[0]]) if names else 1
    table = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[x] for x in names], np.float32).reshape(-1, dims))

    def run(batches):
        encoder, langs = Encoder(dims, seed), table.value
        for batch in (part for whole in batches for part in slices(whole, text)):
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for at, got in _chunks(batch.column(text).to_pylist() if names else [], encoder):
                sums = encoder.sums(got, list(range(len(got))), len(got))
                cosines = sums @ langs.T / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
                best = cosines.argmax(1)
                for i, b, c in zip(at, best, cosines.max(1), strict=True):
                    pred[i], score[i] = names[b], min(1.0, max(0.0, float(c)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in kept), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out(id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
