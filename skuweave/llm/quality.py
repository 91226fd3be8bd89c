"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (white space runs are one space, digits are one symbol), of order 5. Its counts cover four fifths of
the trusted documents, by a hash of the id; the others set the limits, as a model knows the texts it has counted too well. Tasks
count n-grams, Spark adds them up by n-gram, and the lower orders count the distinct characters before an n-gram. Discounts come from the counts of counts of each order. Probabilities are joins, sharded by n-gram: of the counts of
an order with the totals of their contexts and with the probabilities of the order below.

Scoring joins, too. Documents are written in chunks of about chunk_chars characters, a table bucketed by chunk. Each chunk asks
once for each distinct n-gram in it, so frequent n-grams are pre-aggregated. Questions and the model are sharded by a hash of the
two characters before the one that is predicted, so that all orders of an n-gram and its contexts are in one shard (characters
and pairs of them are in all). A shard is one sorted partition: its part of the model comes first and is held, then the
questions of one chunk after the other stream by, so each row of the model is shuffled once, however many chunks there are. The
answers return to their chunk, whose documents stand where they were written. So neither the driver nor any task holds the
model or more than a chunk and a shard.

A document's mean negative logarithm is shrunk towards the mean of its language by `prior` characters, so that short texts are
not judged by a few characters. It passes if it lies between two quantiles of the trusted documents of its language: the upper
one of those that were held out, the lower one of all. Both are moved away from the mean by `slack` of their distance, which was
chosen so that no held-out trusted document of the sample tables is lost.

Defined cases: null and empty texts have 0 characters and take the mean of their language; a null language is a language of
its own; a language without trusted documents takes the quantiles of all of them; without any trusted text every document
passes; a long text is scored whole, in a chunk of its own if need be; ids that repeat are scored row by row; nll and n_scored
replace columns of those names, and no column may be called _chunk; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import likely, new_path, new_table, written
from .set_join import U, mixed

START, END = "\x02", "\x03"
DIGITS = str.maketrans("123456789", "000000000")
CHUNK = 400_000  # characters that are counted or scored together
SHARD_ROWS = 200_000  # n-grams of the model in a shard


def normal(text: str) -> str:
    return " ".join(text.split()).translate(DIGITS)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(U)


def hashes(points: np.ndarray, most: int) -> list[np.ndarray]:
    """For k from 0 to most, of each run of k characters; that of k is built on that of the last k - 1."""
    out = [np.zeros(len(points) + 1, U)]
    for k in range(1, most + 1):
        n = max(len(points) - k + 1, 0)
        out.append(mixed(out[-1][1 : n + 1] * U(3) + points[:n] + U(1)))
    return out


def counts(docs: DataFrame, order: int, text: str) -> DataFrame:
    """(gram, c) of the highest order. A task hands on what it has counted when it holds many n-grams."""

    def run(batches):
        held: Counter = Counter()

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "c"])

        for batch in batches:
            part: list[str] = []
            rows = batch.column(0).to_pylist()
            for i, t in enumerate(rows):
                part.append(START * (order - 1) + normal(t) + END)
                if sum(map(len, part[-50:])) > CHUNK or len(part) >= 200 or i == len(rows) - 1:
                    joined = "".join(part)
                    h = hashes(_points(joined), order)[order]
                    _, first, n = np.unique(h, return_index=True, return_counts=True)
                    for a, c in zip(first.tolist(), n.tolist(), strict=True):
                        gram = joined[a : a + order]
                        if END not in gram[:-1]:
                            held[gram] += c
                    part = []
            if len(held) > 300_000:
                yield handed()
                held.clear()
        yield handed()

    return docs.select(text).mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> list[float]:
    """For counts of 1, 2, and 3 and more; of sparse tables a half, one and one and a half."""
    r = table.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).first()
    if min(r.n1, r.n2, r.n3, r.n4) == 0:
        return [0.5, 1.0, 1.5]
    y = r.n1 / (r.n1 + 2 * r.n2)
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * r.n2 / r.n1, 2 - 3 * y * r.n3 / r.n2, 3 - 4 * y * r.n4 / r.n3))]


def train(trusted: DataFrame, order: int = 5, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(probabilities: gram, v; back-off weights: gram, v), natural logarithms, of all orders."""
    tables = {order: written(counts(trusted, order, text), "counts")}
    for k in range(order - 1, 0, -1):
        lower = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
        tables[k] = written(lower.filter(~F.col("gram").endswith(START)), "counts")
    below, probabilities, weights = None, None, None
    for k in range(1, order + 1):
        t = tables[k]
        d = discounts(t)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.substring("gram", 1, k - 1)
        sums = t.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("weight"))
        rows = t.withColumns({"context": context, "cut": cut}).join(sums, "context")
        own = (F.col("c") - F.col("cut")) / F.col("total")
        if k == 1:
            size = t.agg((F.count("*") + 1).alias("size"))  # one row
            out = rows.crossJoin(F.broadcast(size)).select("gram", (own + F.col("weight") / F.col("size")).alias("p"))
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
            out = rows.select("gram", (own + F.col("weight") * F.col("q")).alias("p"))
        below = written(out, "order")
        p, w = below.select("gram", F.log("p").alias("v")), sums.select(F.col("context").alias("gram"), F.log("weight").alias("v"))
        probabilities = p if probabilities is None else probabilities.unionByName(p)
        weights = w if weights is None else weights.unionByName(w)  # that of the empty context is of use for unseen characters
    return written(probabilities, "probabilities"), written(weights, "weights")


class Scorer:
    """Tables of one shard, by order: sorted hashes and values. rows: kind (p or w), k, h, v."""

    def __init__(self, order: int, kind: np.ndarray, k: np.ndarray, h: np.ndarray, v: np.ndarray):
        self.order, self.tables = order, {}
        for name in ("p", "w"):
            for n in range(1, order + 1):
                at = np.flatnonzero((kind == name) & (k == n))
                at = at[np.argsort(h[at])]
                self.tables[name, n] = h[at], v[at]

    def _look(self, kind: str, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[kind, k]
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, values[at]

    def logs(self, grams: np.ndarray, unseen: float) -> np.ndarray:
        """The logarithm of the probability of each last character; grams: a row of `order` characters each."""
        n, out, todo = self.order, np.zeros(len(grams), np.float32), np.arange(len(grams))
        for k in range(n, 0, -1):
            found, value = self._look("p", k, hash_rows(grams[todo, n - k :]))
            out[todo[found]] += value[found]
            todo = todo[~found]
            if k > 1:
                back, weight = self._look("w", k - 1, hash_rows(grams[todo, n - k : n - 1]))
                out[todo[back]] += weight[back]
        out[todo] += unseen
        return out


def hash_rows(points: np.ndarray) -> np.ndarray:
    """The hash of each row of characters, as hashes() has it for runs."""
    h = np.zeros(len(points), U)
    for i in range(points.shape[1] - 1, -1, -1):
        h = mixed(h * U(3) + points[:, i].astype(U) + U(1))
    return h


def shard_of(characters: list[np.ndarray], shards: int) -> np.ndarray:
    """By a hash of the last characters of a context."""
    h = np.zeros(len(characters[0]), U)
    for c in characters:
        h = mixed(h * U(3) + c.astype(U) + U(1))
    return (h % U(shards)).astype(np.int32)


def tail(order: int) -> int:
    """How many characters of a context decide the shard: two, so that no frequent character is a hot shard."""
    return min(2, order - 1)


def tables(model: tuple[DataFrame, DataFrame], order: int, shards: int) -> DataFrame:
    """(shard, kind, k, h, v): the model with hashed n-grams, sharded by the last characters of the context, those before the last
    character in probabilities. What is too short for that is in every shard: characters, pairs of them, and weights of single
    characters, whose number does not grow with the text."""
    t = tail(order)

    def run(batches):
        for batch in batches:
            grams = batch.column(1).to_pylist()
            points, length = _points("".join(grams)), np.array([len(g) for g in grams], np.int32)
            start, h = np.cumsum(length) - length, np.zeros(len(grams), U)
            for k, all_ in enumerate(hashes(points, int(length.max(initial=0)))):
                h[length == k] = all_[start[length == k]]
            p = np.array(batch.column(0).to_pylist()) == "p" if grams else np.zeros(0, bool)
            end = start + length - p  # of the context
            shard = np.full(len(grams), -1, np.int32)
            some = np.flatnonzero(length - p >= t)
            if len(some):
                shard[some] = shard_of([points[end[some] - t + i] for i in range(t)], shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), pa.array(length), pa.array(h.view(np.int64)), batch.column(2).cast(pa.float32())], names=["shard", "kind", "k", "h", "v"])

    rows = model[0].select(F.lit("p").alias("kind"), "gram", "v").unionByName(model[1].filter("gram <> ''").select(F.lit("w").alias("kind"), "gram", "v"))
    out = rows.mapInArrow(run, "shard int, kind string, k int, h long, v float")
    every = out.filter("shard < 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return out.filter("shard >= 0").unionByName(every)


def chunks(docs: DataFrame, chunk_chars: int, text: str) -> DataFrame:
    """docs with _chunk: neighbours in a task, of about chunk_chars characters; unique over tasks."""

    def run(batches):
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = []
            for n in batch.column(0).to_pylist():
                if size and size + n > chunk_chars:
                    chunk, size = chunk + 1, 0
                ids.append(chunk)
                size += n
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.int64())], names=[*batch.schema.names[1:], "_chunk"])

    sized = docs.select(F.coalesce(F.char_length(text), F.lit(0)).alias("_n"), *docs.columns)
    return sized.mapInArrow(run, docs.withColumn("_chunk", F.lit(0).cast("long")).schema)


def _bodies(texts, order: int):
    """Yields (rows, characters of each, points) of texts that have characters, so many at a time that their number stays bounded."""
    held, rows, size, total = [], [], [], 0

    def points():
        out = _points("".join(held))
        out[(out > 48) & (out <= 57)] = 48  # as normal() has digits
        return out

    for i, t in enumerate(texts):
        if t and (plain := " ".join(t.split())):
            held.append(START * (order - 1) + plain + END)
            rows.append(i)
            size.append(len(held[-1]))
            total += size[-1]
            if total > CHUNK:
                yield rows, np.array(size), points()
                held, rows, size, total = [], [], [], 0
    if held:
        yield rows, np.array(size), points()


def _pieces(texts, order: int):
    """Of so many texts at a time: rows, n-grams of each, points, the distinct hashes, where in points each of them begins, and for
    each n-gram the place of its hash."""
    for rows, size, points in _bodies(texts, order):
        ends = np.cumsum(size)
        at = np.concatenate([np.arange(e - n, e - order + 1) for e, n in zip(ends.tolist(), size.tolist(), strict=True)])
        h = hashes(points, order)[order][at]
        by = np.argsort(h)
        h = h[by]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        place = np.empty(len(h), np.int32)
        place[by] = np.cumsum(new) - 1
        yield rows, size - order + 1, points, h[new], at[by[new]], place


def distinct(pieces, order: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct n-grams, by shard and hash: shards, hashes and characters."""
    h, grams = np.zeros(0, U), np.zeros((0, order), np.uint32)
    for _, _, points, new, at, _ in pieces:
        if len(h):
            fresh = h[np.minimum(np.searchsorted(h, new), len(h) - 1)] != new
            new, at = new[fresh], at[fresh]
        h, grams = np.concatenate([h, new]), np.concatenate([grams, points[at[:, None] + np.arange(order)].astype(np.uint32)])
        by = np.argsort(h)
        h, grams = h[by], grams[by]
    shard = shard_of([grams[:, order - 1 - tail(order) + i] for i in range(tail(order))], shards)
    by = np.argsort(shard, kind="stable")
    return shard[by], h[by], grams[by]


def _score(docs: DataFrame, model: tuple[DataFrame, DataFrame], order: int, shards: int | None, chunk_chars: int, text: str) -> tuple[DataFrame, str]:
    """score(), and the name of the table of chunks that it reads."""
    spark, name = docs.sparkSession, new_table("chunks")
    docs = docs.drop("nll", "n_scored")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks(docs, chunk_chars, text).write.option("compression", "zstd").bucketBy(n, "_chunk").sortBy("_chunk").option("path", new_path(spark, "chunks")).saveAsTable(name)
    # what the model leaves to characters it has not seen: the weight of the empty context, shared by them
    spared = model[1].filter("gram = ''").first()
    unseen = float((spared.v if spared else 0.0) - np.log(model[0].filter(F.char_length("gram") == 1).count() + 1))
    shards = shards or max(n, -(-model[0].count() // SHARD_ROWS))
    rows, columns = spark.table(name), docs.columns

    def ask(key, table):
        shard, _, grams = distinct(_pieces(table["_text"].to_pylist(), order), order, shards)
        here, first = np.unique(shard, return_index=True)
        parts = [g.tobytes().decode("utf-32-le", "replace").encode() for g in np.split(grams, first[1:])] if len(here) else []
        return pa.table({"_chunk": pa.array(np.full(len(here), key[0].as_py()), pa.int64()), "shard": pa.array(here, pa.int32()), "grams": pa.array(parts, pa.binary())})

    def answer(batches):
        """Of each shard first the rows of the model, then the questions of one chunk after the other."""
        shard, held, scorer = None, [], None
        for batch in batches:
            sides, whose = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(whose) != 0) | (np.diff(sides) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if whose[a] != shard:
                    shard, held, scorer = whose[a], [], None
                part = batch.slice(a, b - a)
                if not sides[a]:
                    held.append(part.select(["kind", "k", "h", "v"]))
                    continue
                if scorer is None:
                    rows = pa.Table.from_batches(held) if held else part.slice(0, 0).select(["kind", "k", "h", "v"])
                    kind, k, h, v = (rows[c].to_numpy() if held else rows.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "k", "h", "v"))
                    scorer, held = Scorer(order, kind, k, h.astype(np.int64).view(U), v.astype(np.float32)), []
                for chunk, grams in zip(part.column("_chunk").to_pylist(), part.column("grams").to_pylist(), strict=True):
                    logs = scorer.logs(_points(grams.decode()).reshape(-1, order), unseen).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([shard], pa.int32()), pa.array([logs], pa.binary())], names=["_chunk", "shard", "logs"])

    def add_up(key, table, answers):
        kept, nll, scored = [], np.zeros(table.num_rows), np.zeros(table.num_rows, np.int64)

        def seen():
            for rows, n, points, hashed, at, place in _pieces(table[text].to_pylist(), order):
                kept.append((rows, n, hashed, place))
                yield rows, n, points, hashed, at, place

        _, h, _ = distinct(seen(), order, shards)
        by = np.argsort(h)
        h, logs = h[by], np.frombuffer(b"".join(answers.sort_by("shard")["logs"].to_pylist()), np.float32)[by]
        for rows, n, hashed, place in kept:
            values = logs[np.searchsorted(h, hashed)].astype(np.float64)[place]
            nll[rows], scored[rows] = -np.add.reduceat(values, np.cumsum(n) - n), n
        return pa.table([*(table[c] for c in columns), pa.array(nll), pa.array(scored)], names=[*columns, "nll", "n_scored"])

    asked = rows.select("_chunk", F.col(text).alias("_text")).groupBy("_chunk").applyInArrow(ask, "_chunk long, shard int, grams binary")
    none = lambda kind: F.lit(None).cast(kind)
    asked = asked.select("shard", F.lit(1).alias("side"), none("string").alias("kind"), none("int").alias("k"), none("long").alias("h"), none("float").alias("v"), "_chunk", "grams")
    parts = tables(model, order, shards).select("shard", F.lit(0).alias("side"), "kind", "k", "h", "v", none("long").alias("_chunk"), none("binary").alias("grams"))
    # each row of the model is shuffled once, whatever the number of chunks
    both = parts.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "side")
    answers = both.mapInArrow(answer, "_chunk long, shard int, logs binary")
    schema = docs.withColumns({"nll": F.lit(0.0), "n_scored": F.lit(0).cast("long")}).schema
    return rows.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(add_up, schema), name


def score(docs: DataFrame, model: tuple[DataFrame, DataFrame], order: int = 5, shards: int | None = None, chunk_chars: int = 8_000_000, text: str = "text") -> DataFrame:
    """docs with nll (the summed negative logarithm) and n_scored (characters, and one for the end), which replace columns of
    those names; 0 for null and empty texts. shards (by default one for SHARD_ROWS n-grams of the model, and one for each shuffle
    partition at least) and chunk_chars bound what a task holds; they change no result. The rows read
    a table of chunks, which common.remove_written() drops when they have been used."""
    return _score(docs, model, order, shards, chunk_chars, text)[0]


def classify(docs: DataFrame, trusted_ids: DataFrame, order: int = 5, low: float = 0.001, high: float = 0.999, slack: float = 0.25, prior: int = 50, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of docs: id, lang, n_scored, perplexity (a character), least and most (of its language), passes.
    trusted_ids: a DataFrame with the id of trusted documents."""
    base = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    ids = trusted_ids.select(F.col(id).alias("rep")).filter("rep is not null").distinct().withColumn("held", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(5)) == 0)
    fitted = ids.filter("not held").select("rep")
    trusted = likely(base.select("doc", "text"), fitted, "doc").filter("text is not null").join(fitted, F.col("doc") == F.col("rep"))
    scored, chunk_table = _score(base, train(trusted, order), order, None, 8_000_000, "text")
    scored = written(scored.drop("text"), "scored")
    base.sparkSession.sql(f"DROP TABLE IF EXISTS {chunk_table}")
    known = written(scored.join(ids.withColumnRenamed("rep", "doc"), "doc"), "known")
    mean = (F.sum("nll") / F.greatest(F.sum("n_scored"), F.lit(1))).alias("mean")
    x = (F.col("nll") + prior * F.col("mean")) / (F.col("n_scored") + prior)
    wide = lambda q: F.col("mean") + (1 + slack) * (q - F.col("mean"))

    def limits(rows: DataFrame) -> list:
        upper = F.coalesce(F.percentile_approx(F.when(F.col("held"), F.col("x")), high, 10_000), F.max("x"))
        return [F.first("mean").alias("mean"), F.percentile_approx("x", low, 10_000).alias("q_low"), upper.alias("q_high")]

    held = F.when(F.col("held"), F.col("nll")), F.when(F.col("held"), F.col("n_scored"))
    held_mean = F.coalesce(F.sum(held[0]) / F.nullif(F.sum(held[1]), F.lit(0)), mean).alias("mean")
    means = known.groupBy("lang").agg(held_mean)
    by_lang = known.join(means, known["lang"].eqNullSafe(means["lang"])).drop(means["lang"]).withColumn("x", x)
    by_lang = written(by_lang.groupBy(F.col("lang").alias("_lang")).agg(*limits(by_lang)), "limits")  # a row for each language
    every = known.crossJoin(F.broadcast(known.agg(held_mean))).withColumn("x", x)
    every = every.agg(*limits(every)).select(*(F.col(c).alias(f"{c}_all") for c in ("mean", "q_low", "q_high")))
    out = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["_lang"]), "left").crossJoin(F.broadcast(every))  # one row
    out = out.withColumns({c: F.coalesce(c, f"{c}_all") for c in ("q_low", "q_high")} | {"mean": F.coalesce("mean", "mean_all", F.lit(0.0))})
    least, most = wide(F.col("q_low")), wide(F.col("q_high"))
    return out.select(
        F.col("doc").alias(id), F.col("lang").alias(lang), "n_scored", F.exp(x).alias("perplexity"), F.exp(least).alias("least"), F.exp(most).alias("most"),
        F.coalesce(x.between(least - 1e-9, most + 1e-9), F.lit(True)).alias("passes"),
    )
