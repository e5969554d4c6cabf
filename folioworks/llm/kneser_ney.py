"""Text quality by perplexity under an interpolated modified Kneser-Ney model of bytes.

The model is trained on trusted texts (those whose label says so; a fifth of them is held
out for the thresholds). An n-gram of bytes is a number: its suffix is a mask of it, its
context a shift, so all counts, continuation counts, discounts and back-off weights are
DataFrame aggregates and joins, sharded by these numbers. All distinct n-grams of all
documents are joined with the counts of each order, which gives the log-probability of
each; a document's is the sum over its bytes. Documents are kept whose perplexity does not
exceed a quantile of the held-out trusted texts of their language.

Scale: tasks sum n-grams before the shuffle. The table of log-probabilities (one row for
each distinct n-gram of the corpus) is broadcast up to `broadcast_ngrams` rows; beyond it,
each document's distinct n-grams are joined with it by a shuffle. Log-probabilities are whole
numbers of 2**-24, so both give the same sums to the bit, whatever the partitions; so do
thresholds, which are taken from counts of steps of log-perplexity (`STEP`).

Defined results: null and empty texts have no perplexity (null) and are not kept; a null
language is a language of its own; a language without held-out texts takes the quantile of
all; without any, all texts with a perplexity are kept; repeated rows each give a row.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from .toxicity import held_out

#: Bytes of an n-gram (at most 7: a number holds it, and stays positive).
ORDER = 5
#: Share of held-out trusted texts that a threshold lets pass.
QUANTILE = 0.99
#: What a log-probability is a whole number of; and a threshold's logarithm.
UNIT, STEP = 2.0**-24, 2.0**-10
#: n-grams whose log-probabilities are broadcast at most (12 bytes each).
BROADCAST_NGRAMS = 4_000_000
#: Ids of trusted texts that are broadcast at most.
BROADCAST_IDS = 1_000_000


def ngrams(data: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte; before a text there are zero bytes."""
    out = np.zeros(len(data), np.int64)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    for j in range(order):
        shifted = np.zeros(len(data), np.int64)
        shifted[j:] = data[: len(data) - j] if j else data
        shifted[place < j] = 0
        out |= shifted << (8 * j)
    return out


def _counted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weight is not None:
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], weight[order]
    else:
        keys = np.sort(keys)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if weight is None:
        return keys[head], np.diff(np.concatenate([head, [len(keys)]]))
    return keys[head], np.add.reduceat(weight, head) if len(head) else weight


def corpus_ngrams(rows: DataFrame, order: int) -> DataFrame:
    """ngram, n (occurrences in trusted texts; 0 if only others have it), from rows (_text, _train)."""

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        todo_keys, todo_counts, waiting = [], [], 0

        def merged():
            return _counted(np.concatenate([keys, *todo_keys]), np.concatenate([counts, *todo_counts]))

        for batch, data, offs in c.text_slices(batches):
            g = ngrams(data, offs, order)
            trusted = np.repeat(batch.column("_train").to_numpy(zero_copy_only=False), np.diff(offs))
            for some, own in ((g[trusted], True), (g[~trusted], False)):
                k, n = _counted(some)
                todo_keys.append(k)
                todo_counts.append(n if own else np.zeros(len(n), np.int64))
                waiting += len(k)
            if waiting > 1_000_000:
                keys, counts = merged()
                todo_keys, todo_counts, waiting = [], [], 0
                if len(keys) > 2_000_000:  # bounded memory: the rest is summed by Spark
                    yield pa.RecordBatch.from_pydict({"ngram": keys, "n": counts})
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = merged()
        for i in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_pydict({"ngram": keys[i : i + 200_000], "n": counts[i : i + 200_000]})

    return rows.mapInArrow(run, "ngram long, n long").groupBy("ngram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts of 1, 2 and 3 or more, from the counts of counts."""
    n = [float(x or 0) for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) if n[k - 1] and n[k] else k / 2 for k in (1, 2, 3)]


def model(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (ngram, p) of those seen, and (context, gamma), the weight of the shorter model."""
    of = {order: counts.filter("n > 0")}
    for k in range(order - 1, 0, -1):  # lower orders count the distinct n-grams that end so
        of[k] = c.materialize(of[k + 1].groupBy(F.col("ngram").bitwiseAND((1 << 8 * k) - 1).alias("ngram")).agg(F.count("*").alias("n")))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(of[k])
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        seen = of[k].withColumn("context", F.shiftright("ngram", 8)).withColumn("suffix", F.col("ngram").bitwiseAND((1 << 8 * (k - 1)) - 1))
        # numbers of rows with each cut, so that sums are of whole numbers and the same in any order
        ones, twos = F.sum((n == 1).cast("long")), F.sum((n == 2).cast("long"))
        gamma = (ones * d1 + twos * d2 + (F.count("*") - ones - twos) * d3) / F.sum("n")
        total = c.materialize(seen.groupBy("context").agg(F.sum("n").alias("total"), gamma.alias("gamma")))
        rows = seen.join(total, "context")
        if k == 1:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.join(out[-1][0].select(F.col("ngram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        p = c.materialize(rows.select("ngram", (F.greatest(n - cut, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p")))
        out.append((p, total.select("context", "gamma")))
    return out


def log_probabilities(grams: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """ngram, lp for all n-grams in grams: the longest order that has it, times the weights passed on the way.

    Each order is a step of its own, stored, so that a plan holds two joins at most.
    """
    rows = grams.select("ngram", F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("p"))
    for k in range(len(levels), 0, -1):
        p, gamma = levels[k - 1]
        open_ = F.col("p").isNull()
        rows = rows.withColumn("suffix", F.col("ngram").bitwiseAND((1 << 8 * k) - 1)).withColumn("context", F.shiftright("suffix", 8))
        rows = rows.join(p.select(F.col("ngram").alias("suffix"), F.col("p").alias("own")), "suffix", "left").join(gamma, "context", "left")
        found = F.when(open_, F.col("own"))
        weight = F.when(open_ & F.col("own").isNull(), F.col("weight") * F.coalesce("gamma", F.lit(1.0))).otherwise(F.col("weight"))
        rows = c.materialize(rows.select("ngram", weight.alias("weight"), F.coalesce("p", found).alias("p")))
    return rows.select("ngram", F.log(F.col("weight") * F.coalesce("p", F.lit(1 / 256))).alias("lp"))


class Table:
    """An open-addressed table of numbers; every number asked for must be in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask, self.keys, self.values = np.uint64((1 << bits) - 1), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        place = self.place(keys)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]], self.values[place[free]] = keys[free], values[free]
            left = self.keys[place] != keys
            keys, values, place = keys[left], values[left], (place[left] + 1) & int(self.mask)

    def place(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) & self.mask).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        out = self.values[at]
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            out[wrong] = self.values[at[wrong]]
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return out


def _by_broadcast(rows: DataFrame, lp: DataFrame, order: int, schema: T.StructType) -> DataFrame:
    got = lp.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((got["ngram"].to_numpy(), got["lp"].to_numpy()))
    del got

    def run(batches):
        t = None
        for batch, data, offs in c.text_slices(batches):
            t = t or Table(*shared.value)
            sums = np.concatenate([[0], np.cumsum(t(ngrams(data, offs, order)))])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(np.diff(offs)), pa.array(sums[offs[1:]] - sums[offs[:-1]])], names=schema.names)

    return rows.select("_row", "_text").mapInArrow(run, schema)


def _by_shuffle(rows: DataFrame, lp: DataFrame, order: int, schema: T.StructType) -> DataFrame:
    """The documents (distinct rows of id, language, label and text) joined with the table by their n-grams."""
    keyed = rows.withColumn("_fp", F.xxhash64("_text"))
    fields = [keyed.schema["_row"], T.StructField("_fp", T.LongType()), T.StructField("ngram", T.LongType()), T.StructField("n", T.LongType())]

    def run(batches):
        for batch, data, offs in c.text_slices(batches):
            g = ngrams(data, offs, order)
            for i in range(batch.num_rows):
                k, n = _counted(g[offs[i] : offs[i + 1]])
                take = pa.array(np.full(len(k), i))
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(take), batch.column("_fp").take(take), pa.array(k), pa.array(n)], names=["_row", "_fp", "ngram", "n"])

    grams = keyed.select("_row", "_fp", "_text").dropDuplicates(["_row", "_fp"]).mapInArrow(run, T.StructType(fields))
    sums = grams.join(lp, "ngram").groupBy("_row", "_fp").agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.col("lp")).alias("log_prob"))
    both = keyed.select("_row", "_fp").join(sums.withColumnRenamed("_row", "_r").withColumnRenamed("_fp", "_f"), F.col("_row").eqNullSafe(F.col("_r")) & (F.col("_fp") == F.col("_f")), "left")
    return both.select("_row", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.coalesce("log_prob", F.lit(0)).alias("log_prob"))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", order: int = ORDER, quantile: float = QUANTILE, broadcast_ngrams: int = BROADCAST_NGRAMS) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity (per byte), threshold, keep."""
    good = labels.filter(F.col(label) == 1).select(F.col(doc_id).alias("_l")).filter("_l is not null").distinct()
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    base = docs.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    base = base.join(F.broadcast(good) if few else good, F.col("_id") == F.col("_l"), "left")
    trusted, test = F.col("_l").isNotNull(), held_out("_id")
    rows = base.select(F.struct("_id", "_lang", (trusted & test).alias("_test")).alias("_row"), (trusted & ~test).alias("_train"), "_text")
    counts = c.materialize(corpus_ngrams(rows.select("_text", "_train"), order))
    lp = c.materialize(log_probabilities(counts, model(counts, order)).select("ngram", F.round(F.col("lp") / UNIT).cast("long").alias("lp")))
    schema = T.StructType([rows.schema["_row"], T.StructField("n_bytes", T.LongType()), T.StructField("log_prob", T.LongType())])
    small = lp.limit(broadcast_ngrams + 1).count() <= broadcast_ngrams
    scored = (_by_broadcast if small else _by_shuffle)(rows, lp, order, schema)
    scored = c.materialize(scored.select("_row.*", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_prob") * UNIT / F.col("n_bytes"))).alias("perplexity")))
    limits = c.materialize(thresholds(scored.filter("_test and perplexity is not null"), quantile))
    overall = limits.filter("is_all").select("own").first()
    own = limits.filter("not is_all").select(F.col("_lang").alias("_of"), "own")
    out = scored.join(F.broadcast(own) if c.is_small(own) else own, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(overall and overall["own"]).cast("double"), F.lit(float("inf"))))
    return out.select(F.col("_id").alias(doc_id), F.col("_lang").alias(lang), "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))


def thresholds(test: DataFrame, quantile: float) -> DataFrame:
    """_lang, is_all, own: the least step of perplexity that a share of `quantile` of each language's rows (of all rows: is_all) does not exceed."""
    steps = test.groupBy("_lang", F.ceil(F.log("perplexity") / STEP).cast("long").alias("step")).agg(F.count("*").alias("n"))
    both = steps.select("_lang", F.lit(False).alias("is_all"), "step", "n").unionByName(steps.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("_lang"), F.lit(True).alias("is_all"), "step", "n"))
    kind = Window.partitionBy("_lang", "is_all")  # a few thousand steps of a language at most
    share = F.sum("n").over(kind.orderBy("step")) / F.sum("n").over(kind)
    return both.withColumn("share", share).filter(F.col("share") >= quantile).groupBy("_lang", "is_all").agg(F.exp(F.min("step") * STEP).alias("own"))
