"""Toxicity by a factorization machine over hashed terms.

Terms are whole words and word beginnings, hashed. The machine adds to a linear weight of
each term a learned interaction of each pair of terms (the inner product of their
factors), so that an insult beside a mention of people weighs more than either alone.

No term is left out before training. A penalty on the size of linear weights leaves
those at zero that too few rows speak for; a term enters pairs by the root of its share of
the rows, so that a pair must be met often before it counts, and rare terms of long texts
do not add up to noise.

Training takes a bounded sample of the labelled rows: at most `sample` of each class, the
ones with the least hashes, whose hashed terms (not texts) meet in one task. Classes are
sampled at rates of their own, so the bias is set back by the rates, from counts over all
labelled documents of training: scores are those of the whole mix of classes, whatever the
size. Scoring is a map over all rows; the model is one broadcast of bounded size (a row of
FACTORS + 2 numbers for each of at most 2**BITS slots).

Defined results: null and empty texts have no terms and get the score of the bias; labels
that are null or without a document are left out; a document with several labels counts
as toxic if one says so; rows of one id and text are one document, of one id and several
texts several; without labelled rows of both classes every score is 0; a column named as
the score is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

BITS = 20
#: Bytes of a word's beginning, which is a term of its own.
PREFIX = 5
FACTORS = 4
#: Labelled rows of each class that training takes at most.
SAMPLE = 4000
#: Penalties: on the size of each linear weight, and on the square of factors.
SPARSE, SMALL = 1.0, 5.0
EPOCHS, BATCH = 15, 64

_U = np.uint64


def _hasher() -> c.WordHash:
    return c.WordHash(41, c.ALNUM_WORDS, fold=True)


def terms(data: np.ndarray, offs: np.ndarray, hasher: c.WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each row, sorted by row, as (rows, slots)."""
    starts, ends, rows = c.words(data, offs, c.ALNUM_WORDS)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    whole = hasher(data, starts)
    long = np.flatnonzero(ends - starts > PREFIX)
    head = np.zeros(len(long), np.uint64)
    for j in range(PREFIX):
        head = c.mix(head * _U(0x9E3779B97F4A7C15) + c.LOWER[data[starts[long] + j]].astype(np.uint64) + _U(1))
    slot = np.concatenate([whole, c.mix(head + _U(7))]) & _U((1 << BITS) - 1)
    both = np.unique((np.concatenate([row, row[long]]) << BITS) | slot.astype(np.int64))
    return both >> BITS, both & ((1 << BITS) - 1)


class Machine:
    """w0 + sum of w + pairs of v, over the slots of a text. slots: those with a weight or factors."""

    def __init__(self, bias: float, slots: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.slots = float(bias), np.asarray(slots, np.int32)
        self.at = np.full(1 << BITS, len(self.slots), np.int32)
        self.at[self.slots] = np.arange(len(self.slots))
        self.w = np.append(np.asarray(w, np.float32), np.float32(0))
        self.v = np.append(np.asarray(v, np.float32), np.zeros((1, v.shape[1]), np.float32), axis=0)

    def raw(self, n: int, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
        at = self.at[slot]
        keep = at < len(self.slots)
        row, at = row[keep], at[keep]
        out = self.bias + np.bincount(row, self.w[at], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(row, x, minlength=n) ** 2 - np.bincount(row, x * x, minlength=n))
        return out

    def score(self, n: int, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(n, row, slot), -40, 40)))


def fit(slots: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 5) -> Machine:
    """Steps of Adagrad on the logistic loss with both penalties; the weights are means over the last epochs."""
    n = len(y)
    if not n or y.min() == y.max():
        return Machine(-40.0, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, factors)))
    lens = np.array([len(x) for x in slots])
    known, col = np.unique(np.concatenate(slots).astype(np.int64), return_inverse=True)
    size, bounds = len(known), np.concatenate([[0], np.cumsum(lens)])
    scale = np.sqrt(np.bincount(col, minlength=size) / n)[:, None]
    rng = np.random.default_rng(seed)
    w, gw, mean_w = np.zeros(size), np.full(size, 1e-2), np.zeros(size)
    v, gv, mean_v = rng.normal(0, 0.05, (size, factors)), np.ones((size, factors)), np.zeros((size, factors))
    b, gb, mean_b, steps = float(np.log(y.sum() / (n - y.sum()))), 1.0, 0.0, 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            some = order[k : k + BATCH]
            truth, m = y[some], len(some)
            here, j = np.unique(col[c.ranges(bounds[some], lens[some])], return_inverse=True)
            r = np.repeat(np.arange(m), lens[some])
            x = (v[here] * scale[here])[j]
            s = np.stack([np.bincount(r, x[:, f], minlength=m) for f in range(factors)], axis=1)
            pairs = 0.5 * ((s**2).sum(axis=1) - np.bincount(r, (x**2).sum(axis=1), minlength=m))
            raw = b + np.bincount(r, w[here][j], minlength=m) + pairs
            g = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - truth
            dw = np.bincount(j, g[r], minlength=len(here))
            gw[here] += dw**2
            w[here] -= 0.5 * dw / np.sqrt(gw[here])
            w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * SPARSE * m / n / np.sqrt(gw), 0)
            for f in range(factors):
                dv = np.bincount(j, g[r] * (s[r, f] - x[:, f]), minlength=len(here)) * scale[here, 0] + SMALL * m / n * v[here, f]
                gv[here, f] += dv**2
                v[here, f] -= 0.1 * dv / np.sqrt(gv[here, f])
            gb += g.sum() ** 2
            b -= 0.3 * g.sum() / np.sqrt(gb)
        if epoch >= epochs - 3:
            mean_w, mean_v, mean_b, steps = mean_w + w, mean_v + v, mean_b + b, steps + 1
    return Machine(mean_b / steps, known, mean_w / steps, mean_v / steps * scale)


def held_out(doc_id) -> F.Column:
    """Rows kept out of training: a fifth of the ids, by their checksum."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """_id, _fp, _y of the documents to train on (the least hashes of each class), and how many each class has."""
    y = labels.select(F.col(doc_id).alias("_l"), F.col(label).cast("int").alias("_y")).filter("_l is not null and _y in (0, 1)").groupBy("_l").agg(F.max("_y").alias("_y"))
    y = y.filter(~held_out("_l"))
    keys = c.id_and_text(docs, doc_id, text).select("_id", F.xxhash64("_text").alias("_fp"))  # no text is shuffled
    rows = keys.join(y, F.col("_id") == F.col("_l")).select("_id", "_fp", "_y").distinct()
    rows = c.materialize(rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64("_id", "_fp", F.lit(41)), 2)))
    total = {x["_y"]: x["n"] for x in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for k in (0, 1):
        # hashes are even: a bound on them leaves a little over `sample` rows to sort
        bound = min((1 << 62) - 1, int(1.5 * sample / max(1, total.get(k, 0)) * 2.0**62))
        own = rows.filter((F.col("_y") == k) & (F.col("_h") <= bound)).orderBy("_h", "_id", "_fp").limit(sample)
        picked = own if picked is None else picked.unionByName(own)
    return c.materialize(picked.select("_id", "_fp", "_y")), total


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Learns from labelled rows that are not held out, in one task; the driver gets the weights."""
    picked, total = sampled_rows(docs, labels, doc_id, text, label, sample)
    p = picked.select(F.col("_id").alias("_p"), F.col("_fp").alias("_q"), "_y")
    base = c.id_and_text(docs, doc_id, text)
    rows = base.join(F.broadcast(p), (F.col("_id") == F.col("_p")) & (F.xxhash64("_text") == F.col("_q"))).select("_p", "_q", "_y", "_text")

    def cut(batches):
        hasher = _hasher()
        for batch, data, offs in c.text_slices(batches):
            row, slot = terms(data, offs, hasher)
            n = np.bincount(row, minlength=len(offs) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("_p").cast(pa.string()), *(batch.column(x) for x in ("_q", "_y")), c.list_array(pa.array(slot.astype(np.int32)), n)], names=["_p", "_q", "_y", "slots"])

    def learn(batches):
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        got = pa.Table.from_batches(batches).sort_by([("_p", "ascending"), ("_q", "ascending")])
        lists = got["slots"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
        m = fit(np.split(flat, ends[:-1]), got["_y"].to_numpy().astype(np.float64))
        one = lambda x: c.list_array(pa.array(x), np.array([len(x)]))
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), one(m.slots), one(m.w[:-1]), one(m.v[:-1].reshape(-1))], names=["bias", "slots", "w", "v"])

    seen = rows.mapInArrow(cut, "_p string, _q long, _y int, slots array<int>").dropDuplicates(["_p", "_q"])
    model = seen.repartition(1).mapInArrow(learn, "bias double, slots array<int>, w array<float>, v array<float>").toArrow()
    if not model.num_rows:
        return fit([], np.zeros(0))
    slots, w, v = (model[x].combine_chunks().flatten().to_numpy() for x in ("slots", "w", "v"))
    bias = model["bias"][0].as_py()
    if total.get(0) and total.get(1):
        bias += prior_shift(total[1], total[0], sample)
    return Machine(bias, slots, w, v.reshape(-1, FACTORS))


def prior_shift(toxic: int, clean: int, sample: int) -> float:
    """What the bias of a machine lacks that saw at most `sample` rows of each class."""
    return float(np.log(min(sample, clean) / clean) - np.log(min(sample, toxic) / toxic))


def _scorer(docs: DataFrame, machine: Machine):
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.slots, machine.w[:-1], machine.v[:-1]))

    def run(batches, column):
        m, hasher = Machine(*shared.value), _hasher()
        for batch, data, offs in c.text_slices(batches, column=column):
            yield batch, m.score(len(offs) - 1, *terms(data, offs, hasher))

    return run


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores, 0 to 1."""
    rest = docs.drop(name)
    schema, scores = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())]), _scorer(docs, machine)
    at = rest.columns.index(text)

    def run(batches):
        for batch, s in scores(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=schema.names)

    return rest.mapInArrow(run, schema)


def below(docs: DataFrame, machine: Machine, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of docs with a score below `most`."""
    scores, at = _scorer(docs, machine), docs.columns.index(text)

    def run(batches):
        for batch, s in scores(batches, at):
            yield batch.filter(pa.array(s < most))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    machine = train(docs, labels, doc_id, text, label, sample)
    scored = score(c.id_and_text(docs, doc_id, text), machine, "_text", "_score")
    return scored.select(F.col("_id").alias(doc_id), held_out("_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
