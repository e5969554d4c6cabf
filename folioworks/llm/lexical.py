"""Ranked lexical search: all documents for each item of a query table, by norm buckets of impact vectors (LEMP).

A document's impact vector has, for each of its terms, tf saturated and set off against the
document's length; an item's vector has the weights of its terms, which fall with the number
of documents that hold them. A score is their inner product, in whole numbers. Both sides
carry the root of a term's weight, so that frequent terms add little to a vector's length.

1. One map over the texts keeps the terms that items use, with tf (their texts go nowhere).
   Statistics are aggregates of these rows.
2. The longest impact vectors are scored first; each item's 10th best there is a threshold
   that its final results can't fall below.
3. A map over the stored vectors orders a chunk by length and cuts it into buckets. An item
   skips a bucket, and with it all shorter ones, when the product of both lengths is below its
   threshold (Cauchy-Schwarz). Inside, the largest impact of each term in the bucket bounds a
   coordinate: terms that can't reach the threshold together are left for later, and only
   documents with one of the other terms are candidates. What these have so far, plus the
   smaller of both bounds for the rest, leaves the survivors; they are scored exactly, in
   64-bit integers, and raise the task's threshold.
4. Each task hands on at most 10 rows an item; a window ranks them.

Scale: no text is shuffled and no document meets an item outside a task. Items come in blocks
of bounded terms (BLOCK_TERMS); a block's terms and weights are what is broadcast, and
each block is a pass of its own over the documents. Document words are compared by 64-bit hashes.

Defined results: null and blank texts have no terms and count nowhere; a document row with
a null id is ranked after others of its score; rows of one id are documents of their own;
rows of one item id (null too) are one item with the terms of all; items without terms have no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import _common as c

BEST = 10
#: Terms of items that one pass over the documents takes.
BLOCK_TERMS = 1 << 18
#: Longest vectors that give the first thresholds.
SEEDS = 1024
#: Rows that are ordered together, and rows of a bucket.
CHUNK, BUCKET = 1 << 14, 1 << 10
#: Bounds are doubles; this keeps their rounding from pruning anything.
SLACK = 1 + 1e-9

_INTS, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())


def _hasher() -> c.WordHash:
    return c.WordHash(77, c.ALNUM_WORDS)


def _hashed(data: np.ndarray, offs: np.ndarray, hasher: c.WordHash) -> tuple[np.ndarray, np.ndarray]:
    data = c.LOWER[data]
    starts, _, rows = c.words(data, offs, c.ALNUM_WORDS)
    return hasher(data, starts).view(np.int64), rows


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """_id, term: the distinct hashed terms of each item."""
    base = c.id_and_text(items, item_id, text)
    schema = T.StructType([base.schema["_id"], T.StructField("terms", _LONGS)])

    def run(batches):
        hasher = _hasher()
        for batch, data, offs in c.text_slices(batches):
            h, rows = _hashed(data, offs, hasher)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), c.list_array(pa.array(h), np.diff(rows))], names=schema.names)

    return base.mapInArrow(run, schema).select("_id", F.explode("terms").alias("term")).distinct()


def vectors(docs: DataFrame, vocabulary: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """_id, n (terms of the document), terms (numbers in the sorted vocabulary), tfs."""
    base = c.id_and_text(docs, doc_id, text)
    schema = T.StructType([base.schema["_id"], T.StructField("n", T.LongType()), T.StructField("terms", _INTS), T.StructField("tfs", _LONGS)])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        hasher, known = _hasher(), shared.value
        for batch, data, offs in c.text_slices(batches):
            h, rows = _hashed(data, offs, hasher)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            pair, tf = np.unique(row[hit] * len(known) + at[hit], return_counts=True)
            per = np.bincount(pair // len(known), minlength=len(rows) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.diff(rows)), c.list_array(pa.array((pair % len(known)).astype(np.int32)), per), c.list_array(pa.array(tf.astype(np.int64)), per)], names=schema.names)

    return base.mapInArrow(run, schema)


class _Items:
    """A block of items: each one's terms and weights, and the threshold it has reached."""

    def __init__(self, names: list, of: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        order = np.lexsort((terms, of))
        self.names, self.terms, self.weights = names, terms[order], weights
        self.ends = np.cumsum(np.bincount(of, minlength=len(names)))
        total = np.concatenate([[0], np.cumsum(weights[self.terms])])
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.length = np.sqrt((total[self.ends] - total[starts]).astype(np.float64))
        self.least = np.zeros(len(names))

    def of(self, k: int) -> np.ndarray:
        return self.terms[(self.ends[k - 1] if k else 0) : self.ends[k]]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of a column of lists."""
    offs = np.asarray(column.offsets)
    return np.asarray(column.values)[offs[0] : offs[-1]], np.diff(offs)


def _impacts(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, impacts, number of terms and length of each row's vector."""
    terms, counts = _lists(batch.column("terms"))
    tf, _ = _lists(batch.column("tfs"))
    x = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.asarray(batch.column("m")), counts))
    total = np.bincount(np.repeat(np.arange(len(counts)), counts), weights[terms] * x.astype(np.float64) ** 2, minlength=len(counts))
    return terms, x, counts, np.sqrt(total)


class _Search:
    """The best rows of each item among the chunks that a task sees."""

    def __init__(self, items: _Items, best: int = BEST):
        self.items, self.most = items, best
        self.least, self.found = items.least.copy(), [[] for _ in items.names]
        self.scratch = np.zeros(len(items.weights), np.int64)
        self.compared = 0

    def add(self, ids: pa.Array, terms: np.ndarray, x: np.ndarray, counts: np.ndarray, length: np.ndarray) -> None:
        order = np.argsort(-length, kind="stable")
        first = np.cumsum(counts) - counts
        at = c.ranges(first[order], counts[order])
        terms, x, counts, length = terms[at], x[at], counts[order], length[order]
        ends = np.cumsum(counts)
        for a in range(0, len(counts), BUCKET):
            b = min(a + BUCKET, len(counts))
            live = np.flatnonzero((self.items.length * length[a] * SLACK >= self.least) & (self.items.length > 0))
            if not len(live) or not length[a]:
                break  # all that follows is shorter
            lo, hi = ends[a] - counts[a], ends[b - 1]
            self._bucket(live, ids, order[a:b], terms[lo:hi], x[lo:hi], counts[a:b], length[a:b])

    def _bucket(self, live, ids, order, terms, x, counts, length) -> None:
        weights, n = self.items.weights, len(counts)
        row, first = np.repeat(np.arange(n), counts), np.cumsum(counts) - counts
        by_term = np.argsort(terms, kind="stable")
        t, px, pd = terms[by_term], x[by_term], row[by_term]
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        kinds, size, top = t[head], np.diff(np.concatenate([head, [len(t)]])), np.maximum.reduceat(px, head)
        for k in live:
            own = self.items.of(k)
            at = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
            at = at[kinds[at] == own]
            w = weights[kinds[at]]
            at, w = at[w > 0], w[w > 0]
            bound = w * top[at]
            least = max(self.least[k], 1.0)
            if bound.sum() * SLACK < least:
                continue
            by = np.argsort(-bound, kind="stable")
            at, w, bound = at[by], w[by], bound[by]
            rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])  # what the terms from here on can add
            m = int(np.argmax(rest * SLACK < least))
            where = c.ranges(head[at[:m]], size[at[:m]])
            part = np.bincount(pd[where], px[where] * np.repeat(w[:m], size[at[:m]]).astype(np.float64), minlength=n)
            more = np.minimum(float(rest[m]), np.sqrt(float(w[m:].sum())) * length)
            left = np.flatnonzero((part > 0) & ((part + more) * SLACK >= least))
            if not len(left):
                continue
            self.compared += len(left)
            self.scratch[own] = weights[own]
            inside = c.ranges(first[left], counts[left])
            score = np.add.reduceat(self.scratch[terms[inside]] * x[inside], np.cumsum(counts[left]) - counts[left])
            self.scratch[own] = 0
            good = np.flatnonzero(score >= least)
            if len(good):
                self._keep(k, score[good], ids.take(pa.array(order[left[good]])).to_pylist())

    def _keep(self, k: int, scores: np.ndarray, names: list) -> None:
        mine = self.found[k] + [(-s, name is None, name) for s, name in zip(scores.tolist(), names, strict=True)]
        mine.sort(key=lambda r: (r[0], r[1], r[2] if not r[1] else 0))
        self.found[k] = mine[: self.most]
        if len(mine) >= self.most:
            self.least[k] = max(self.least[k], -self.found[k][-1][0])


def _best(rows: DataFrame, shared, item: T.DataType, best: int) -> DataFrame:
    """item, _id, score: the best rows of each task."""
    schema = T.StructType([T.StructField("item", item), T.StructField("_id", rows.schema["_id"].dataType), T.StructField("score", T.LongType())])

    def run(batches):
        items = shared.value
        search, held, waiting = _Search(items, best), [], 0

        def flush():
            if held:
                ids = pa.concat_arrays([h[0] for h in held])
                search.add(ids, *(np.concatenate([h[j] for h in held]) for j in range(1, 5)))
                held.clear()

        kind = None
        for batch in batches:
            kind = batch.column("_id").type
            for a in range(0, len(batch), CHUNK):
                part = batch.slice(a, CHUNK)
                held.append((part.column("_id"), *_impacts(part, items.weights)))
                waiting += len(part)
                if waiting >= CHUNK:
                    flush()
                    waiting = 0
        flush()
        out = [(items.names[k], r[2], -r[0]) for k, rows in enumerate(search.found) for r in rows]
        if out:
            names = pa.Table.from_pylist([{"item": r[0]} for r in out]).column("item").combine_chunks() if any(r[0] is not None for r in out) else pa.nulls(len(out))
            yield pa.RecordBatch.from_arrays([names.cast(arrow_item), pa.array([r[1] for r in out], kind), pa.array([r[2] for r in out], pa.int64())], names=schema.names)

    arrow_item = to_arrow_type(item)
    return rows.select("_id", "m", "terms", "tfs").mapInArrow(run, schema)


def _longest(rows: DataFrame, shared, seeds: int) -> DataFrame:
    """The rows with the longest impact vectors; each task offers its own longest ones."""
    schema = T.StructType([*rows.schema.fields, T.StructField("length", T.DoubleType())])

    def run(batches):
        for batch in batches:
            length = _impacts(batch, shared.value.weights)[3]
            some = pa.array(np.sort(np.argsort(-length, kind="stable")[:seeds]))
            yield pa.RecordBatch.from_arrays([*batch.take(some).columns, pa.array(length).take(some)], names=schema.names)

    return rows.mapInArrow(run, schema).orderBy(F.col("length").desc()).limit(seeds).drop("length")


def _block(docs: DataFrame, pairs: DataFrame, item: T.DataType, doc_id: str, text: str, best: int) -> DataFrame | None:
    """item, _id, score: candidates for the best of a block's items; at most `best` of each task for an item."""
    spark = docs.sparkSession
    got = pairs.toArrow()
    if not len(got):
        return None
    vocabulary, of_term = np.unique(np.asarray(got["term"]), return_inverse=True)
    names, number, of = [], {}, []
    for name in got["_id"].to_pylist():
        if name not in number:
            number[name] = len(names)
            names.append(name)
        of.append(number[name])
    kept = c.materialize(vectors(docs, vocabulary, doc_id, text))
    total = kept.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    often = np.zeros(len(vocabulary), np.int64)
    df = kept.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    often[np.asarray(df["t"])] = np.asarray(df["count"])
    weights = np.floor(1000 * np.log((2 * total["N"] + 2) / (2 * often + 1))).astype(np.int64)
    items = _Items(names, np.array(of, np.int64), of_term.reshape(-1), np.maximum(weights, 0))
    whole = "decimal(38,0)"
    m = (F.lit(100 - 90) + F.expr(f"cast((cast(90 as {whole}) * cast(n as {whole}) * cast({total['N']} as {whole})) div cast({max(1, total['L'])} as {whole}) as bigint)")).alias("m")
    rows = kept.filter(F.size("terms") > 0).select("_id", m, "terms", "tfs")
    shared = spark.sparkContext.broadcast(items)
    first = _best(_longest(rows, shared, SEEDS).repartition(16), shared, item, best).select("item", "score").collect()
    scores: dict = {}
    for r in first:
        scores.setdefault(r["item"], []).append(r["score"])
    for name, s in scores.items():
        if len(s) >= best:
            items.least[number[name]] = sorted(s)[-best]
    return _best(rows, spark.sparkContext.broadcast(items), item, best)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's best documents with a score above 0."""
    spark: SparkSession = docs.sparkSession
    kind = items.schema[item_id].dataType
    pairs = c.materialize(item_terms(items, item_id, item_text))
    blocks = -(-pairs.count() // block_terms)
    found = spark.createDataFrame([], T.StructType([T.StructField("item", kind), T.StructField("_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]))
    for k in range(blocks):
        one = _block(docs, pairs.filter(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == k) if blocks > 1 else pairs, kind, doc_id, text, best)
        if one is not None:
            found = found.unionByName(c.materialize(one)) if blocks > 1 else one
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last()))
    return found.withColumn("rank", place).filter(F.col("rank") <= best).select(F.col("item").alias(item_id), "rank", F.col("_id").alias(doc_id), "score")
