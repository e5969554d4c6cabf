"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of the benchmark items (an item
of fewer words is one window). A block is two words. The shift table, indexed by a hash
of a block, says how far a scan may jump; where it says 0, the bucket of patterns that
end in this block is tested, first by the hash of their first block, then by comparing
the bytes of the words.

Scale: documents stay where they are read (no shuffle). Benchmark items come to the
driver in blocks of at most `block_bytes` of text, each a broadcast of bounded size; a
larger benchmark means more passes over the documents, each adding to their spans. After
every `CHAIN` passes the rows are stored and the blocks let go, so that neither a task
nor the driver holds more tables than that, however large the benchmark.

Defined results: null or empty texts and items have no words; repeated rows each give a
row; an item without an id marks words but is not listed; an empty benchmark marks none.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Positions that one lane of a scan covers.
LANE = 256
#: Passes of one plan.
CHAIN = 4
#: Candidate pairs that are compared in one step.
STEP = 200_000


def _hasher() -> c.WordHash:
    return c.WordHash(11, c.ALNUM_WORDS, fold=True)


def _pair(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block of `width` words that ends at word `at`."""
    return h[at] if width == 1 else c.mix(h[at - 1] * np.uint64(0x9E3779B97F4A7C15) + h[at])


class Patterns:
    """Tables of one block of items. groups: for each window length its shifts and buckets."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, rows = c.words(data, offs, c.ALNUM_WORDS)
        h = _hasher()(data, starts)
        self.ids, self.text = ids, c.LOWER[data].tobytes()
        self.starts, self.ends = starts, ends
        by = defaultdict(list)
        for item, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
            if b > a:
                m = min(window, int(b - a))
                by[m].append((np.arange(a, b - m + 1), np.full(b - a - m + 1, item)))
        self.groups = []
        for m, found in sorted(by.items()):
            first, item = (np.concatenate(x) for x in zip(*found, strict=True))
            width = min(2, m)
            suffix = _pair(h, first + m - 1, width)
            order = np.argsort(suffix, kind="stable")
            first, item, suffix = first[order], item[order], suffix[order]
            bits = max(12, int(np.ceil(np.log2(len(first) * m * 8))))
            shift = np.full(1 << bits, m - width + 1, np.min_scalar_type(m))
            for at in range(width - 1, m):
                np.minimum.at(shift, (_pair(h, first + at, width) & np.uint64((1 << bits) - 1)).astype(np.int64), m - 1 - at)
            self.groups.append((m, width, np.uint64((1 << bits) - 1), shift, suffix, _pair(h, first + width - 1, width), first, item))

    def __bool__(self) -> bool:
        return bool(self.groups)

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, end word, item) of every occurrence."""
        found = []
        low = None
        for m, width, mask, shift, suffix, prefix, first, item in self.groups:
            a, b = rows[:-1] + m - 1, rows[1:]
            lanes = np.maximum(0, -(-(b - a) // LANE))
            at = np.repeat(a, lanes) + LANE * c.ranges(np.zeros(len(lanes), np.int64), lanes)
            end = np.minimum(at + LANE, np.repeat(b, lanes))
            hits = []
            while len(at):
                s = shift[(_pair(h, at, width) & mask).astype(np.int64)]
                hits.append(at[s == 0])
                at = at + np.maximum(s, 1)
                go = at < end
                at, end = at[go], end[go]
            hits = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            key = _pair(h, hits, width)
            lo, hi = np.searchsorted(suffix, key), np.searchsorted(suffix, key, side="right")
            hits, lo, n = hits[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            cut = 0
            while cut < len(hits):
                to = cut + max(1, int(np.searchsorted(np.cumsum(n[cut:]), STEP)))
                at, p = np.repeat(hits[cut:to], n[cut:to]), c.ranges(lo[cut:to], n[cut:to])
                same = _pair(h, at - m + width, width) == prefix[p]
                for e, q in zip(at[same].tolist(), p[same].tolist(), strict=True):
                    low = c.LOWER[data].tobytes() if low is None else low
                    s, w = e - m + 1, int(first[q])
                    if all(low[starts[s + k] : ends[s + k]] == self.text[self.starts[w + k] : self.ends[w + k]] for k in range(m)):
                        found.append((s, e + 1, int(item[q])))
                cut = to
        return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int):
    """Tables of the items in blocks of bounded size, streamed from the cluster."""
    ids, texts, size = [], [], 0
    for row in c.id_and_text(benchmark, item_id, text).toLocalIterator():
        t = (row["_text"] or "").encode("utf-8")
        if ids and size + len(t) > block_bytes:
            yield Patterns(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(None if row["_id"] is None else str(row["_id"]))
        texts.append(t)
        size += len(t)
    if ids:
        yield Patterns(ids, texts, window)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, spans (disjoint word ranges inside occurrences), items (ids as strings, sorted)."""
    spark = docs.sparkSession
    rows = c.id_and_text(docs, doc_id, text).withColumns({"_n": F.lit(0).cast("long"), "_spans": F.array().cast(SPANS), "_items": F.array().cast("array<string>")})
    passes, held = 0, []
    for block in benchmark_blocks(benchmark, item_id, item_text, window, block_bytes):
        if block:
            if len(held) == CHAIN:
                rows = c.materialize(rows)
                for old in held:
                    old.destroy()
                held = []
            held.append(spark.sparkContext.broadcast(block))
            rows, passes = _scan(rows, held[-1]), passes + 1
    if not passes:
        rows = _scan(rows, spark.sparkContext.broadcast(Patterns([], [], window)))
    return rows.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def _scan(rows: DataFrame, shared) -> DataFrame:
    schema = rows.schema
    last = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        patterns, hasher = shared.value, _hasher()
        for batch, data, offs in c.text_slices(batches):
            starts, ends, at = c.words(data, offs, c.ALNUM_WORDS)
            spans, items = batch.column("_spans"), batch.column("_items")
            found = patterns.search(data, starts, ends, at, hasher(data, starts)) if patterns else []
            if found:
                s, i = spans.to_pylist(), items.to_pylist()
                by = defaultdict(list)
                for row, hit in zip(np.searchsorted(at, [x[0] for x in found], side="right") - 1, found, strict=True):
                    by[int(row)].append(hit)
                for row, hits in by.items():
                    own = [(x["start"], x["end"]) for x in s[row]] + [(a - int(at[row]), b - int(at[row])) for a, b, _ in hits]
                    s[row] = [{"start": a, "end": b} for a, b in _merged(own)]
                    i[row] = sorted({*i[row], *(patterns.ids[x] for _, _, x in hits if patterns.ids[x] is not None)})
                spans, items = pa.array(s, last), pa.array(i, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_text"), pa.array(np.diff(at)), spans, items], names=schema.names)

    return rows.mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    name = how.get("doc_id", "doc_id")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return benchmark_spans(docs, benchmark, **how).select(
        name, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without any occurrence, with all their columns."""
    spans = benchmark_spans(c.keyed(docs, doc_id, text), benchmark, doc_id="_key", text="_text", **how)
    hit = c.materialize(spans.filter(F.size("spans") > 0).select("_key.*").distinct())
    return c.pick(docs, hit, "left_anti", doc_id, text)
