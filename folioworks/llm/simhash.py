"""SimHash fingerprints and the components of those that differ in few bits, by multi-index hashing.

Words are maximal runs without ASCII white space, A-Z lower-cased; shingles are k words
joined by a space, repeats included (fewer words: the whole sequence). A fingerprint's bit
is 1 if it is set in over half the shingles' XXH64 values (seed 42); no words: zero.

Two fingerprints that differ in at most 4 of 64 bits differ in at most 2 bits of their upper
or of their lower half. So each of them throws the small Hamming ball of radius 1 around
both halves (66 keys) into the tables, and any such two meet at a key between them. What meets
is verified on all 64 bits:

- a key with up to FEW fingerprints compares them in one row and hands on one link for
  each, to the smallest of those that chains of near ones inside the key reach;
- a crowded key compares nothing. Its members continue the ball in the other half, so that together
  they hold all points that lie within 2 bits of the fingerprint and have this key. Two that
  share a point differ in at most 4 bits, and two that differ in at most 4 bits share one, so
  linking each point's members with its smallest one links what should be linked and nothing
  else. A point has at most 2,081 fingerprints around it, a member at most 529 points of a
  key: work follows members, whatever the size of the crowd.

Scale: texts are read once and never shuffled. Equal fingerprints are one row before anything
is joined, so a text with a third of all copies costs one row. Keys are counted by partial
aggregates. Components come from rounds of joins over stored links; nothing is collected.

Defined results: null, empty and blank texts have the fingerprint zero, which is linked like any
other; rows without an id take part and have the component of their text (null if no row of
it has an id); repeated rows all stay; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from .near_dedup import components

SHINGLE, SEED, BITS = 4, 42, 4
#: Keys with up to so many fingerprints compare them directly: fewer comparisons a member than it has points.
FEW = 256
#: Shingles that one step of the hashing holds.
BLOCK = 1 << 17

_U = np.uint64
_ONES = _U(0x0101010101010101)
_LOW = 0xFFFFFFFF
#: Marks keys and points of the lower half.
_LOWER_KEY = 1 << 32


def _votes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each row's hashes (count of them, none empty) have each bit: rows x 64."""
    parts = (counts + 254) // 255
    first = np.cumsum(counts) - counts
    starts = np.repeat(first, parts) + 255 * c.ranges(np.zeros(len(parts), np.int64), parts)
    rows = np.cumsum(parts) - parts
    out = np.empty((len(counts), 64), np.int64)
    for bit in range(8):  # eight counters of a byte in a number: bits bit, bit + 8, ...
        sums = np.add.reduceat((h >> _U(bit)) & _ONES, starts)
        out[:, bit::8] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), rows, axis=0)
    return out


def fingerprint_rows(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row of a text buffer."""
    data = c.LOWER[data]
    starts, ends, rows = c.words(data, offs, c.BLANK_WORDS)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(starts):
        return out
    # words, each followed by one space unless its row ends there
    keep = c.BLANK_WORDS[data]
    after = ends[ends < len(data)]
    after = after[~keep[after]]
    keep[after] = True
    data[after] = 0x20
    place = np.cumsum(keep) - 1
    text, first, last = data[keep].tobytes(), place[starts], place[ends - 1] + 1
    n = np.diff(rows)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = c.ranges(rows[:-1], counts)
    to = at + np.repeat(np.minimum(n, k), counts) - 1
    votes = np.zeros((len(n), 64), np.int64)
    row = np.repeat(np.arange(len(n)), counts)
    for i in range(0, len(at), BLOCK):
        pieces = map(text.__getitem__, map(slice, first[at[i : i + BLOCK]].tolist(), last[to[i : i + BLOCK]].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(at[i : i + BLOCK]))
        who, some = np.unique(row[i : i + BLOCK], return_counts=True)
        votes[who] += _votes(h, some)
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """_id, fp (the fingerprint's 64 bits as a long) of each document."""
    base = c.id_and_text(docs, doc_id, text)
    schema = T.StructType([base.schema["_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch, data, offs in c.text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fingerprint_rows(data, offs, k).view(np.int64))], names=schema.names)

    return base.mapInArrow(run, schema)


def _masks(most: int) -> list[int]:
    """Numbers of 32 bits with at most so many ones (up to 2)."""
    return [0] + [1 << i for i in range(32)] + ([1 << i | 1 << j for i in range(32) for j in range(i)] if most == 2 else [])


def _literal(numbers: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in numbers])


def _near_in_lists(lists: DataFrame) -> DataFrame:
    """a, b: of each list of fingerprints (s), what chains of near ones link with a smaller one, and the smallest such."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for one in batch.column("s"):
                x = np.sort(one.values.to_numpy(zero_copy_only=False))
                bits = x.view(np.uint64)
                near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= BITS
                root = np.argmax(near, axis=1)  # the first near one, then the first that any near one knows
                while True:
                    least = np.where(near, root[None, :], len(x)).min(axis=1)
                    least = least[least]
                    if (least == root).all():
                        break
                    root = least
                own = np.flatnonzero(root != np.arange(len(x)))
                a.append(x[root[own]])
                b.append(x[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z) if z else np.zeros(0, np.int64)) for z in (a, b)], names=["a", "b"])

    return lists.select("s").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, few: int = FEW) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all pairs within 4 bits."""
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_LOW))
    ball = _literal(_masks(1))
    keys = F.concat(F.transform(ball, lambda m: upper.bitwiseXOR(m)), F.transform(ball, lambda m: lower.bitwiseXOR(m).bitwiseOR(F.lit(_LOWER_KEY))))
    entries = distinct.select(F.explode(keys).alias("key"), "fp")
    stats = c.materialize(entries.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    two = stats.filter("n = 2").select("a", "b").filter(near)

    def of(keys: DataFrame) -> DataFrame:
        keys = keys.select("key")
        return entries.join(F.broadcast(keys) if c.is_small(keys) else keys, "key")

    some = _near_in_lists(of(stats.filter((F.col("n") > 2) & (F.col("n") <= few))).groupBy("key").agg(F.collect_list("fp").alias("s")))
    crowd = of(stats.filter(F.col("n") > few))
    is_low = F.col("key") >= _LOWER_KEY
    own, other = F.when(is_low, lower.bitwiseOR(F.lit(_LOWER_KEY))).otherwise(upper), F.when(is_low, upper).otherwise(lower)
    masks = F.when(own == F.col("key"), _literal(_masks(2))).otherwise(ball)
    points = crowd.select("key", other.alias("other"), "fp", F.explode(masks).alias("mask")).select("key", F.col("other").bitwiseXOR(F.col("mask")).alias("point"), "fp")
    least = F.min("fp").over(Window.partitionBy("key", "point"))
    many = points.select(least.alias("a"), F.col("fp").alias("b")).filter("a != b")
    return two.unionByName(some).unionByName(many).distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that chains of links reach) of each document."""
    each = c.materialize(fingerprints(docs, doc_id, text, k))
    distinct = c.materialize(each.groupBy("fp").agg(F.min("_id").alias("least")))
    group = components(links(distinct.select("fp")))
    named = distinct.join(group, distinct["fp"] == group["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = c.materialize(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = named.select("fp", "root").join(linked, "root").select("fp", "component_id")
    return each.join(of, "fp").select(F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
