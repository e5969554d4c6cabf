"""Helpers shared by the operators: shared storage, Arrow text buffers, word hashes.

All text work happens inside Spark tasks on Arrow batches. A batch is cut into slices
of a few MB, so that a worker's memory follows one slice (or one text, if longer) and
not the batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on.
SLICE_BYTES = 1 << 20
#: Bytes that one hash step works on.
HASH_BLOCK = 1 << 18


#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's checkpoint folder. Only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioworks-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. Its shuffle files go with the write."""
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names, so that others can't clash."""
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def free(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def out_schema(df: DataFrame, id_col: str, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in fields])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str | int = "_text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) for each slice of a column of texts."""
    for batch in batches:
        data, offs = utf8(batch.column(column))
        for a, b in slices(offs, limit):
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words of [^\x20\x09-\x0D]+ : everything but ASCII white space.
BLANK_WORDS = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words of digits, ASCII letters and all bytes of non-ASCII characters.
ALNUM_WORDS = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's first word number (with the total last)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    first[edge] = w[edge]
    last[edge - 1] = w[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash:
    """Polynomial hashes of words modulo 2**64, mixed; the same word has the same hash everywhere."""

    def __init__(self, seed: int, inside: np.ndarray, fold: bool = False):
        r = np.random.default_rng(seed)
        t = r.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            t = t[LOWER]
        self.letters = np.where(inside, t, np.uint64(0))
        self.base = int(r.integers(1, 1 << 60)) * 8 + 5
        self.grow(HASH_BLOCK)

    def grow(self, n: int) -> None:
        inverse = pow(self.base, -1, 1 << 64)
        self.powers, self.back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (self.base, inverse))

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out, i, n = np.zeros(len(starts), np.uint64), 0, len(starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BLOCK, side="right")) - 1)
            j = n if j >= n - 1 else j
            lo, hi = starts[i], starts[j] if j < n else len(data)
            if hi - lo >= len(self.powers):
                self.grow(int(hi - lo))
            at = starts[i:j] - lo
            out[i:j] = np.add.reduceat(self.letters[data[lo:hi]] * self.powers[: hi - lo], at) * self.back[at]
            i = j
        return mix(out)


def windows(h: np.ndarray, k: int, key: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each k consecutive word hashes (over the whole array; the caller cuts at rows)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, m, n = np.zeros(len(h) - k + 1, np.uint64), 1, len(h) - k + 1
    for j in range(k):
        out += h[j : j + n] * np.uint64(m)
        m = m * key & (1 << 64) - 1
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... (count of them) of each pair, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


#: Rows and bytes of keys that are broadcast at most, to pick documents without a shuffle of their texts.
BROADCAST_KEYS, BROADCAST_BYTES = 500_000, 64 << 20


def is_small(rows: DataFrame, most: int = BROADCAST_KEYS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether rows may be broadcast: at most so many, and so many bytes as strings (ids may be strings of any length)."""
    few = rows.limit(most + 1)
    size = F.lit(0).cast("long")
    for name, kind in rows.dtypes:
        size = size + (F.lit(16) if kind in ("int", "bigint", "smallint", "tinyint", "double", "boolean") else F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) + 16)
    got = few.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return got["n"] <= most and got["bytes"] <= most_bytes


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs as (_key, _text), with a key of id and text hash: it tells rows of one id, or of none, apart."""
    return docs.select(F.struct(F.col(doc_id).alias("_id"), F.hash(F.col(text).cast("string")).alias("_fp")).alias("_key"), F.col(text).cast("string").alias("_text"))


def pick(docs: DataFrame, keys: DataFrame, how: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs with ("left_semi") or without ("left_anti") a key in keys (_id, _fp).

    The keys are broadcast up to a checked number; beyond it the join is a shuffled one.
    """
    other_id, other_fp = free(docs, "_other_id"), free(docs, "_other_fp")
    keys = keys.select(F.col("_id").alias(other_id), F.col("_fp").alias(other_fp))
    few = is_small(keys)
    same = F.col(doc_id).eqNullSafe(F.col(other_id)) & (F.hash(F.col(text).cast("string")) == F.col(other_fp))
    return docs.join(F.broadcast(keys) if few else keys, same, how)
