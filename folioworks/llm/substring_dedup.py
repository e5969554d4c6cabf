"""Substring dedup by recompression: words covered by windows that also start earlier.

Naming. Words get 64-bit names. In each round, the names of a text are parted into left
and right ones by a hash bit; a left name followed by a right one becomes the name of the
pair, and a run of equal names left over becomes the name of the run. A name is a hash of
what it stands for, so equal passages get equal inner names in all tasks without a
shuffle. For each symbol, the words that its making looked at (its context) are known: a
symbol whose context lies inside a window is there in every copy of that window.

Rounds of Spark jobs:
1. each window chooses the least symbol with its context inside (or itself, if there is
   none), and each text yields its chosen symbols: about one for ten words;
2. symbols are counted over the corpus; windows whose symbol occurs once are no repeats;
3. the other windows are named by 96-bit hashes of all their words, which verifies the
   repeats, and the earliest place of each is found and told to its document; a document
   removes those of its windows that are not the first of their kind.
Texts that equal a whole earlier text are settled by their top name before round 2.

Scale: shuffles carry symbols (of a tenth of the words), names of windows that may repeat,
and texts that hold such. A hot symbol or window is counted with partial aggregates and
joined by equality, which adaptive execution splits. Nothing is collected.

Defined results: null and empty texts have no words; a null id counts as the smallest;
rows with the same id and text are the same document and get the same result; a text of
fewer words than a window keeps all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

WINDOW = 20
ROUNDS = 3
#: Documents that may repeat are kept apart before their texts are shuffled while their ids are at most so many.
BROADCAST_IDS = 1_000_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_U = np.uint64


def symbols(h: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols of all rows (given as word hashes and first words), and their contexts' first and end words."""
    n = len(h)
    name, size = h, np.diff(rows)
    row = np.repeat(np.arange(len(size)), size)
    lo, hi = np.arange(n), np.arange(1, n + 1)
    for k in range(rounds):
        if not len(name):
            break
        left = (c.mix(name ^ _U(0xA5A5_0000_0000 + k)) >> _U(63)) == 0
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (row[:-1] == row[1:])
        # units: pairs and single symbols
        keep = np.ones(len(name), bool)
        keep[1:] = ~pair[:-1]
        at, paired = np.flatnonzero(keep), pair[keep]
        other = np.minimum(at + 1, len(name) - 1)
        u_name = np.where(paired, c.mix(name[at] * _U(0x9E3779B97F4A7C15) + c.mix(name[other] + _U(k + 1))), name[at])
        u_lo, u_hi, u_row = lo[at], np.where(paired, hi[other], hi[at]), row[at]
        # a single symbol has looked at the symbols beside its stretch of equal ones, and beyond the row's edge where there is none
        first = np.ones(len(name), bool)
        first[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(first)
        end = np.concatenate([begin[1:], [len(name)]])
        alone_before, alone_after = np.ones(len(begin), bool), np.ones(len(begin), bool)
        alone_before[1:] = row[begin[1:]] != row[begin[1:] - 1]
        alone_after[:-1] = alone_before[1:]
        before = np.where(alone_before, rows[row[begin]] - 1, lo[begin - 1])
        after = np.where(alone_after, rows[row[begin] + 1] + 1, hi[np.minimum(end, len(name) - 1)])
        stretch = (np.cumsum(first) - 1)[at]
        s_lo, s_hi = np.where(paired, u_lo, before[stretch]), np.where(paired, u_hi, after[stretch])
        # runs of equal single symbols
        same = np.zeros(len(at), bool)
        same[1:] = (u_name[1:] == u_name[:-1]) & ~paired[1:] & ~paired[:-1] & (u_row[1:] == u_row[:-1])
        head = np.flatnonzero(~same)
        length = np.diff(np.concatenate([head, [len(at)]]))
        tail = head + length - 1
        name = np.where(length > 1, c.mix(u_name[head] + c.mix(length.astype(np.uint64) + _U(0x51ED))), u_name[head])
        lo, hi, row = s_lo[head], s_hi[tail], u_row[head]
    return name, lo, hi


def named_contexts(h: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The symbols under names that also tell all words of their contexts, so that common short symbols differ by context."""
    n, base = len(h), 0xD6E8FEB86659FD93
    powers, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:n])])
    lo, hi = np.clip(lo, 0, n), np.clip(hi, 0, n)
    return c.mix((sums[hi] - sums[lo]) * back[lo] ^ name)


def window_starts(rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and their rows."""
    n = np.maximum(0, np.diff(rows) - window + 1)
    return c.ranges(rows[:-1], n), np.repeat(np.arange(len(n)), n)


def choose(h: np.ndarray, rows: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """For each window its chosen key, whether that is the window itself, and (symbols, first, end) chosen from."""
    name, lo, hi = symbols(h, rows)
    name = named_contexts(h, name, lo, hi)
    first, end = np.searchsorted(lo, at), np.searchsorted(hi, at + window, side="right")
    own = first >= end
    levels = [name]
    while 1 << len(levels) <= window:
        half = 1 << (len(levels) - 1)
        last = levels[-1]
        levels.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
    key = np.zeros(len(at), np.uint64)
    deep = np.zeros(len(at), np.int64)
    wide = np.maximum(end - first, 1)
    for k in range(1, len(levels)):
        deep[wide >= 1 << k] = k
    for k, level in enumerate(levels):
        pick = np.flatnonzero((deep == k) & ~own)
        if len(pick):
            key[pick] = np.minimum(level[first[pick]], level[end[pick] - (1 << k)])
    if own.any():
        key[own] = c.windows(h, window, 0x2545F4914F6CDD1D)[at[own]]
    return key, own, (name, first, end)


def chosen_symbols(h: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (once, or twice if they occur more than once in the row) and how many each row has."""
    at, row = window_starts(rows, window)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(rows) - 1, np.int64)
    key, own, (name, first, end) = choose(h, rows, at, window)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | own[1:]
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:] - 1, [len(at) - 1]])
    lo, n = first[head], np.where(own[head], 0, end[tail] - first[head])
    many = np.ones(len(head), np.int64)
    some = np.flatnonzero(n > 0)
    if len(some):
        hits = name[c.ranges(lo[some], n[some])] == np.repeat(key[head[some]], n[some])
        many[some] = np.minimum(2, np.add.reduceat(hits.astype(np.int64), np.cumsum(n[some]) - n[some]))
    return np.repeat(key[head], many), np.bincount(np.repeat(row[head], many), minlength=len(rows) - 1)


def _hashers() -> tuple[c.WordHash, c.WordHash]:
    return c.WordHash(21, c.BLANK_WORDS), c.WordHash(22, c.BLANK_WORDS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return c.id_and_text(docs, doc_id, text).withColumn("_fp", F.hash("_text"))


def _same(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_fp"] == b["_fp"])


def _kept_sha(raw: memoryview, starts: list[int], ends: list[int]) -> str:
    return hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(starts, ends, strict=True)])).hexdigest()


def signatures(docs: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """_id, _fp, n_words, all_sha (of all words), r1 and r2 (the text's top name), keys (chosen symbols)."""
    base = _documents(docs, doc_id, text)
    long = T.LongType()
    schema = T.StructType([base.schema["_id"], T.StructField("_fp", T.IntegerType()), T.StructField("n_words", long), T.StructField("all_sha", T.StringType()), T.StructField("r1", long), T.StructField("r2", long), T.StructField("keys", T.ArrayType(long))])

    def run(batches):
        one, two = _hashers()
        for batch, data, offs in c.text_slices(batches):
            starts, ends, rows = c.words(data, offs, c.BLANK_WORDS)
            a, b = one(data, starts), two(data, starts)
            keys, n = chosen_symbols(a, rows, window)
            raw, s, e = memoryview(data.tobytes()), starts.tolist(), ends.tolist()
            sha = [_kept_sha(raw, s[x:y], e[x:y]) for x, y in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
            # the top name: a fold over the text's word names and their places
            place = np.arange(len(a)) - np.repeat(rows[:-1], np.diff(rows))
            tops = []
            for h in (a, b):
                total = np.concatenate([[_U(0)], np.cumsum(c.mix(h + place.astype(np.uint64) * _U(0xD1B54A32D192ED03)))])
                tops.append(c.mix(total[rows[1:]] - total[rows[:-1]] + np.diff(rows).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_fp"), pa.array(np.diff(rows)), pa.array(sha, pa.string()), _signed(tops[0]), _signed(tops[1]), c.list_array(_signed(keys), n)], names=schema.names)

    return base.mapInArrow(run, schema)


def _may_repeat(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents named in ids; beyond a size check by a shuffled join instead of a broadcast one."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, _same(docs, ids), "left_semi")


def _candidates(batch: pa.RecordBatch, h: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (first word, row) whose chosen key is among their own row's keys."""
    at, row = window_starts(rows, window)
    if not len(at):
        return at, row
    key, _, _ = choose(h, rows, at, window)
    lists = batch.column("keys")
    own = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    names, code = np.unique(np.concatenate([own, key]), return_inverse=True)
    whose = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    pick = np.isin(row * len(names) + code[len(own) :], whose * len(names) + code[: len(own)])
    return at[pick], row[pick]


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """_id, place, h1, h2 of the windows of _text whose key is in keys. place: start and _fp in one number, ordered by start."""
    long = T.LongType()
    schema = T.StructType([texts.schema["_id"], T.StructField("place", long), T.StructField("h1", long), T.StructField("h2", T.IntegerType())])

    def run(batches):
        one, two = _hashers()
        for batch, data, offs in c.text_slices(batches):
            starts, _, rows = c.words(data, offs, c.BLANK_WORDS)
            a, b = one(data, starts), two(data, starts)
            at, row = _candidates(batch, a, rows, window)
            if len(at):
                place = (at - rows[row] << 32) | (batch.column("_fp").to_numpy(zero_copy_only=False).astype(np.int64)[row] & 0xFFFFFFFF)
                second = (c.windows(b, window, 0x9FB21C651E98DF25)[at] >> _U(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(row)), pa.array(place), _signed(c.windows(a, window)[at]), pa.array(second)], names=schema.names)

    return texts.select("_id", "_fp", "_text", "keys").mapInArrow(run, schema)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Signatures with `copy` (the whole text has come before), and per document with shared symbols: keys, firsts.

    firsts are the starts of the document's windows that are the first of their kind; its
    other windows with a key in keys come earlier elsewhere.
    """
    sig = c.materialize(signatures(docs, doc_id, text, window))
    long = sig.filter(F.col("n_words") >= window)
    firsts = long.groupBy("r1", "r2").agg(F.min(F.struct("_id")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    state = sig.join(firsts, ["r1", "r2"], "left").withColumn("copy", (F.col("n_words") >= window) & F.col("first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("first._id")))
    found = state.filter(~F.col("copy")).select("_id", "_fp", F.explode("keys").alias("key"))
    shared = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keys = c.materialize(found.join(shared, "key").groupBy("_id", "_fp").agg(F.collect_set("key").alias("keys")))
    first = _windows(_with_keys(docs, keys, doc_id, text), window).groupBy("h1", "h2").agg(F.min(F.struct("_id", "place")).alias("x"))
    fp = F.shiftright(F.shiftleft("x.place", 32), 32).cast("int")
    first = first.select("x._id", fp.alias("_fp"), F.shiftright("x.place", 32).cast("int").alias("pos"))
    own = c.materialize(first.groupBy("_id", "_fp").agg(F.collect_list("pos").alias("firsts")))
    kept = keys.join(own, _same(keys, own), "left").select(keys["_id"], keys["_fp"], "keys", "firsts")
    return state.drop("keys", "r1", "r2", "first"), kept


def _with_keys(docs: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    texts = _may_repeat(_documents(docs, doc_id, text), keys.select("_id", "_fp"))
    return texts.join(keys, _same(texts, keys)).select(texts["_id"], texts["_fp"], "_text", *[x for x in keys.columns if x not in ("_id", "_fp")])


def merge_starts(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words are covered by windows that start at starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + window, 1)
    return np.cumsum(edge)[:n] > 0


def _touched(docs: DataFrame, kept: DataFrame, doc_id: str, text: str, window: int, with_text: bool) -> DataFrame:
    """_id, _fp, n_removed, kept_sha (or kept, the words left joined by one space) of texts with windows that come earlier elsewhere."""
    texts = _with_keys(docs, kept, doc_id, text)
    schema = T.StructType([texts.schema["_id"], T.StructField("_fp", T.IntegerType()), T.StructField("n_removed", T.LongType()), T.StructField("kept" if with_text else "kept_sha", T.StringType())])

    def run(batches):
        one, _ = _hashers()
        for batch, data, offs in c.text_slices(batches):
            starts, ends, rows = c.words(data, offs, c.BLANK_WORDS)
            at, row = _candidates(batch, one(data, starts), rows, window)
            raw, s, e = memoryview(data.tobytes()), starts.tolist(), ends.tolist()
            bounds = np.searchsorted(row, np.arange(len(rows)))
            gone, out, which = [], [], []
            for i, first in enumerate(batch.column("firsts")):
                a, b = int(rows[i]), int(rows[i + 1])
                later = at[bounds[i] : bounds[i + 1]] - a
                if first.is_valid:
                    later = later[~np.isin(later, first.values.to_numpy(zero_copy_only=False))]
                if not len(later):
                    continue
                left = (np.flatnonzero(~merge_starts(later, b - a, window)) + a).tolist()
                which.append(i)
                gone.append(b - a - len(left))
                words = b" ".join([raw[s[k] : e[k]] for k in left])
                out.append(words.decode("utf-8", "surrogatepass") if with_text else hashlib.sha256(words).hexdigest())
            if which:
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(take), batch.column("_fp").take(take), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=schema.names)

    return texts.mapInArrow(run, schema).dropDuplicates(["_id", "_fp"])


def dedup_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    sig, kept = repeats(docs, doc_id, text, window)
    touched = _touched(docs, kept, doc_id, text, window, False)
    empty = hashlib.sha256(b"").hexdigest()
    return sig.join(touched, _same(sig, touched), "left").select(
        sig["_id"].alias(doc_id), "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha", "all_sha")).alias("kept_sha256")
    )


def dedup_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with all columns; texts that lost words have the kept ones joined by one space, others are unchanged."""
    sig, kept = repeats(docs, doc_id, text, window)
    touched = _touched(docs, kept, doc_id, text, window, True).select("_id", "_fp", "kept")
    copies = sig.filter("copy").select("_id", "_fp", F.lit("").alias("kept")).distinct()
    changes = c.materialize(touched.unionByName(copies))
    same = c.pick(docs, changes, "left_anti", doc_id, text)
    rest = [x for x in docs.columns if x != text]
    changed = c.pick(docs, changes, "left_semi", doc_id, text).select(F.struct(*[F.col(f"`{x}`") for x in rest]).alias("_row"), F.col(doc_id).alias("_id"), F.hash(F.col(text).cast("string")).alias("_fp"))
    changed = changed.join(changes, _same(changed, changes))
    return same.unionByName(changed.select(*[(F.col("kept") if x == text else F.col("_row").getField(x)).alias(x) for x in docs.columns]))
