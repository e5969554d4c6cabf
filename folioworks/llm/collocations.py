"""Phrase collocations: each language's best phrases of two and three words, by best-first branch and bound.

A-Z is lower-cased; texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at
blanks. A phrase scores by its weakest cut, floor(10**6 * a * a / (l * r)), where a, l and r count
the phrase, the words before and the words after the cut. A phrase inside a longer
candidate that has at least half its count is dropped.

Phrases grow word by word, and only from prefixes that still matter:

1. One pass counts words. Only words that occur often enough can be in a candidate.
2. One pass counts pairs of such words, which gives exact scores of all phrases of two words.
3. A prefix of two words is a node of the frontier. As a longer phrase has a count of at most its
   prefix's, and the rest after the first word one of at least the phrase's, no longer phrase
   scores above 10**6 * f(prefix) / f(first word); the same holds from the other end. A round
   takes, for each language, the nodes with a bound of at least a threshold, and one pass counts
   their longer phrases, together with those that could drop a phrase of two words above the threshold.
   Then every phrase with a score at or above the threshold is known, and whether it survives. A language
   is settled once so many survive; the others go on with a lower threshold, at last with none.

So ties at the last place are whole: all phrases of that score are above the threshold.

Scale: each pass is a map over texts that hands on counts of word numbers, combined in the task and
before the shuffle; texts are never shuffled. What a pass needs to know travels as a bit table
of fixed size (FILTER_BITS): a wrong bit only counts a phrase that a later join drops. Thresholds
come from a histogram with some hundred steps a language. Words are told apart by 64-bit
hashes; the pass that counts them keeps the words too and, should two share a hash, starts
again with another one. Arithmetic is in decimals of 38 digits.

Defined results: a null language is `und`, together with rows that say `und`; null, empty and blank texts
have no words; ids are not looked at, so repeated rows all count; languages without candidates
and an empty table have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

LEAST, BEST = 10, 2000
#: A longer phrase drops one inside it when 100 * its count is at least so much times the other's.
DROP = 50
UNKNOWN = "und"
#: Bits of the table that tells a pass which words or pairs to count (16 MB), and how many a key sets.
FILTER_BITS, FILTER_KEYS = 1 << 27, 2
#: Bytes of text and words that one counting step takes.
STEP_BYTES, STEP_WORDS = 1 << 22, 1 << 20

_U = np.uint64
_INSIDE = ~c.byte_set((0x20, 0x20), (0x09, 0x0D), *[(ord(x), ord(x)) for x in ".,;:!?"])
_ENDS = c.byte_set((0x0A, 0x0D), *[(ord(x), ord(x)) for x in ".,;:!?"])
_PAGE = 4096  # bytes of one of Spark's bitmaps
#: What a pair may be in a filter: frequent; a prefix or suffix to grow; a phrase that may be dropped.
FREQUENT, PREFIX, SUFFIX, KNOWN = 1, 2, 3, 4


def _bits(kind: int, *h: np.ndarray) -> list[np.ndarray]:
    """Places of keys (a word, or two) in the bit table."""
    x = h[0]
    for y in h[1:]:
        x = c.mix(x * _U(0x9E3779B97F4A7C15) + _U(1)) + y
    x = c.mix(x ^ _U(kind * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    return [(x >> _U(32 * j)) & _U(FILTER_BITS - 1) for j in range(FILTER_KEYS)]


def _has(table: np.ndarray, kind: int, *h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h[0]), bool)
    for at in _bits(kind, *h):
        out &= (table[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _filter(rows: DataFrame, keys: list[str]) -> np.ndarray:
    """The bit table of rows (keys..., kinds array<int>), put together by Spark in pages of 4 KB."""

    def run(batches):
        for batch in batches:
            kinds = batch.column("kinds")
            n = np.diff(np.asarray(kinds.offsets))
            kind = np.asarray(kinds.flatten())
            h = [np.repeat(np.asarray(batch.column(k)).view(np.uint64), n) for k in keys]
            for one in np.unique(kind):
                at = np.unique(np.concatenate(_bits(int(one), *[x[kind == one] for x in h])).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(at // (8 * _PAGE)), pa.array(at % (8 * _PAGE))], names=["page", "bit"])

    pages = rows.select(*keys, "kinds").mapInArrow(run, "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in pages.toLocalIterator():
        table[row["page"] * _PAGE : (row["page"] + 1) * _PAGE] = np.frombuffer(row["bits"], np.uint8)
    return table


def _steps(batches: Iterator[pa.RecordBatch], seed: int, overlap: int):
    """(bytes, starts, ends, word hashes with the language, words followed by one of the same piece) of steps of bounded size.

    Long texts are cut after whole words; a step repeats the last `overlap` words of the one before.
    """
    hasher = c.WordHash(seed, _INSIDE, fold=True)
    for batch, data, offs in c.text_slices(batches, STEP_BYTES):
        starts, ends, rows = c.words(data, offs, _INSIDE)
        if not len(starts):
            continue
        lang = batch.column("_lang").dictionary_encode()
        names = np.array([xxhash.xxh64_intdigest(x.as_py() or "", seed) for x in lang.dictionary], np.uint64)
        own = np.repeat(names[np.asarray(lang.indices)], np.diff(rows))
        h = c.mix(hasher(data, starts) ^ own)
        breaks = np.flatnonzero(_ENDS[data])
        joined = np.zeros(len(starts), bool)
        joined[:-1] = np.searchsorted(breaks, starts[1:]) == np.searchsorted(breaks, ends[:-1])
        joined[rows[1:][rows[1:] > 0] - 1] = False
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        for a in range(0, len(starts), STEP_WORDS):
            lo = max(0, a - overlap)
            yield batch, data, starts[lo : a + STEP_WORDS], ends[lo : a + STEP_WORDS], h[lo : a + STEP_WORDS], joined[lo : a + STEP_WORDS], row[lo : a + STEP_WORDS], a - lo


def _base(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("_lang"), F.col(text).cast("string").alias("_text"))


def _words(base: DataFrame, seed: int) -> DataFrame:
    """lang, h, word, f of all words; other: a word of the same hash, if there is one."""

    def run(batches):
        for batch, data, starts, ends, h, _, row, _ in _steps(batches, seed, 0):
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            size = ends[first] - starts[first]
            text = c.LOWER[data][c.ranges(starts[first], size)]
            words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([batch.column("_lang").take(pa.array(row[first])), pa.array(h[first].view(np.int64)), words, pa.array(n)], names=["lang", "h", "word", "n"])

    each = base.mapInArrow(run, "lang string, h long, word string, n long")
    name = F.struct("lang", "word")
    got = each.groupBy("h").agg(F.min(name).alias("w"), F.max(name).alias("x"), F.sum("n").alias("f"))
    return got.select("w.lang", "h", "w.word", "f", (F.col("w") != F.col("x")).alias("clash"))


def _grams(base: DataFrame, seed: int, size: int, table: np.ndarray, least: int) -> DataFrame:
    """h1, h2(, h3), a: counts of the pairs or triples of neighbours that pass the bit table and occur at least so often."""
    keys = [f"h{j + 1}" for j in range(size)]
    shared = base.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        known = shared.value
        for _, _, _, _, h, joined, _, skip in _steps(batches, seed, size - 1):
            # a phrase is counted in the step that its last word lies in
            at = np.flatnonzero(np.logical_and.reduce([joined[j : len(h) - size + 1 + j] for j in range(size - 1)])) if len(h) >= size else np.zeros(0, np.int64)
            at = at[at >= skip - size + 1] if skip else at
            part = [h[at + j] for j in range(size)]
            if size == 2:
                ok = _has(known, FREQUENT, part[0]) & _has(known, FREQUENT, part[1])
            else:
                a, b = part[:2], part[1:]
                ok = _has(known, FREQUENT, *a) & _has(known, FREQUENT, *b)
                at, a, b = at[ok], [x[ok] for x in a], [x[ok] for x in b]
                ok = (_has(known, PREFIX, *a) & _has(known, SUFFIX, *b)) | _has(known, KNOWN, *a) | _has(known, KNOWN, *b)
            at = at[ok]
            number, code = np.unique(h, return_inverse=True)  # below 2**21, so three fit a number
            code = code.reshape(-1)
            packed = code[at]
            for j in range(1, size):
                packed = packed << 21 | code[at + j]
            packed, n = np.unique(packed, return_counts=True)
            cols = [pa.array(number[packed >> 21 * (size - 1 - j) & (1 << 21) - 1].view(np.int64)) for j in range(size)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n)], names=[*keys, "n"])

    each = base.mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "n"]))
    return each.groupBy(*keys).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def _big(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def _score(a: str, left: str, right: str) -> Column:
    return F.expr(f"(cast(1000000 as decimal(38,0)) * cast({a} as decimal(38,0)) * cast({a} as decimal(38,0))) div (cast({left} as decimal(38,0)) * cast({right} as decimal(38,0)))")


def _threshold(scored: DataFrame, rank: int) -> DataFrame:
    """lang, t: a score that at least `rank` phrases of the language reach, or 0 where there are not so many."""
    steps = scored.withColumn("s", F.greatest(F.length(F.bin("score")) - 6, F.lit(0))).select("lang", F.expr("shiftleft(shiftright(score, s), s)").alias("t"))
    counts = steps.groupBy("lang", "t").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("t").desc()))
    return counts.withColumn("above", above).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= rank, F.col("t"))), F.lit(0)).alias("t"))


def _survivors(base: DataFrame, seed: int, pairs: DataFrame, limits: DataFrame, least: int, drop: int) -> DataFrame:
    """lang, t, h1, h2, h3, a, l, r, score: all phrases with a score of at least their language's threshold that survive."""
    at = pairs.join(limits, "lang")
    wide = F.lit(1000000).cast("decimal(38,0)") * _big("a")
    kinds = F.array_compact(F.array(F.lit(FREQUENT), F.when(wide >= _big("t") * _big("f1"), F.lit(PREFIX)), F.when(wide >= _big("t") * _big("f2"), F.lit(SUFFIX)), F.when(F.col("score") >= F.col("t"), F.lit(KNOWN))))
    table = _filter(at.withColumn("kinds", kinds), ["h1", "h2"])
    triples = c.materialize(_grams(base, seed, 3, table, least))
    first = at.select("lang", "t", "h1", "h2", F.col("a").alias("a12"), "f1")
    second = at.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("a23"), F.col("f2").alias("f3"))
    cut1, cut2 = _score("a", "f1", "a23"), _score("a", "a12", "f3")
    three = triples.join(first, ["h1", "h2"]).join(second, ["h2", "h3"]).withColumn("s1", cut1).withColumn("s2", cut2)
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", "t", "h1", "h2", "h3", "a", F.when(early, F.col("f1")).otherwise(F.col("a12")).alias("l"), F.when(early, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    around = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    two = at.filter("score >= t").join(around, ["h1", "h2"], "left").filter(F.col("longer").isNull() | (100 * _big("longer") < drop * _big("a")))
    two = two.select("lang", "t", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    return two.unionByName(three.filter("score >= t"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", best: int = BEST, least: int = LEAST, drop: int = DROP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n (words of the language), score of each language's first `best` phrases."""
    base = _base(docs, text, lang)
    for seed in range(41, 49):
        words = c.materialize(_words(base, seed))
        if words.filter("clash").isEmpty():
            break
    else:
        raise ValueError("words share hashes under every seed")
    total = c.materialize(words.groupBy("lang").agg(F.sum("f").alias("n")))
    often = words.filter(F.col("f") >= least).select("lang", "h", "word", "f")
    table = _filter(often.select("h", F.array(F.lit(FREQUENT)).alias("kinds")), ["h"])
    counted = c.materialize(_grams(base, seed, 2, table, least))
    one = often.select(F.col("h").alias("h1"), "lang", F.col("f").alias("f1"))
    other = often.select(F.col("h").alias("h2"), F.col("f").alias("f2"))
    pairs = c.materialize(counted.join(one, "h1").join(other, "h2").withColumn("score", _score("a", "f1", "f2")).select("lang", "h1", "h2", "a", "f1", "f2", "score"))

    def named(rows: DataFrame) -> DataFrame:
        for j in (1, 2, 3):
            rows = rows.join(often.select(F.col("h").alias(f"h{j}"), F.col("word").alias(f"w{j}")), f"h{j}", "left" if j == 3 else "inner")
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
        ranked = rows.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).withColumn("rank", place.cast("long")).filter(F.col("rank") <= best)
        return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

    open_, rank, out = pairs.select("lang").distinct(), 2 * best, None
    while True:
        limits = c.materialize(_threshold(pairs.join(open_, "lang", "left_semi"), rank))
        some = base.join(F.broadcast(limits), base["_lang"] == limits["lang"], "left_semi") if c.is_small(limits) else base
        found = c.materialize(_survivors(some, seed, pairs, limits, least, drop))
        counts = found.groupBy("lang").agg(F.count("*").alias("found"))
        state = c.materialize(limits.join(counts, "lang", "left").select("lang", ((F.col("t") == 0) | (F.coalesce("found", F.lit(0)) >= best)).alias("settled")))
        settled = named(found.join(state.filter("settled"), "lang", "left_semi"))
        open_ = state.filter("not settled").select("lang")
        last = open_.isEmpty()
        settled = settled if last and out is None else c.materialize(settled)
        out = settled if out is None else out.unionByName(settled)
        if last:
            return out
        rank *= 4
