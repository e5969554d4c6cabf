"""Near-duplicate groups by DartMinHash signatures and banded joining.

Shingles are k consecutive words. Each element throws darts into its region of weight
times time: the weights up to 1, from 1 to 2, from 2 to 4 and so on are bands, each with
the darts of a Poisson process whose gaps and heights come from hashes of (element, band,
number); of the last band, darts above the element's weight fall away. So the work
follows the number of elements and darts, not the weights. Equal elements throw equal
darts in all tasks. Only darts before a time bound are thrown, about k ln k + 2k in all for a signature of k,
whatever the number of elements; each dart falls on a hashed coordinate, and a coordinate
keeps its earliest dart. Should one stay empty, the bound is doubled for that text.
Two texts agree in a coordinate with a probability of their (weighted) Jaccard similarity.

Signatures are joined by bands of rows. Texts with the same set of shingles are one node.
All members of a bucket are compared with a centre, a node with many copies that they share
buckets with, exactly, by their shingles. Two that both reach the threshold with the centre are of one
group already. One that does not can only reach it with a node that shares enough of the
elements by which both differ from the centre; such pairs meet by equality on these few
elements, the rarest first, and are compared exactly too. In a crowd, elements that most have
are turned round first (who lacks one has it, and the other way), which changes no distance.
Where an element then has many nodes on both sides they are not compared but become a crowd of
their own, of half the members at most, with what comes after that element; there it starts anew.
So a bucket loses no pair that could unite two groups, and a node is compared with at most FEW
others for an element of its difference, never with all of its bucket.

Scale: one row per (text, band) is shuffled; shingles travel only for nodes of buckets with
several nodes. Hot buckets are counted by partial aggregates and joined by equality.

Defined results: null or blank texts have no shingles and each is its own class; a text of
fewer words than k has one shingle, all its words; rows without an id have no class (null);
rows with the same id share the class of the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 5: two texts of similarity 0.8 share none of them once in 300,000 cases.
BANDS, ROWS = 32, 5
#: Partners that one element of a difference gives a node at most.
FEW = 32
#: Ids of texts to compare are broadcast up to this number.
BROADCAST_IDS = 1_000_000

_U = np.uint64
_LONGS = T.ArrayType(T.LongType())


def shingle_hashes(h: np.ndarray, rows: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, and how many each row has."""
    n = np.diff(rows)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    full = np.where(n >= k, counts, 0)
    out = np.zeros(int(counts.sum()), np.uint64)
    first = np.cumsum(counts) - counts
    w = c.windows(h, k)
    out[c.ranges(first, full)] = w[c.ranges(rows[:-1], full)] if len(w) else 0
    for m in range(1, k):  # short texts, by length
        some = np.flatnonzero(n == m)
        if len(some):
            out[first[some]] = c.windows(h, m, 0xD6E8FEB86659FD93 + 2 * m)[rows[:-1][some]]
    return out, counts


def sets(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each row in order, how often each occurs, and their number in each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((elements, row))
    e, r = elements[order], row[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    head = np.flatnonzero(new)
    return e[head], np.diff(np.concatenate([head, [len(e)]])), np.bincount(r[head], minlength=len(counts))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """A row of k dart names for each row of elements (zeros where there are none). weights: any numbers above 0."""
    n = len(counts)
    out = np.zeros((n, k), np.uint64)
    row = np.repeat(np.arange(n), counts)
    total = np.bincount(row, weights, minlength=n)
    bound = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n), where=total > 0)
    left = np.flatnonzero(total > 0)
    while len(left):
        chosen = np.zeros(n, bool)
        chosen[left] = True
        pick = np.flatnonzero(chosen[row])
        bands = 1 + np.ceil(np.log2(np.maximum(weights[pick], 1))).astype(np.int64)
        who, height = np.repeat(row[pick], bands), np.repeat(weights[pick].astype(np.float64), bands)
        band = c.ranges(np.zeros(len(bands), np.int64), bands)
        low = np.where(band > 0, 2.0 ** (band - 1), 0.0)
        width = np.maximum(low, 1.0)
        seed = c.mix(np.repeat(elements[pick], bands) ^ c.mix(band.astype(np.uint64) + _U(1)))
        time, step = np.zeros(len(seed)), 0
        at, when, name = [], [], []
        while len(seed):
            step += 1
            d = c.mix(seed + _U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log((d >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
            go = time <= bound[who]
            seed, time, who, d, low, width, height = (x[go] for x in (seed, time, who, d, low, width, height))
            hit = low + width * ((c.mix(d ^ _U(0xDA27)) >> _U(11)).astype(np.float64) * 2.0**-53) < height
            at.append(who[hit] * k + (c.mix(d[hit] ^ _U(0xC0FFEE)) % _U(k)).astype(np.int64))
            when.append(time[hit])
            name.append(d[hit])
        at, when, name = (np.concatenate(x) for x in (at, when, name))
        order = np.lexsort((when, at))
        at, name = at[order], name[order]
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1]
        out.reshape(-1)[at[head]] = name[head]
        full = np.bincount(at[head] // k, minlength=n) == k
        left = left[~full[left]]
        bound[left] *= 2
    return out


def _elements(data: np.ndarray, offs: np.ndarray, hasher: c.WordHash, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, _, rows = c.words(data, offs, c.BLANK_WORDS)
    return sets(*shingle_hashes(hasher(data, starts), rows, k))


def _hasher() -> c.WordHash:
    return c.WordHash(31, c.BLANK_WORDS)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> DataFrame:
    """_id, n (shingles), s1 and s2 (names of the shingle set), bands array<long>. weighting: "set", or "count" for multisets."""
    base = c.id_and_text(docs, doc_id, text)
    schema = T.StructType([base.schema["_id"], T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("bands", _LONGS)])

    def run(batches):
        hasher = _hasher()
        for batch, data, offs in c.text_slices(batches):
            e, often, n = _elements(data, offs, hasher, k)
            weight = np.ones(len(e), np.int64) if weighting == "set" else often
            sig = dart_signatures(e, weight, n, bands * rows)
            band = np.zeros((len(n), bands), np.uint64)
            for j in range(rows):
                band = c.mix(band * _U(0x9E3779B97F4A7C15) + sig[:, j::rows])
            band = c.mix(band ^ np.arange(bands, dtype=np.uint64))  # the band's number is part of its name
            ends = np.cumsum(n)
            tops = []
            for salt in (1, 2):
                total = np.concatenate([[_U(0)], np.cumsum(c.mix(e * _U(2 * salt + 1) + c.mix(weight.astype(np.uint64) + _U(salt))))])
                tops.append(pa.array((total[ends] - total[ends - n]).view(np.int64)))
            per = np.where(n > 0, bands, 0)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n), *tops, c.list_array(pa.array(band[n > 0].reshape(-1).view(np.int64)), per)], names=schema.names)

    return base.mapInArrow(run, schema)


def _shingles(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    base = c.id_and_text(docs, doc_id, text)
    schema = T.StructType([base.schema["_id"], T.StructField("set", _LONGS)])

    def run(batches):
        hasher = _hasher()
        for batch, data, offs in c.text_slices(batches):
            e, _, n = _elements(data, offs, hasher, k)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), c.list_array(pa.array(e.view(np.int64)), n)], names=schema.names)

    return base.mapInArrow(run, schema)


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (z.values.to_numpy(zero_copy_only=False) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, schema)


def _differences(pairs: DataFrame, threshold: float) -> DataFrame:
    """crowd, centre, m, node, n (how many elements both have), linked, diff (elements that one of the two lacks)."""
    fields = [T.StructField("n", T.LongType()), T.StructField("linked", T.BooleanType()), T.StructField("diff", _LONGS)]
    schema = T.StructType([T.StructField("crowd", T.LongType()), T.StructField("centre", pairs.schema["a"].dataType), T.StructField("m", T.LongType()), T.StructField("node", pairs.schema["b"].dataType), *fields])

    def run(batches):
        for batch in batches:
            m, n, linked, parts = [], [], [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (z.values.to_numpy(zero_copy_only=False) for z in (x, y))
                diff = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(diff)) // 2
                m.append(len(x))
                n.append(len(y))
                linked.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
                parts.append(diff)
            flat = pa.array(np.concatenate(parts)) if parts else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("crowd"), batch.column("a"), pa.array(m, pa.int64()), batch.column("b"), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), c.list_array(flat, np.array([len(x) for x in parts], np.int64))], names=schema.names)

    return pairs.select("crowd", "a", "b", "set_a", "set_b").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is linked with) of all nodes of edges (a, b). Large-star and small-star rounds."""
    e = c.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        # every node hands the least of its neighbourhood to its larger neighbours, then to its smaller ones
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = c.materialize(small.filter("u != v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _empty(spark: SparkSession, kind: T.DataType, *names: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(x, kind) for x in names]))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its group)."""
    sig = c.materialize(signatures(docs, doc_id, text, k, bands, rows))
    kind = sig.schema["_id"].dataType
    usable = sig.filter((F.col("n") > 0) & F.col("_id").isNotNull())
    # texts of one shingle set: the smallest id stands for all
    nodes = c.materialize(usable.groupBy("s1", "s2").agg(F.min(F.struct("_id", "n", "bands")).alias("x"), F.count("*").alias("copies")).select("s1", "s2", "x.*", "copies"))
    entry = nodes.select(F.explode("bands").alias("key"), F.col("_id").alias("node"), "n", "copies")
    crowd = entry.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key")
    members = c.materialize(entry.join(crowd, "key"))
    if not members.isEmpty():
        sets_ = c.materialize(_shingles(_only(docs, members.select("node").distinct(), doc_id), doc_id, text, k).withColumn("_h", F.xxhash64("set")).dropDuplicates(["_id", "_h"]).drop("_h"))
        group = _united(members, sets_, threshold)
    else:
        group = _empty(docs.sparkSession, kind, "node", "root")
    of = nodes.select("s1", "s2", F.col("_id").alias("node")).join(group, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("class_id"))
    out = sig.join(of, ["s1", "s2"], "left")
    return out.select(F.col("_id").alias(doc_id), F.when((F.col("n") > 0) & F.col("_id").isNotNull(), F.coalesce("class_id", "_id")).otherwise(F.col("_id")).alias("class_id"))


def _united(members: DataFrame, sets_: DataFrame, threshold: float) -> DataFrame:
    """node, root: the groups of nodes that share a bucket (key, node, n, copies) and reach the threshold.

    A bucket of two is one pair. The members of others are compared with a centre, which
    need not be of the bucket: of the nodes that its members share buckets with, the one
    that stands for most documents, or the smallest of such. Copies with edits scatter
    around what they were copied from, and all their buckets then have the same centre.
    Two nodes near the centre are of one group. A node far from it must share some of its
    difference from the centre with a partner: so partners meet by equality on one of the
    first elements of that difference (_far_pairs), in smaller crowds where too many would meet.
    """
    best = F.min(F.struct((-F.col("copies")).alias("c"), "node")).alias("hub")
    many = members.groupBy("key").agg(best, F.count("*").alias("many"), F.min(F.struct("node", "n")).alias("x"), F.max(F.struct("node", "n")).alias("y"))
    many = c.materialize(many)
    two = many.filter((F.col("many") == 2) & (F.col("x.n") >= F.col("y.n") * threshold - 1e-6) & (F.col("y.n") >= F.col("x.n") * threshold - 1e-6)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = members.select("key", "node").join(many.filter("many > 2").select("key", "hub"), "key")
    hubs = large.groupBy("node").agg(F.min("hub").alias("own_hub"))
    centres = large.join(hubs, "node").groupBy("key").agg(F.min("own_hub").alias("h")).select("key", F.col("h.node").alias("centre"))
    pair = large.join(centres, "key").filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).unionByName(two).distinct()
    a, b = (sets_.select(F.col("_id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    found = c.materialize(_differences(pair.join(a, "a").join(b, "b").withColumn("crowd", F.xxhash64("a", "set_a")), threshold))
    links = found.filter("linked").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    # rows of one id may have several texts: v tells them apart
    nodes = found.select("crowd", "node", F.xxhash64("diff").alias("v"), "n", F.lit(0).alias("apart"), "diff", F.when(F.col("linked"), F.col("centre")).otherwise(F.col("node")).alias("root"))
    centre = found.select("crowd", F.col("centre").alias("node"), F.col("m").alias("n")).distinct()
    centre = centre.select("crowd", "node", F.lit(0).cast("long").alias("v"), "n", F.lit(0).alias("apart"), F.array().cast(_LONGS).alias("diff"), F.col("node").alias("root"))
    found = nodes.unionByName(centre)
    while True:
        met, smaller = _far_pairs(found, threshold)
        links = links.unionByName(c.materialize(_similar(met.join(a, "a").join(b, "b"), threshold)))
        smaller = c.materialize(smaller)
        if smaller.isEmpty():
            return components(links)
        found = c.materialize(smaller.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))


def _of_crowds(rows: DataFrame, crowds: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their crowd; the crowds are broadcast up to a checked number, so that a large one is not dealt to one task."""
    return rows.join(F.broadcast(crowds) if c.is_small(crowds) else crowds, "crowd", how)


def _far_pairs(found: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of crowds (crowd, node, v, n, apart, diff, root): pairs (a, b) to compare, and smaller crowds without root.

    A node is a set known by its difference from something that its crowd has in common: the elements diff, and so many
    apart that no other shares. Two nodes are similar if their differences differ in at most rate * (n + n') elements. Nodes of
    one root are of one group already.

    In a crowd of more than FEW, elements that over half of the members have in diff are turned round for all. Then the slack of a node is
    rate * n less its difference. Two nodes whose slacks make zero or more are similar whatever they share, and
    so are both with the node of the largest slack, which is compared with them. Other pairs have a far node, one whose slack and the largest are below zero;
    they share at least half of what is missing. So they meet on one of the first elements of their differences, in an order for the whole
    crowd, those of the fewest far nodes first; elements that the same nodes have meet once.
    Where an element has more than FEW on both sides nothing is compared: they are a crowd of their own. Pairs that share an earlier
    element have met there, so it keeps only what comes from this element on, and has half the members at most.
    """
    rate, span = (1 - threshold) / (1 + threshold), (1 - threshold) / threshold
    crowds = c.materialize(found.groupBy("crowd").agg(F.count("*").alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("many > 2 and lo != hi").select("crowd", "many"))
    rows = _of_crowds(found, crowds)
    usual = rows.filter(F.col("many") > FEW).select("crowd", "many", F.explode("diff").alias("e")).groupBy("crowd", "e").agg(F.count("*").alias("all"), F.first("many").alias("many"))
    usual = c.materialize(usual.filter(F.col("all") * 2 > F.col("many")).groupBy("crowd").agg(F.collect_list("e").alias("usual")))
    turned = F.concat(F.array_except("diff", "usual"), F.array_except("usual", "diff"))
    rows = _of_crowds(rows, usual, "left").withColumn("diff", F.when(F.col("usual").isNull(), F.col("diff")).otherwise(turned)).drop("usual")
    rows = rows.withColumn("size", F.size("diff")).withColumn("d", F.col("apart") + F.col("size"))
    rows = c.materialize(rows.withColumn("slack", F.col("n") * rate - F.col("d")))
    most = c.materialize(rows.groupBy("crowd").agg(F.max(F.struct("slack", "node", "root", "n")).alias("most")))
    rows = _of_crowds(rows, most).withColumn("far", F.col("slack") + F.col("most.slack") < -1e-6)
    near = F.col("n").between(F.col("most.n") * threshold - 1e-6, F.col("most.n") / threshold + 1e-6)
    first = rows.filter(near & (~F.col("far") | (F.col("many") > FEW)) & (F.col("node") != F.col("most.node")) & (F.col("root") != F.col("most.root"))).select(F.least("node", "most.node").alias("a"), F.greatest("node", "most.node").alias("b"))

    def at_least(x):
        return F.greatest(F.lit(1), F.ceil(x - 1e-6))

    # how many elements a node shares with a far one that has no smaller difference, if it is far itself; and a far one with any
    partner = at_least(F.greatest((F.abs("most.slack") - F.col("slack")) / 2, F.when(F.col("far"), F.col("d") - F.col("n") * (span / 2)).otherwise(0.0)))
    any_ = at_least(F.greatest(-(F.col("most.slack") + F.col("slack")) / 2, F.col("d") - F.col("n") * span))
    each = rows.select("crowd", "node", "v", "root", "n", "d", "size", "far", (F.col("size") - partner).alias("to_meet"), (F.col("size") - any_).alias("to_reach"), F.explode("diff").alias("e"))
    often = each.groupBy("crowd", "e").agg(F.count("*").alias("all"), F.count(F.when(F.col("far"), 1)).alias("fars"), F.bit_xor(F.xxhash64("node", "v")).alias("who"))
    order = Window.partitionBy("crowd", "node", "v").orderBy("fars", "who", "e")
    own = F.col("far").cast("int")
    # elements that no other far node has lead nowhere; they only take their places
    placed = each.join(often, ["crowd", "e"]).withColumn("pos", F.row_number().over(order) - 1).withColumn("lead", ~F.col("who").eqNullSafe(F.lag("who").over(order)))
    placed = placed.filter((F.col("fars") > own) | (F.col("far") & (F.col("all") > 1)))
    placed = placed.withColumn("meets", F.col("lead") & (F.col("pos") <= F.col("to_meet")) & (F.col("fars") > own)).withColumn("reaches", F.col("lead") & F.col("far") & (F.col("pos") <= F.col("to_reach")))
    placed = c.materialize(placed.select("crowd", "e", "node", "v", "root", "n", "d", "size", "far", "pos", "meets", "reaches"))
    here = placed.filter("meets or reaches")
    groups = here.groupBy("crowd", "e").agg(F.count(F.when(F.col("meets"), 1)).alias("k"), F.count(F.when(F.col("reaches"), 1)).alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    groups = c.materialize(groups.filter("k > 0 and f > 0 and lo != hi").select("crowd", "e", ((F.col("k") > FEW) & (F.col("f") > FEW)).alias("crowded")))
    some = here.join(groups, ["crowd", "e"])
    few = some.filter("not crowded")
    far = few.filter("reaches").select("crowd", "e", *[F.col(x).alias(f"far_{x}") for x in ("node", "root", "n", "d", "size", "pos")])
    # of two far nodes the one with the smaller difference is the partner
    small = ~F.col("far") | (F.struct("d", "node") < F.struct("far_d", "far_node"))
    allowed = (F.col("n") + F.col("far_n")) * rate
    share = at_least((F.col("far_d") + F.col("d") - allowed) / 2)
    place = (F.col("pos") <= F.col("size") - share) & (F.col("far_pos") <= F.col("far_size") - share)
    fits = (F.col("root") != F.col("far_root")) & small & place & (F.abs(F.col("d") - F.col("far_d")) <= allowed + 1e-6) & F.col("n").between(F.col("far_n") * threshold - 1e-6, F.col("far_n") / threshold + 1e-6)
    met = far.join(few.filter("meets"), ["crowd", "e"]).filter(fits).select(F.least("node", "far_node").alias("a"), F.greatest("node", "far_node").alias("b"))
    start = some.filter("crowded").select("crowd", "node", "v", F.xxhash64("crowd", "e").alias("next"), F.col("pos").alias("start"))
    after = placed.select("crowd", "node", "v", "n", "d", "pos", "e").join(start, ["crowd", "node", "v"]).filter("pos >= start")
    smaller = after.groupBy("next", "node", "v").agg(F.first("n").alias("n"), F.first("d").alias("d"), F.collect_list("e").alias("diff"))
    smaller = smaller.select(F.col("next").alias("crowd"), "node", "v", "n", (F.col("d") - F.size("diff")).alias("apart"), "diff")
    return met.unionByName(first).distinct(), smaller


def _only(docs: DataFrame, nodes: DataFrame, doc_id: str, how: str = "left_semi") -> DataFrame:
    """The documents with (or "left_anti": without) these ids; the ids are broadcast up to a checked number, joined by a shuffle beyond it."""
    name = c.free(docs, "node")
    nodes = nodes.select(F.col("node").alias(name))
    return docs.join(F.broadcast(nodes) if c.is_small(nodes, BROADCAST_IDS) else nodes, F.col(doc_id) == F.col(name), how)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that stand for their group, with all their columns.

    Rows without an id all stay. Of rows that share an id one stays: that with the smallest
    text, then with the smallest hash of all columns.
    """
    groups = near_duplicates(docs, doc_id, text, **how)
    gone = c.materialize(groups.filter(F.col(doc_id) != F.col("class_id")).select(F.col(doc_id).alias("node")).distinct())
    again = c.materialize(docs.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select("node"))
    left = _only(docs, gone, doc_id, "left_anti")
    if again.isEmpty():
        return left
    columns = [F.col(f"`{x}`") for x in docs.columns]
    first = _only(left, again, doc_id).groupBy(F.col(doc_id).alias("_node")).agg(F.min_by(F.struct(*columns), F.struct(F.col(text), F.xxhash64(*columns))).alias("_row"))
    return _only(left, again, doc_id, "left_anti").unionByName(first.select(*[F.col("_row").getField(x).alias(x) for x in docs.columns]))
