"""Nearest neighbours by a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards of bounded size by a hash of the vector, so that equal vectors
meet in one shard, where they are one node with its ids. Each shard's task builds the
graph level by level: a node's level is drawn from a hash of its vector, its neighbours
are chosen among the nearest found by a beam search, diverse ones first, and kept in flat
arrays of numbers (a fixed number of places for a node on a level). A query descends
greedily from the top, then searches the bottom level with a beam; the shards' results
are merged by score.

The numbers of ids of one node are unbounded in a hot vector, so ids are sent to a shard
already reduced: of each vector, its least ids, as many as a query can return, and a
query needs no more. Queries are a stated set (ids divisible by `every`) and go to all
shards; they are dealt by shard and block.

Scale: one shuffle of the distinct vectors, one of the queries times shards; a shard holds
at most about `shard_rows` vectors, whatever the number of rows.

Defined results: vectors that are null, zero, or have null or non-finite components take
no part, as queries or as candidates, nor do rows without an id; rows that share an id
count once, with the smallest of their vectors; with fewer candidates than asked for, all
are returned; ties go to the smaller id; vectors of different lengths meet only their own
kind; an empty table has no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Neighbours of a node on an upper level; the bottom level has twice as many.
LINKS = 16
#: Beam while building and while searching.
BUILD_BEAM, SEARCH_BEAM = 64, 96
SHARD_ROWS = 8192


class Graph:
    """The graph of one shard: vectors (rows), levels, flat neighbour arrays (-1: none)."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.levels, self.links, self.beam = levels, links, beam
        n = len(self.x)
        self.flat = [np.full((n, 2 * links), -1, np.int32)]
        self.flat += [np.full((n, links), -1, np.int32) for _ in range(int(levels.max(initial=0)))]
        self.seen, self.stamp = np.zeros(n, np.int64), 0
        self.entry = -1
        order = np.argsort(-levels, kind="stable")  # upper nodes first: the entry never changes
        for i in order.tolist():
            self._insert(i)

    def distances(self, q: np.ndarray, qq: float, at: np.ndarray) -> np.ndarray:
        return self.norm[at] - 2 * (self.x[at] @ q) + qq

    def _insert(self, i: int) -> None:
        if self.entry < 0:
            self.entry = i
            return
        q, qq = self.x[i], float(self.norm[i])
        at = [self.entry]
        for level in range(int(self.levels[self.entry]), int(self.levels[i]), -1):
            at = self.greedy(q, qq, at[0], level)
        for level in range(min(int(self.levels[i]), int(self.levels[self.entry])), -1, -1):
            found, d = self.search(q, qq, at, level, self.beam)
            near = self._diverse(found, d, self.links)
            flat = self.flat[level]
            flat[i, : len(near)] = near
            for j in near.tolist():
                self._link(flat, j, i)
            at = found[:4].tolist()

    def _link(self, flat: np.ndarray, j: int, i: int) -> None:
        free = np.flatnonzero(flat[j] < 0)
        if len(free):
            flat[j, free[0]] = i
            return
        own = np.append(flat[j], np.int32(i))
        d = self.distances(self.x[j], float(self.norm[j]), own)
        order = np.argsort(d, kind="stable")
        keep = self._diverse(own[order], d[order], flat.shape[1])
        flat[j] = -1
        flat[j, : len(keep)] = keep

    def _diverse(self, found: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
        """Of nodes by distance, those nearer to the centre than to one chosen before; then the nearest of the rest."""
        if len(found) <= most:
            return found
        x = self.x[found]
        between = self.norm[found][:, None] + self.norm[found][None, :] - 2 * (x @ x.T)
        chosen = np.zeros(len(found), bool)
        closest = np.full(len(found), np.inf)
        count = 0
        for k in range(len(found)):
            if closest[k] > d[k]:
                chosen[k] = True
                count += 1
                if count == most:
                    break
                np.minimum(closest, between[k], out=closest)
        out = found[chosen]
        return np.concatenate([out, found[~chosen][: most - count]]) if count < most else out

    def greedy(self, q: np.ndarray, qq: float, at: int, level: int) -> list[int]:
        best = float(self.distances(q, qq, np.array([at]))[0])
        while True:
            near = self.flat[level][at]
            near = near[near >= 0]
            if not len(near):
                return [at]
            d = self.distances(q, qq, near)
            k = int(d.argmin())
            if d[k] >= best:
                return [at]
            best, at = float(d[k]), int(near[k])

    def search(self, q: np.ndarray, qq: float, entries: list[int], level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and squared distances, nearest first: a beam search that opens several nodes at a time."""
        self.stamp += 1
        seen, stamp, flat = self.seen, self.stamp, self.flat[level]
        nodes = np.unique(np.array(entries, np.int32))
        seen[nodes] = stamp
        d = self.distances(q, qq, nodes)
        opened = np.zeros(len(nodes), bool)
        while True:
            todo = np.flatnonzero(~opened)
            if not len(todo):
                break
            pick = todo[:4]  # nodes are in order of distance
            opened[pick] = True
            near = flat[nodes[pick]].ravel()
            near = near[near >= 0]
            near = np.unique(near[seen[near] != stamp])
            if not len(near):
                continue
            seen[near] = stamp
            e = self.distances(q, qq, near)
            if len(nodes) >= beam:
                good = e < d[-1]
                near, e = near[good], e[good]
                if not len(near):
                    continue
            nodes, d, opened = np.concatenate([nodes, near]), np.concatenate([d, e]), np.concatenate([opened, np.zeros(len(near), bool)])
            order = np.argsort(d, kind="stable")[:beam]
            nodes, d, opened = nodes[order], d[order], opened[order]
        order = np.argsort(d, kind="stable")
        return nodes[order], d[order]

    def nearest(self, q: np.ndarray, beam: int) -> np.ndarray:
        q = q.astype(np.float32)
        qq = float(q @ q)
        at = [self.entry]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self.greedy(q, qq, at[0], level)
        return self.search(q, qq, at, 0, beam)[0]


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """_id, _v array<double>: rows that take part."""
    v = rows.select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    odd = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("_id").isNotNull() & F.col("_v").isNotNull() & ~odd & F.exists("_v", lambda x: x != 0))


def one_per_id(base: DataFrame) -> DataFrame:
    """Rows of usable() with one row for each id, that of the smallest vector. Only vectors of repeated ids are shuffled."""
    again = c.materialize(base.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("_id").alias("_again")))
    if again.isEmpty():
        return base
    keys = F.broadcast(again) if c.is_small(again) else again
    single = base.join(keys, F.col("_id") == F.col("_again"), "left_anti")
    rest = base.join(keys, F.col("_id") == F.col("_again"), "left_semi")
    return c.materialize(single.unionByName(rest.groupBy("_id").agg(F.min("_v").alias("_v"))))


def search(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`, against all others."""
    base = one_per_id(usable(rows, vec_id, vector))
    # equal vectors: the least ids, k + 1 of them, as a query itself may be among them
    hashed = base.withColumn("_h", F.xxhash64("_v", F.lit(1)))
    nodes = c.materialize(least_ids(hashed, k + 1))
    queries = base.filter(F.col("_id") % every == 0)
    sizes = nodes.agg(F.count("*").alias("n")).first()
    shards = max(1, -(-sizes["n"] // shard_rows))
    left = nodes.select(F.pmod("_h", F.lit(shards)).cast("int").alias("shard"), "_ids", "_v", "_h")
    # a task for each shard: all have about the same work
    built = c.materialize(left.repartitionById(shards, F.col("shard")).groupBy("shard").applyInPandas(_build, GRAPH))
    spread = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "_id", "_v")
    blocks = spread.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(max(1, int(queries.count()) // block + 1))).cast("int"))
    asked = blocks.groupBy("shard", "block").agg(F.collect_list(F.struct(F.col("_id").alias("id"), F.col("_v").alias("v"))).alias("asked"))
    out = asked.join(built, "shard").select("asked", "graph").mapInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


GRAPH = "shard int, graph binary"


def least_ids(rows: DataFrame, k: int) -> DataFrame:
    """_h, _v, _ids: each distinct vector with its least k ids. The rank limit is applied in each task before the shuffle."""
    first = F.row_number().over(Window.partitionBy("_h", "_v").orderBy("_id"))
    return rows.select("_h", "_v", "_id").withColumn("_k", first).filter(F.col("_k") <= k).groupBy("_h", "_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's graphs (one for each length of vectors), as bytes."""
    import pickle

    out = []
    pdf = pdf.sort_values("_h", kind="stable")
    for _, own in pdf.groupby(pdf["_v"].map(len)):
        x = np.stack(own["_v"].to_numpy())
        h = c.mix(own["_h"].to_numpy(np.int64).view(np.uint64))
        u = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        g = Graph(x, np.floor(-np.log(u) / np.log(LINKS)).astype(np.int64))
        ids = own["_ids"].to_list()
        out.append((x, g.levels, g.flat, g.entry, np.concatenate(ids), np.array([len(i) for i in ids])))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "graph": [pickle.dumps(out, protocol=5)]})


def _opened(x, levels, flat, entry) -> Graph:
    g = Graph.__new__(Graph)
    g.x = np.ascontiguousarray(x, np.float32)
    g.norm = np.einsum("ij,ij->i", g.x, g.x)
    g.levels, g.flat, g.entry, g.seen, g.stamp = levels, flat, entry, np.zeros(len(x), np.int64), 0
    return g


def _search(k: int, beam: int):
    def run(frames):
        import pickle

        for frame in frames:
            for asked, raw in zip(frame["asked"], frame["graph"], strict=True):
                graphs = {len(x[0][0]): (_opened(*x[:4]), *x) for x in pickle.loads(raw)}
                rows = []
                for item in asked:
                    q = np.asarray(item["v"], np.float64)
                    if len(q) not in graphs:
                        continue
                    g, x, _, _, _, ids, n = graphs[len(q)]
                    first = np.cumsum(n) - n
                    near = g.nearest(q, max(beam, k + 1))
                    score = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
                    own, d = ids[c.ranges(first[near], n[near])], np.repeat(score, n[near])
                    own, d = own[own != item["id"]], d[own != item["id"]]
                    order = np.lexsort((own, d))[:k]
                    rows.append(pd.DataFrame({"query_id": item["id"], "vec_id": own[order], "score": d[order]}))
                if rows:
                    yield pd.concat(rows)

    return run
