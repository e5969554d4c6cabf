"""Ranked lexical search against plain scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import lexical

from test_awkward import awkward


def terms(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, best=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in full), sum(full)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        rows = []
        for (i, bag), n in zip(bags, full, strict=True):
            m = 100 - 90 + 90 * n * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in own if bag[t])
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:best], 1)]
    return sorted(out, key=str)


def rows(n, seed):
    rng = random.Random(seed)
    kinds = ["ÉCLAIR", "été", "x9"] + [f"w{k}" for k in range(400)]
    weight = [1 / (k + 1) for k in range(len(kinds))]
    docs = [(i, "-".join(rng.choices(kinds, weight, k=rng.choice([0, 3, 30, 30, 400])))) for i in range(n)]
    docs += [(n + i, docs[rng.randrange(n)][1]) for i in range(n // 4)]  # equal scores
    items = [(i, " ".join(rng.choices(kinds, weight, k=rng.choice([0, 1, 5, 40])))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("block_terms", [60, 1 << 18])
def test_all_items(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "SEEDS", 8)
    docs, items = rows(300, 5)
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = lexical.search(d, q, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_buckets_and_bounds_prune_without_loss():
    rng = np.random.default_rng(2)
    n, kinds = 5000, 300
    counts = rng.integers(0, 40, n)
    t = np.concatenate([np.sort(rng.choice(kinds, k, replace=False)) for k in counts]).astype(np.int64)
    x = rng.integers(1, 10**6, len(t))
    weights = rng.integers(0, 9000, kinds)
    own = [np.sort(rng.choice(kinds, k, replace=False)) for k in (1, 3, 10, 60)]
    items = lexical._Items(list("abcd"), np.repeat(np.arange(4), [len(o) for o in own]), np.concatenate(own), weights)
    row = np.repeat(np.arange(n), counts)
    length = np.sqrt(np.bincount(row, weights[t] * x.astype(float) ** 2, minlength=n))
    import pyarrow as pa

    search = lexical._Search(items)
    search.add(pa.array(np.arange(n)), t, x, counts, length)
    for k, o in enumerate(own):
        score = np.zeros(n, np.int64)
        np.add.at(score, row, np.where(np.isin(t, o), weights[t] * x, 0))
        best = sorted((-s, i) for i, s in enumerate(score.tolist()) if s)[:10]
        assert [(r[0], r[2]) for r in search.found[k]] == best
    assert search.compared < n  # of 4 n pairs


def test_awkward_rows(spark):
    df = awkward(spark)
    items = spark.createDataFrame([(None, "w1 long"), (None, "W2"), (1, "text"), (1, "more"), (2, ""), (3, None), (4, "nowhere")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = plain(docs, [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in lexical.search(df, items).collect()), key=str) == want and want
    assert lexical.search(df.filter("false"), items).count() == lexical.search(df, items.filter("false")).count() == 0
    named = df.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    assert lexical.search(named, items, "name", "body").count() == len(want)
