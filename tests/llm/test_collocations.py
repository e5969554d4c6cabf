"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import collocations

from test_awkward import awkward


def plain(rows, best, least, drop=50):
    grams = {}
    for lang, text in rows:
        own = grams.setdefault(lang or "und" if lang is None else lang, Counter())
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = []
    for lang, f in grams.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in cand.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i : i + m]] = max(a, longer[g[i : i + m]])
        n = sum(a for g, a in f.items() if len(g) == 1)
        found = []
        for g, a in cand.items():
            if longer[g] and 100 * longer[g] >= drop * a:
                continue
            score, _, le, r = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), le, r))
        out += [(lang, k, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for k, x in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def texts(seed, n=400):
    rng = random.Random(seed)
    kinds = ["É", "ab", "Ab", "x"] + [f"w{k}" for k in range(120)]
    weight = [1 / (k + 1) for k in range(len(kinds))]
    out = []
    for i in range(n):
        w = rng.choices(kinds, weight, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice([["fix", "phrase", "three"], ["New", "york"], ["one", "off", f"q{rng.randrange(30)}"]])
        out.append((rng.choice(["en", "en", "de", None, "und", "xx"]) if i % 50 else "rare", rng.choice([" ", "\t ", " ", ", "]).join(w)))
    return out + [("en", None), (None, ""), ("none", None)]


@pytest.mark.parametrize(("best", "least", "words"), [(5, 3, 1 << 20), (40, 2, 1 << 20), (2000, 2, 1 << 20), (40, 2, 50)])
def test_phrases(spark, monkeypatch, best, least, words):
    monkeypatch.setattr(collocations, "STEP_WORDS", words)
    rows = texts(best)
    df = spark.createDataFrame([(i, t, la, 0) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, n long").repartition(4)
    if words < 100:
        df = df.withColumn("text", F.col("text"))
    got = sorted(map(tuple, collocations.collocations(df, best=best, least=least).collect()))
    assert got == plain(rows, best, least)


def test_thresholds_settle_with_ties(spark):
    """Many phrases of one score: the last place goes by counts and letters, wherever the threshold was."""
    rows = [("en", f"a{k:03d} b{k:03d}") for k in range(300) for _ in range(10)] + [("en", f"c{k} d{k} e{k}.") for k in range(30) for _ in range(12)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for best in (20, 50, 100):
        assert sorted(map(tuple, collocations.collocations(df, best=best).collect())) == plain(rows, best, 10)


def test_large_products_stay_exact(spark):
    a = 3_000_000_019
    df = spark.createDataFrame([(a, a + 2, a + 7)], "a long, l long, r long")
    assert df.select(collocations._score("a", "l", "r").alias("s")).first().s == 10**6 * a * a // ((a + 2) * (a + 7))


def test_bit_tables_hold_all_their_keys(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63, (500, 2))
    df = spark.createDataFrame([(int(x), int(y), [1, 4] if k % 2 else [1]) for k, (x, y) in enumerate(h)], "h1 long, h2 long, kinds array<int>")
    table = collocations._filter(df, ["h1", "h2"])
    u = h.view(np.uint64)
    assert collocations._has(table, 1, u[:, 0], u[:, 1]).all() and (collocations._has(table, 4, u[:, 0], u[:, 1]) == (np.arange(500) % 2 == 1)).all()
    assert not collocations._has(table, 1, u[:, 1], u[:, 0]).any()


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    assert sorted(map(tuple, collocations.collocations(df).collect())) == plain(rows, 2000, 10)
    assert collocations.collocations(df.filter("false")).count() == 0
