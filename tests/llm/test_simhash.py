"""SimHash fingerprints and components against plain loops."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from folioworks.llm import near_dedup, simhash

from test_awkward import CLASH, LONG, awkward


def plain(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def groups(marks):
    """The smallest mark that chains of fingerprints within 4 bits reach."""
    marks = sorted(set(marks))
    root = {x: x for x in marks}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x in enumerate(marks):
        for y in marks[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in marks}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", None, " \n", "one", "One TWO\tthree", "a b c d", "Éa  b\r\nc\x0bd e \x1cf", "same " * 3000, "x y " * 700 + "z"])
def test_a_fingerprint(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert simhash.fingerprints(df).first().fp == signed(plain(text))


def test_fingerprints_of_a_buffer(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["A", "b", "çé", "word", "other"]) for _ in range(rng.randrange(0, 900))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r[0]: r.fp for r in simhash.fingerprints(df).collect()} == {i: signed(plain(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("few", [2, 16, 256])
def test_links_have_the_components_of_all_pairs(spark, few):
    rng = random.Random(few)
    marks = [0, (1 << 64) - 1]
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            marks.append(at)
            for _ in range(rng.randrange(1, 7)):
                at ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)  # a crowd around one place, most of it not linked with the centre
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randrange(3, 9)):
            x ^= 1 << b
        marks.append(x)
    want = groups(marks)
    df = spark.createDataFrame([(signed(x),) for x in set(marks)], "fp long")
    found = simhash.links(df, few)
    assert all(r.a != r.b and want[r.a & (1 << 64) - 1] == want[r.b & (1 << 64) - 1] for r in found.collect())
    root = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in near_dedup.components(found).collect()}
    by_root, by_want = {}, {}
    for x in set(marks):
        by_root.setdefault(root.get(x, x), set()).add(x)
        by_want.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


def test_crowded_keys_grow_with_their_members(spark):
    def rows(m):
        rng = random.Random(1)
        marks = {0x1234567800000000 | rng.getrandbits(32) for _ in range(m)}
        return simhash.links(spark.createDataFrame([(signed(x),) for x in marks], "fp long"), 16).count()

    assert rows(800) <= 6 * max(rows(200), 100)


def test_documents(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(600)]
    texts = ["", None, " ", "short text", "Short TEXT"] + [" ".join(base)] * 4
    for k in range(30):
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(600)] = "changed"
        texts.append(" ".join(copy))
    df = spark.createDataFrame([(100 + i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, fp int").repartition(5)
    marks = {100 + i: plain(t) for i, t in enumerate(texts)}
    root = groups(marks.values())
    least = {}
    for i, x in marks.items():
        least[root[x]] = min(i, least.get(root[x], i))
    got = simhash.simhash_components(df).collect()
    assert sorted(map(tuple, got)) == [(i, f"{marks[i]:016x}", least[root[marks[i]]]) for i in sorted(marks)]


def test_awkward_rows(spark):
    df = awkward(spark)
    got = simhash.simhash_components(df).collect()
    assert len(got) == df.count() and simhash.simhash_components(df.filter("false")).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == by[5].component_id == 1
    w = LONG.split()
    often = Counter(" ".join(w[i : i + 4]) for i in range(len(w) - 3))
    h = {xxhash.xxh64_intdigest(x.encode(), 42): n for x, n in often.items()}
    assert by[4].fingerprint == f"{sum((2 * sum(n for x, n in h.items() if x >> b & 1) > len(w) - 3) << b for b in range(64)):016x}"
    none = [r for r in got if r.doc_id is None]
    assert len(none) == 2 and {r.component_id for r in none} == {3}
    only = df.filter("doc_id is null").select("doc_id", "text", *[F.lit(1).alias(x) for x in CLASH[:3]])
    assert {r.component_id for r in simhash.simhash_components(only).collect()} == {None}
