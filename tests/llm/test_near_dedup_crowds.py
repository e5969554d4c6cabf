"""Near duplicates among crowds that share one change: groups as by all pairs, work in proportion to the members."""

import random

import pytest

from folioworks.llm import near_dedup


def crowd(m, linked, seed, place=None):
    """Five copies of a text, and m with the same changed passage and each with changes of its own; some of these in groups."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)] * 5
    for i in range(m):
        own = list(base)
        own[20:35] = [f"shared{k}" for k in range(15)]
        group = i // 3 if i < linked else f"x{i}"
        at = place or random.Random(str(group)).randrange(50, 180)
        own[at : at + 8] = [f"own{group}-{k}" for k in range(8)]
        if i < linked:
            own[rng.randrange(190, 200)] = f"last{i}"
        texts.append(" ".join(own))
    return texts


def classes(texts):
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return dict(enumerate(root))


@pytest.fixture
def compared(monkeypatch):
    count = [0]
    for name in ("_similar", "_differences"):

        def counted(pairs, threshold, own=getattr(near_dedup, name)):
            count[0] += pairs.count()
            return own(pairs, threshold)

        monkeypatch.setattr(near_dedup, name, counted)
    return count


def test_pairs_follow_members(spark, compared):
    made = {}
    for m, place in ((100, 100), (400, 100), (120, None)):
        compared[0] = 0
        texts = crowd(m, 30, 1, place)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == classes(texts)
        made[m] = compared[0]
    assert made[400] < 5 * made[100] and made[120] < 120 * near_dedup.FEW * 2


@pytest.mark.parametrize("few", [3, 8])
def test_small_limits_lose_nothing(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    texts = crowd(30, 24, 2)
    rng = random.Random(few)
    for t in texts[5:25]:
        w = t.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(200)] = rng.choice(["p", "q"])
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == classes(texts)


def test_elements_follow_members(spark, monkeypatch):
    """Smaller crowds do not take their members' differences over and over."""
    held = []

    def counted(found, threshold, own=near_dedup._far_pairs):
        held.append(found.selectExpr("coalesce(sum(size(diff)), 0)").first()[0])
        return own(found, threshold)

    monkeypatch.setattr(near_dedup, "_far_pairs", counted)
    texts = crowd(300, 0, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == classes(texts)
    assert sum(held) < 1.5 * held[0], held


def test_pipeline_stage_follows_members(spark, monkeypatch):
    import corpus_pipeline

    held = []

    def counted(found, threshold, own=near_dedup._far_pairs):
        held.append(found.selectExpr("coalesce(sum(size(diff)), 0)").first()[0])
        return own(found, threshold)

    monkeypatch.setattr(near_dedup, "_far_pairs", counted)
    texts = crowd(300, 0, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.remove_near_duplicates(spark, df, "").collect()
    assert {r.doc_id for r in kept} == set(classes(texts).values())
    assert sum(held) < 1.5 * held[0], held
