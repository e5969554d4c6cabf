"""Every operator and stage on awkward tables: null ids, repeated rows and ids, no rows, very long texts, clashing names."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioworks.llm import ann, bpe, decontaminate, html_extract, kneser_ney, near_dedup, substring_dedup, token_counts, toxicity, warc

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
LONG = "one long text without end, " * 400_000  # over 10 MB
CLASH = ["_id", "_text", "_key", "_row", "_fp", "_lang", "score", "node", "root", "n", "key", "keys", "class_id", "_node", "_other_id", "_y", "_p", "host", "template", "shard", "rank"]
BASE = " ".join(f"w{k}" for k in range(60))
ROWS = [(None, BASE), (None, BASE), (1, None), (2, ""), (3, BASE), (3, BASE), (3, BASE + " more"), (4, LONG), (5, "  "), (6, "x" * 200_000)]


def awkward(spark, rows=ROWS):
    df = spark.createDataFrame([(i, t, None if i is None else "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(x) for k, x in enumerate(CLASH)]).repartition(3)


@pytest.fixture(scope="module")
def side(spark):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(1, 7)] + [(None, 1, None), (3, None, 0)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(7, "W10 w11 w12 w13 w14 w15 w16 w17 w18 w19"), (None, "long text"), (7, "")], "item_id long, text string")
    return labels, bench


def operators(labels, bench):
    return {
        "bpe": lambda d: bpe.encode_documents(d, MULTI, P.PATTERN),
        "decontamination": lambda d: decontaminate.contamination(d, bench),
        "near_dedup": near_dedup.near_duplicates,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "quality": lambda d: kneser_ney.quality(d, labels),
        "token_counts": lambda d: token_counts.token_counts(d, PLAIN, P.PATTERN),
        "substring_dedup": substring_dedup.dedup_digest,
    }


@pytest.mark.parametrize("name", ["bpe", "decontamination", "near_dedup", "toxicity", "quality", "token_counts", "substring_dedup"])
def test_a_row_for_each_row(spark, side, name):
    run = operators(*side)[name]
    got = sorted((tuple(r) for r in run(awkward(spark)).collect()), key=str)
    assert sorted(r[0] for r in got if r[0] is not None) == [1, 2, 3, 3, 3, 4, 5, 6] and len(got) == len(ROWS)
    same = [r for r in got if r[0] is None]
    assert same[0] == same[1] or name == "near_dedup"
    assert run(awkward(spark).filter("false")).count() == 0
    if name == "decontamination":
        by = {r[0]: r for r in got}
        assert by[None][2] == 10 and by[None][5] and by[4][3] == 0 and by[4][2] == 800_000 and not by[2][5]
    if name == "near_dedup":
        assert [r[1] for r in got if r[0] == 3] == [3, 3, 3] and all(r[1] is None for r in got if r[0] is None)
    if name == "bpe":
        assert {r[0]: r for r in got}[4][3] == hashlib.sha256(LONG.encode()).hexdigest()


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, side, tmp_path, k):
    labels, bench = side
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    df = awkward(spark)
    out = stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    ids = sorted(r.doc_id for r in out.filter("doc_id is not null").collect())
    if name == "near_dedup":
        texts = {r.doc_id: r.text for r in out.filter("doc_id = 3").collect()}
        assert ids == [1, 2, 3, 4, 5, 6] and texts == {3: BASE} and out.filter("doc_id is null").count() == 2
    if name == "decontamination":
        assert ids == [1, 2, 5, 6]
    if name == "substring_dedup":
        assert ids == [1, 2, 3, 3, 3, 4, 5, 6]
    assert stage(spark, df.filter("false"), str(tmp_path)).count() == 0


def test_pages_and_vectors(spark):
    rows = [(1, "http://h/", "<p>" + LONG), (1, "http://h/", "<p>" + LONG), (None, None, None), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(0).alias(x) for x in ("_id", "_url", "_text", "payload", "digest", "refers_to", "host", "_host", "template", "text", "first")])
    got = sorted(((r.page_id, r.payload_bytes, r.record_type) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, len(LONG) + 3, "response"), (1, len(LONG) + 3, "response"), (2, 0, "response"), (None, 0, "response")], key=str)
    assert sorted(r.n_chars for r in html_extract.extract(pages).collect()) == [0, 0, len(LONG) - 1, len(LONG) - 1]
    none = pages.filter("false")
    assert warc.round_trip(none).count() == html_extract.extract(none).count() == 0
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, [float("inf"), 1.0])], "vec_id long, embedding array<double>").select("*", *[F.lit(0).alias(x) for x in ("_id", "_v", "_h", "shard", "block", "score")])
    assert [tuple(r) for r in ann.search(vectors).collect()] == [(0, 1, 1, 0.0)]
