"""A page store: rebuilds of whole books, beside readers and after failures."""

from pyspark.sql import functions as F

from folioworks.plans import library
from folioworks.sources.page_store import PageStore


def pages(spark, *rows):
    return spark.createDataFrame(rows, "book_id string, path string, title string, text string")


def content(store):
    return sorted((r.book_id, r.path, r.text) for r in store.read().collect())


def test_rebuilds(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "s"))
    store.rebuild(pages(spark, ("007", "/1", "t", "a"), ("007", "/2", "t", "b"), ("b", "/1", "t", "c")))
    assert content(store) == [("007", "/1", "a"), ("007", "/2", "b"), ("b", "/1", "c")]
    reader = store.read()
    store.rebuild(pages(spark, ("007", "/2", "t", "new")))
    assert content(store) == [("007", "/2", "new"), ("b", "/1", "c")]
    assert sorted(r.text for r in reader.collect()) in (["a", "b", "c"], ["c", "new"])  # a whole, whichever
    # a rebuild that failed before its last step is not seen, and the next one takes its place
    pages(spark, ("b", "/9", "t", "half")).write.parquet(str(tmp_path / "s" / "pages" / "version=2"))
    assert content(store) == [("007", "/2", "new"), ("b", "/1", "c")]
    store.rebuild(pages(spark, ("c", "/1", "t", "d")), spark.createDataFrame([("c",), ("b",)], "book_id string"))
    assert content(store) == [("007", "/2", "new"), ("c", "/1", "d")]
    store.clear(spark.createDataFrame([("007",)], "book_id string"))
    assert content(store) == [("c", "/1", "d")]
    store.rebuild(pages(spark, ("007", "/3", "t", "back")))
    assert content(store) == [("007", "/3", "back"), ("c", "/1", "d")]


def test_reindex(spark, tmp_path):
    raw = spark.createDataFrame([(f"b{i}", f"/{k}.html", k, f"<title>T{k}</title><body>x{i}</body>" if i != 2 or k else None) for i in range(4) for k in range(3)], "book_id string, path string, doc_pos int, html string")
    shelf = spark.createDataFrame([("b0", "ready", 3, 3), ("b1", "queued", 0, 0), ("b2", "error", 0, 3), ("b9", "building", 1, 2)], "id string, index_state string, index_done int, index_total int")
    store = PageStore(spark, str(tmp_path / "s"))
    store.rebuild(pages(spark, ("b0", "/0.html", "t", "kept"), ("b9", "/0.html", "t", "gone")).withColumn("doc_pos", F.lit(0)))
    after = {r.id: (r.index_state, r.index_done, r.index_total) for r in library.reindex(raw, shelf, store).collect()}
    assert after["b1"] == ("ready", 3, 3) and after["b9"] == ("ready", 0, 0) and after["b0"][0] == "ready"
    assert after["b2"] == ("error", 2, 3)  # a page without html stays out
    assert [x for x in content(store) if x[0] in ("b0", "b9")] == [("b0", "/0.html", "kept")]
    assert len(content(store)) == 1 + 3 + 2
