"""Summaries of books, deletion and library results, on small books."""

import __spark_entry__ as entry
from folioworks.plans import library


def test_landing_pages(spark):
    page = lambda book, path, pos, html="x": (book, path, pos, html)
    raw = [page(b, p, i) for b in ("named", "lost", "contents", "usual", "last") for i, p in enumerate(("/a.png", "/b.html", "/c.html"))]
    raw += [page("usual", "/Default.HTM", 9), page("plain", "/index.html", 2), page("plain", "/z.html", 1), page("pictures", "/a.png", 1), page("empty", "/a.html", 1, "")]
    spine = [(b, 0, "n", "/nowhere.html", 0) for b in ("named", "lost", "contents", "usual", "last")] + [("contents", 1, "n", "/C.html", 0)]
    got = library.book_summary(
        spark.createDataFrame(raw, "book_id string, path string, doc_pos long, html string"),
        spark.createDataFrame(spine, "book_id string, pos long, name string, local string, depth int"),
        spark.createDataFrame([("named", "./c.html"), ("lost", "no.html"), ("none", "a.html")], "book_id string, path string"),
    )
    rows = {r.book_id: (r.landing, r.docs, r.spine_length) for r in got.collect()}
    # a book without contents starts with its first page, whatever its name
    assert rows == {"named": ("/c.html", 2, 1), "lost": ("/b.html", 2, 1), "contents": ("/C.html", 2, 2), "usual": ("/Default.HTM", 3, 1), "last": ("/b.html", 2, 1), "plain": ("/z.html", 2, 2), "pictures": (None, 0, 0), "empty": (None, 0, 0)}


def test_deleted_books_lose_all(spark, tmp_path):
    docs = [(1, "tion", "en", "src5", 4), (2, "a", "fr", "src5", 1), (3, None, None, "src6", 0), (4, "b", "en", "src1", 1), (5, "b", "en", "src1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.kind, r.book_id, r["item"]) for r in entry.queries()["delete_whole_books"](spark, str(tmp_path)).collect()}
    assert {b for _, b, _ in rows} == {"src5"} and len(rows) == 1 + 2 + 2 + 2
