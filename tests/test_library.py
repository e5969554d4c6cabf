"""Tables, activity and streams on small rows, and properties."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioworks.operators import activity, extract, search
from folioworks.plans import library
from folioworks.sources import books
from folioworks.streaming import jobs


def test_entry_registers():
    assert len(entry.queries()) >= 40 and set(entry.oracle_sql()) <= set(entry.queries())


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("b", "/1", "x"), ("b", "/2", "x")], "book_id string, path string, text string")
    new = spark.createDataFrame([("b", "/2", "y", 1), ("b", "/2", "z", 2), ("c", "/1", "n", 1)], "book_id string, path string, text string, k int")
    once = books.upsert(old, new, books.PAGE_KEYS, ["k"])
    assert sorted(map(tuple, once.collect())) == [("b", "/1", "x"), ("b", "/2", "z"), ("c", "/1", "n")]
    assert sorted(map(tuple, books.upsert(once, new, books.PAGE_KEYS, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_page_files(spark, tmp_path):
    (tmp_path / "lib" / "bk" / "sub").mkdir(parents=True)
    (tmp_path / "lib" / "bk" / "sub" / "a.html").write_bytes(b"<p>x</p>")
    r = books.read_page_files(spark, str(tmp_path / "lib")).first()
    assert (r.book_id, r.path, bytes(r.content)) == ("bk", "/sub/a.html", b"<p>x</p>")
    pages = spark.createDataFrame([("b", "/1", "t")], "book_id string, path string, title string")
    books.write_pages(pages, str(tmp_path / "pages"))
    assert books.read_pages(spark, str(tmp_path / "pages")).count() == 1


def test_shelf(spark):
    shelf = spark.createDataFrame([("a", "Own", True, 1, 5, 7), ("b", "B", False, 1, 9, 0)], "id string, title string, custom_title boolean, size int, added_at int, last_opened int")
    opened = spark.createDataFrame([("a", "File", 2), ("c", "C", 3)], "id string, title string, size int")
    got = {r.id: (r.title, r.size, r.last_opened) for r in books.save_to_shelf(shelf, opened, 100).collect()}
    assert got == {"a": ("Own", 2, 100), "b": ("B", 1, 0), "c": ("C", 3, 100)}
    assert [r.id for r in books.list_books(shelf).collect()] == ["b", "a"]
    patched = books.patch_books(shelf, spark.createDataFrame([("a", 3, 1), ("a", None, 2), ("zz", 1, 1)], "id string, size int, seq int"))
    assert {r.id: r.size for r in patched.collect()} == {"a": 3, "b": 1}
    assert {r.id: r.title for r in books.rename_book(shelf, "b", " New ").collect()} == {"a": "Own", "b": "New"}


def acts(spark, rows):
    return spark.createDataFrame([("r", i, i, k, p, None) for i, (k, p) in enumerate(rows)], "reader_id string, seq long, ts long, kind string, path string, title string")


def test_bookmark_cap(spark):
    rows = [("toggle", f"/{i}") for i in range(121)] + [("toggle", "/0")]
    got = [r.path for r in activity.bookmarks(acts(spark, rows)).orderBy("n").collect()]
    assert len(got) == 120 and got[0] == "/0" and "/1" not in got


def test_history(spark):
    moves = acts(spark, [("visit", "/a"), ("visit", "/A"), ("visit", "/b"), ("visit", "/c"), ("back", None), ("back", None), ("forward", None), ("visit", "/d")])
    assert [(r.path, r.current) for r in activity.history_stack(moves).orderBy("n").collect()] == [("/a", False), ("/b", False), ("/d", True)]
    assert activity.history_pushes(moves.filter("kind = 'visit'")).count() == 4


def plain_marks(rows, most):
    marks = []
    for path in rows:
        if path.lower() in [m.lower() for m in marks]:
            marks = [m for m in marks if m.lower() != path.lower()]
        else:
            marks = [path, *marks][:most]
    return marks


def plain_stack(rows):
    stack, at = [], -1
    for kind, path in rows:
        if kind == "visit" and path is not None and (at < 0 or stack[at].lower() != path.lower()):
            stack = [*stack[: at + 1], path]
            at += 1
        elif kind in ("back", "forward"):
            to = at + (1 if kind == "forward" else -1)
            at = to if 0 <= to < len(stack) else at
    return [(p, i == at) for i, p in enumerate(stack)]


def test_folds_of_many_readers(spark):
    """Random readers, one of whom is null and one has most rows, against plain folds."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3, 3, 3, 3, 3]), i, i // 3, rng.choice(["toggle", "visit", "visit", "back", "forward"]), rng.choice([None, *[f"/{x}{k}" for k in range(9) for x in "aA"]]), None) for i in range(3000)]
    data = spark.createDataFrame(rows, "reader_id long, seq long, ts long, kind string, path string, title string").repartition(5)
    for most in (4, 9, 120):
        got = activity.bookmarks(data.filter("kind = 'toggle'"), most).orderBy("n").collect()
        for r in (None, 1, 2, 3):
            want = plain_marks([x[4] for x in rows if x[0] == r and x[3] == "toggle" and x[4] is not None], most)
            assert [x.path for x in got if x.reader_id == r] == want
    got = activity.history_stack(data).orderBy("n").collect()
    for r in (None, 1, 2, 3):
        assert [(x.path, x.current) for x in got if x.reader_id == r] == plain_stack([(x[3], x[4]) for x in rows if x[0] == r])
    assert activity.bookmarks(data.filter("false")).count() == activity.history_stack(data.filter("false")).count() == 0


def test_exact_cap_of_terms(spark):
    """A label cut off on a full page goes to a later page: against a plain loop."""
    rng = random.Random(6)
    rows = [(f"b{k}", f"/{p}", p, 1 if m else 0, m, rng.choice("xX") + str(rng.randrange(40)), "", "s") for k in range(3) for p in range(12) for m in range(rng.randrange(12))]
    data = spark.createDataFrame(rows, "book_id string, path string, doc_pos int, pattern_no int, match_pos int, label string, anchor string, source string").repartition(4)
    for most in (2, 5, 40):
        want, seen, count = [], set(), {}
        for r in rows:
            key, page = (r[0], r[5].lower()), (r[0], r[2])
            if key not in seen and (count.get(page, 0) < most or r[3] == 0):
                seen.add(key)
                count[page] = count.get(page, 0) + 1
                want.append(r)
        assert sorted(map(tuple, extract.cap_terms(data, most, exact=True).select(*data.columns).collect())) == sorted(want)


@pytest.mark.parametrize("bad", ["[", "{}", "", None, "7"])
def test_lists_read_as_empty(spark, bad):
    assert activity.lists_from_json(spark.createDataFrame([(bad,)], "json string")).first()["items"] == []


def test_positions_agree_with_find(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("ab", k=30)), i) for i in range(40)]
    for q in ("a", "ab", "aba"):
        for r in spark.createDataFrame(rows, "x string, i int").select("x", search.match_positions(F.col("x"), q).alias("p"), search.occurrence_count("x", q).alias("n")).collect():
            want, at = [], r.x.find(q)
            while at >= 0:
                want.append(at)
                at = r.x.find(q, at + len(q))
            assert r.p == want and r.n == len(want)


def test_batch_search_both_ways(spark):
    rng = random.Random(2)
    pages = spark.createDataFrame([("b", f"/{i}", "".join(rng.choices("abc ", k=200))) for i in range(30)], "book_id string, path string, text string")
    rows = [(str(i), "".join(rng.choices("abc", k=rng.choice([2, 3, 4, 6])))) for i in range(12)]
    texts = [r.text for r in pages.collect()]
    rows += [(f"w{i}", texts[i][20 + i : 45 + 2 * i].upper()) for i in range(30)]  # with starts of words inside
    queries = spark.createDataFrame(rows, "query_id string, q string")
    one, two = (sorted(map(tuple, search.batch_search(pages, queries, few=n).collect())) for n in (64, 4))
    assert one == two and one
    search.BROADCAST_PAIRS, most = 0, search.BROADCAST_PAIRS
    try:
        assert sorted(map(tuple, search.batch_search(pages, queries, few=4).collect())) == one
    finally:
        search.BROADCAST_PAIRS = most


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    for part in range(4):
        rows = [(rng.randrange(5), part * 50 + i, rng.choice(["done", "error", "progress"]), i, 50) for i in range(50)]
        spark.createDataFrame(rows, "book_id long, seq long, type string, done long, total long").coalesce(1).write.mode("append").parquet(str(tmp_path / "s.parquet"))
    batch = spark.read.parquet(str(tmp_path / "s.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path), "s", 1)
    assert sorted(map(tuple, jobs.latest_status(stream).collect())) == sorted(map(tuple, activity.latest_status(batch).collect()))


def test_stream_goes_on_in_its_folder(spark, tmp_path):
    """Stopped and run again with more files, and a batch put twice: as if all had come at once."""
    rng = random.Random(4)
    home, src = str(tmp_path / "job"), str(tmp_path / "p.parquet")
    page = lambda i: f"<html><title>Page {rng.randrange(9)}</title><body>" + "".join(f"<h2>Term {rng.randrange(60)}</h2>" for _ in range(50)) + f"text {i}</body></html>"
    add = lambda rows: spark.createDataFrame(rows, "book_id string, path string, doc_pos long, html string").coalesce(1).write.mode("append").parquet(src)
    rows = {}
    for turn in range(2):
        for k in range(3):
            new = [(f"b{i % 2}", f"/{i}", i, page(i)) for i in range(10 * turn + k, 10 * turn + 12, 2)]
            add(new)
            rows |= {(r[0], r[1]): r for r in new}
        pages, terms = jobs.incremental_index(jobs.table_stream(spark, str(tmp_path), "p", 2), home)
        want_pages, want_terms = library.build_index(spark.createDataFrame(list(rows.values()), "book_id string, path string, doc_pos long, html string"), exact=True)
        assert sorted(map(tuple, pages.select(*want_pages.columns).collect())) == sorted(map(tuple, want_pages.collect()))
        flat = lambda x: sorted(map(str, x.select(*want_terms.columns).collect()))
        assert flat(terms) == flat(want_terms) and terms.count() == terms.select("book_id", F.lower("label")).distinct().count()
    table = jobs.Changes(pages, f"{home}/pages", ["book_id", "path"], ["doc_pos"])
    table.put(pages, 99)
    table.put(pages, 99)
    assert table.read().drop("version").exceptAll(pages).isEmpty() and table.read().count() == pages.count()


def test_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], "book_id long, seq long, type string, done long, total long").write.parquet(str(tmp_path / "s.parquet"))
    assert jobs.latest_status(jobs.table_stream(spark, str(tmp_path), "s"), str(tmp_path / "job")).count() == 0
