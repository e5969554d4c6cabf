"""Queries over whole tables, on small tables."""

import pytest

import __spark_entry__ as entry
from folioworks import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")

    put("region", [(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, "KENYA", 0), (1, "CHINA", 1)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(i, f"Customer#{i}", i % 2) for i in range(1, 8)], "c_custkey long, c_name string, c_nationkey int")
    put("orders", [(1, "F"), (2, "O"), (5, "O")], "o_orderkey long, o_orderstatus string")
    put("lineitem", [(1, 1), (1, 2), (2, 1), (7, 1), (7, 2)], "l_orderkey long, l_linenumber int")
    put("part", [(i, f"B{i % 2}", f"green e{i}", f"KIND {i:03d}") for i in range(60)], "p_partkey long, p_brand string, p_name string, p_type string")
    put("documents", [(1, "Élan vital\nx tion tion", "fr", "src1", 20), (2, "plain tion\ny", "en", "src1", 2048)], "doc_id long, text string, lang string, source string, n_chars long")
    page = lambda i: f"<html><head><title>Page {i}</title></head><body><h1>Page {i}</h1>an an {i}</body></html>"
    put("pages", [(i, f"http://h.example/p{i}.html", page(i)) for i in range(130)], "page_id long, url string, html string")
    return lambda name: entry.queries()[name](spark, d).collect()


def test_scopes_of_all_pages(tables):
    assert {r.path for r in tables("search_scopes_all")} == {f"/customer/{i}.html" for i in range(1, 8)}


def test_quick_search_in_a_node(tables):
    assert [tuple(r) for r in tables("quick_search_in_node")] == [(70, "目录", 3)]


def test_upsert_of_whole_tables(tables):
    assert sorted(map(tuple, tables("upsert_all"))) == [("F", 1, 1), ("O", 2, 2), ("old", 3, 2)]


def test_scalars_of_all_documents(tables):
    got = {r.doc_id: r for r in tables("text_scalars_all")}
    assert got[1].short == "lanvital" and got[2].size == "2.00 KiB" and len(got[1].book_id) > 4


def test_limits_of_the_reference(tables):
    assert len(tables("indexable_all")) == 130
    assert len(tables("keyword_listing_all")) == 60


def test_whole_searches(tables):
    full = [r for r in tables("search_book_all") if r.section == "full"]
    assert len(full) == 180 and len({r.path for r in full}) == 90
    assert len(tables("running_cap_all")) == 0
    got = {(r.kind, r.book_id): r.n for r in sorted(tables("search_library_all"), key=lambda r: r.n)}
    assert got == {("quick", "src1"): 1, ("full", "src1"): 3}


def test_whole_index(tables):
    got = tables("build_index")
    assert len(got) == 130 and all((r.pages, r.terms) == (1, 1) for r in got)


def test_registered_terms_are_exact(monkeypatch):
    asked = {}

    class Any:
        def select(self, *_):
            return self

    monkeypatch.setattr(registry, "_pages", lambda s, d: Any())
    monkeypatch.setattr(registry.extract, "extract_terms", lambda pages, **how: asked.update(how) or Any())
    registry.QUERIES["extract_terms"](None, "")
    assert asked["exact"]
