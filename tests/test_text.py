"""Golden values of the text functions, derived by hand."""

import pytest
from pyspark.sql import functions as F

from folioworks.functions import text as t
from folioworks.operators import extract, search, tree


@pytest.fixture(scope="module")
def one(spark):
    return lambda *e: [x[0] if len(e) == 1 else x for x in [spark.range(1).select(*e).first()]][0]


L = F.lit


@pytest.mark.parametrize("label,key", [("借机攻击", "jjgj"), ("倒地 Prone", "prone"), ("受擒 Grappled", "grappled")])
def test_search_keys_have(one, label, key):
    assert key in one(t.make_search_keys(L(label)))


def test_search_keys_accents(one):
    assert one(t.make_search_keys(L("café"))) == ["café", "caf"]


def test_term_id(one):
    assert one(t.fnv1a_base36(L("a|b"))) == "bgispi"


def test_strip_tags(one):
    assert one(t.strip_tags(L("a<br>b<br/>c</p>d&amp;lt;e"))) == "a\nb c\nd<e"


def test_entities(one):
    assert one(t.decode_entities(L("&#65;&#x42;&#99999999;&nbsp;&apos;"))) == "AB  '"
    assert one(t.decode_entities_once(L("&amp;lt;&copy;&#x41;&unknown;"))) == "&lt;©A&unknown;"


def test_page_body(one):
    assert one(t.page_body(L("<head>x</head><header>y</header>z"))) == " <header>y</header>z"
    assert one(t.page_body(L("<HEAD>x</HEAD><body a=1>y</body>"))) == "y"


@pytest.mark.parametrize("given,path", [("../c.html#x", "/c.html"), ("ms-its:book.chm::/d.htm", "/d.htm"), ("%zz", "/a/%zz"), ("a+b.htm?q", "/a/a+b.htm"), ("mailto:x", None), ("\\a\\..\\b.htm", "/b.htm"), ("", None), ("../../..", "/"), ("%C3%A9", "/a/é")])
def test_normalize_path(one, given, path):
    assert one(t.normalize_path(L("/a/b.html"), L(given))) == path


@pytest.mark.parametrize("raw,lcid,name", [(b"\xef\xbb\xbfa", 0, "utf-8"), (b"<meta charset=gb2312>", 0, "gbk"), ("é".encode(), 0, "utf-8"), ("规则".encode("gbk"), 0x0804, "gbk"), (b"abc", 0, "windows-1252")])
def test_detect_encoding(one, raw, lcid, name):
    assert one(t.detect_encoding(L(bytearray(raw)), L(lcid))) == name


def test_decode(one):
    assert one(t.decode_bytes(L(bytearray("规则".encode("gbk"))), L("gbk"))) == "规则"
    assert one(t.decode_bytes(L(bytearray(b"a\xff")), L("nonsense"))) == "a�"


@pytest.mark.parametrize("raw,kind", [("", "blocked"), ("#x", "fragment"), ("data:image/png;base64,x", "data"), ("https://x", "external"), ("javascript:x", "blocked"), ("vbscript:x", "blocked"), ("c.html#f", "internal")])
def test_ref_info(one, raw, kind):
    assert one(t.ref_info(L("/a/b.html"), L(raw)))["kind"] == kind


@pytest.mark.parametrize("q,score", [("倒地prone", 140), ("prone", 135), ("倒地", 112), ("on", 86), ("zz", 0), (" ", 0)])
def test_score(one, q, score):
    label = L("倒地 Prone")
    assert one(search.score_quick(t.make_search_keys(label), label, q)) == score


@pytest.mark.parametrize("text,q,found", [("xxabyabab", "ab", [2, 5, 7]), ("aaaa", "aa", [0, 2]), ("a.b\\E.c", ".", [1, 5]), ("", "a", []), ("x\\Ey", "\\E", [1])])
def test_positions(one, text, q, found):
    assert one(search.match_positions(L(text), q)) == found


def test_display(one):
    assert one(t.format_bytes(L(37086673))) == "35.4 MiB"
    assert one(t.index_label(L("building"), L(1), L(3))) == "正在构建索引 33%"
    assert one(t.format_ts(L(1700000000000))) == "11/14 22:13" and one(t.format_ts(L(None).cast("bigint"))) == "最近"
    assert one(t.rename(L("  a \n b  c "))) == "a b c" and one(t.rename(L(" "))) is None
    assert one(t.book_title(L(" "), L("x.y.chm"))) == "x.y"
    assert abs(one(t.text_weight(L("A b 规"))) - (0.62 + 0.5 + 1 + 0.56)) < 1e-9


def test_attributes(one):
    assert one(t.attrs_map(L("a=\"1&amp;2\" B='x' a=z"))) == {"a": "z", "b": "x"}
    assert one(t.attr_value(L(" id = 'q' "), "id")) == "q"


def test_css(one):
    assert one(t.clean_css(L("@import url('x'); a{behavior:url(y)}"))) == " a{}"


def test_terms(spark):
    heads = "".join(f"<h2>Heading {i}</h2>" for i in range(45))
    rows = [("b", "/1.html", 1, f"<title>Top</title><body>{heads}<b>nineteen characters</b><dt>{'d' * 37}</dt></body>"), ("b", "/2.html", 2, "<title>Top</title><body><h1 id=x>Top</h1><h3><a name='an'></a>heading 1</h3><h3>Heading 44</h3><b>规则 Rule name here</b></body>")]
    raw = spark.createDataFrame(rows, "book_id string, path string, doc_pos int, html string")
    pages = extract.extract_pages(raw)
    fast, exact = ({(r.path, r.label) for r in extract.extract_terms(pages, exact=e).collect()} for e in (False, True))
    assert sum(p == "/1.html" for p, _ in exact) == 40 and ("/1.html", "Top") in exact
    assert {x for p, x in exact if p == "/2.html"} == {"Heading 44", "规则 Rule name here"}
    assert {x for p, x in fast if p == "/2.html"} == {"规则 Rule name here"}


def test_sitemap(spark):
    text = """<ul><li><object type="text/sitemap"><param name="Name" value="A &amp; B"><param name="Local" value="a.htm"></object>
    <ul><li><object type="text/sitemap"><param name="Name" value="C"><param name="Local" value="c.htm"><param name="Local" value="d.htm"></object></ul></ul>"""
    nodes = tree.parse_sitemap(spark.createDataFrame([("b", "/x/toc.hhc", text)], "book_id string, base string, text string"))
    got = [(r.node_id, r.parent_id, r.depth, r.name, r.local, r.locals) for r in nodes.orderBy("pos").collect()]
    assert got == [(0, None, 0, "A & B", "/x/a.htm", ["/x/a.htm"]), (1, 0, 1, "C", "/x/c.htm", ["/x/c.htm", "/x/d.htm"])]
    assert [r.name for r in tree.flatten_index(nodes).collect()] == ["A & B", "A & B, C"]


def test_tables(spark):
    cell = lambda x: f"<td>{x}</td>"
    html = ["<table><tr>" + cell("a") * 5 + "</tr></table>", "<table><tr>" + cell("a") * 2 + cell("long cell with many words here") * 2 + "</tr></table>", "<table><tr><td>a<td>b</tr></table>", "<table><tr><td colspan=2><table><tr>" + cell("x") * 6 + "</tr></table></td></tr></table>"]
    raw = spark.createDataFrame([("b", f"/{i}", i, h) for i, h in enumerate(html)], "book_id string, path string, doc_pos int, html string")
    got = {r.doc_pos: (r.columns, r.wide, r.labels) for r in extract.profile_tables(raw).collect()}
    assert got == {0: (5, True, False), 1: (4, True, False), 2: (2, False, True), 3: (2, False, True)}


def test_preview(spark):
    html = "<body><h2 id='s'>Start</h2><p>one</p><h3>sub</h3><p>two</p><h2>Next</h2><p>no</p></body>"
    blocks = extract.anchor_blocks(spark.createDataFrame([("b", "/p", html)], "book_id string, path string, html string"))
    asked = spark.createDataFrame([("b", "/p", "s", "Start")], "book_id string, path string, fragment string, label string")
    row = extract.fragment_preview(blocks, asked).first()
    assert (row.title, row.text) == ("Start", "one\n\nsub\n\ntwo")


def test_sanitize():
    assert extract.clean_html('<p onclick="x" class="a">t<script>bad()</script><input>&amp;</p><meta http-equiv="r">') == '<p class="a">t&amp;</p>'
    assert extract.clean_svg("<svg><script/><a href='javascript:x' onload='y'/></svg>") == "<svg><a /></svg>" and extract.clean_svg("<svg") == ""


def test_links_and_scopes(spark):
    raw = spark.createDataFrame([("b", "/d/a.html", 0, "<a href='b.html#f'>B &amp; C</a><img src='i.png'><style>x{background:url(y.png)}</style>"), ("b", "/d/b.html", 1, "")], "book_id string, path string, doc_pos int, html string")
    links = extract.extract_links(raw)
    r = links.first()
    assert (r.kind, r.target_path, r.fragment, r.label) == ("internal", "/d/b.html", "f", "B & C")
    assert search.broken_refs(links, raw).count() == 0
    assert [x.target_path for x in extract.extract_resources(raw).collect()] == ["/d/i.png"]
    assert [x.target_path for x in extract.extract_css_urls(raw).collect()] == ["/d/y.png"]
