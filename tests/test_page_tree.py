"""Tables and previews against plain walks over trees that another parser has made."""

import random
import re
import time
import xml.etree.ElementTree as ET

import pytest

from folioworks.operators import page_tree as pt

HEADINGS = pt.HEADINGS


def clean(x):
    x = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", x.replace("\xa0", " ")))
    return re.sub(r"[ \t]{2,}", " ", x).strip()


def compact(x):
    return re.sub(r"[^a-z0-9㐀-鿿]+", "", x.lower())


def full(e):
    return "".join(e.itertext())


class Tree:
    def __init__(self, markup):
        self.root = ET.fromstring(markup)
        self.up = {c: p for p in self.root.iter() for c in p}

    def heading(self, e):
        while e is not None and e.tag not in HEADINGS:
            e = self.up.get(e)
        return e

    def after(self, e):
        own = list(self.up[e]) if e in self.up else [e]
        return own[own.index(e) + 1 :]

    def shown(self, e):
        h = self.heading(e)
        if h is not None:
            return h
        if clean(full(e)):
            return e
        return next((x for x in self.after(e) if clean(full(x))), self.up.get(e, e))

    def target(self, fragment, label):
        hits = [e for e in self.root.iter() if fragment in (e.get("id"), e.get("name"))]
        if len(hits) < 2 or not compact(label):
            return hits[0] if hits else None
        best, top = hits[0], -1
        for e in hits:
            own, want, score = compact(full(self.shown(e))), compact(label), 0
            if own and own in want:
                score = 10000 + len(own)
            elif own and want in own:
                score = 9000 + len(want)
            elif own:
                score = sum(a == b for a, b in zip(own, want, strict=False))
            if score > top:
                best, top = e, score
        return best

    def preview(self, fragment, label, most):
        hit = self.target(fragment, label)
        if hit is None:
            return None
        e = self.shown(hit)
        level, parts, total = (int(e.tag[1]) if e.tag in HEADINGS else 0), [], 0
        for x in self.after(e):
            rank = int(x.tag[1]) if x.tag in HEADINGS else 0
            if total >= most or rank and level and rank <= level:
                break
            if clean(full(x)):
                parts.append(clean(full(x)))
                total += len(parts[-1])
        title = next((full(x) for x in self.root.iter("title")), "")
        return clean(full(e)) or clean(label) or clean(title) or "规则预览", "\n\n".join(parts)[:most]


def weight(x):
    return sum(0.28 if c.isspace() else 1 if "㐀" <= c <= "鿿" else 0.62 if re.match("[A-Z0-9]", c) else 0.5 for c in clean(x))


def tables(markup):
    tree, out = Tree(markup), []
    for e in tree.root.iter("table"):
        up = tree.up.get(e)
        while up is not None and up.tag != "table":
            up = tree.up.get(up)
        if up is None:
            rows = [r for x in e for r in ([x] if x.tag == "tr" else x if x.tag in pt.SECTIONS else []) if r.tag == "tr"]
            columns = max((sum(max(1, int(c.get("colspan", 1))) for c in r) for r in rows[:12]), default=0)
            w = [weight(full(c)) for c in e.iter() if c.tag in ("td", "th")]
            counts = [sum(x > k for x in w) for k in (9, 12, 24)]
            wide = columns >= 5 or columns >= 4 and counts[0] >= 2
            out.append((len(out), columns, *counts, wide, 2 <= columns <= 3 and not wide))
    return out


def words(rng):
    return rng.choice(["", "", " ", "a", "Rule 3", "many words of text here", "\n\n", "B  c\n", "规则 x", "x" * 40, "\xa0"])


def block(rng, depth):
    tag = rng.choice(["div", "span", "h2", "h3", "b", "i", "section"] if depth else ["span"])
    if tag in HEADINGS or tag in ("b", "i", "span"):
        inner = words(rng) + (f"<a name='n{rng.randrange(4)}'></a>" if rng.random() < 0.2 else "") + words(rng)
    else:
        inner = words(rng).join(block(rng, depth - 1) for _ in range(rng.randrange(5)))
    return f"<{tag}" + (f" id='n{rng.randrange(6)}'" if rng.random() < 0.5 else "") + f">{inner}</{tag}>"


def cells(rng, depth):
    inner = lambda: cells(rng, depth - 1) if depth and rng.random() < 0.2 else words(rng) + "<b>" + words(rng) + "</b>"
    row = lambda: "<tr>" + "".join(f"<td colspan='{rng.randrange(4)}'>{inner()}</td>" if rng.random() < 0.3 else f"<th>{inner()}</th>" for _ in range(rng.randrange(5))) + "</tr>"
    return "<table>" + "".join(f"<tbody>{row()}{row()}</tbody>" if rng.random() < 0.3 else row() for _ in range(rng.randrange(8))) + "</table>"


@pytest.mark.parametrize("most", [30, 1800])
def test_previews(spark, most):
    rng = random.Random(most)
    pages = {f"/{i}": "<body>" + ("<title>T</title>" if i % 3 else "") + "".join(block(rng, 3) for _ in range(8)) + "</body>" for i in range(30)}
    asked = [(p, f"n{k}", label) for p in pages for k in range(7) for label in ("", "many", "Rule 3 a", "many words of text here B c")]
    nodes = pt.page_nodes(spark.createDataFrame([("b", p, h) for p, h in pages.items()], "book_id string, path string, html string").repartition(3))
    got = pt.fragment_preview(nodes, spark.createDataFrame([("b", *a) for a in asked], "book_id string, path string, fragment string, label string"), most)
    trees = {p: Tree(h) for p, h in pages.items()}
    want = {a: x for a in asked if (x := trees[a[0]].preview(a[1], a[2], most))}
    assert {(r.path, r.fragment, r.label): (r.title, r.text) for r in got.collect()} == want and len(want) > 300


def test_tables(spark):
    rng = random.Random(1)
    pages = ["<body>" + "".join(f"<p>{words(rng)}</p>" + cells(rng, 2) for _ in range(rng.randrange(4))) + "</body>" for _ in range(60)]
    raw = spark.createDataFrame([("b", "/same", i, h) for i, h in enumerate(pages)], "book_id string, path string, doc_pos int, html string").repartition(3)
    got = pt.profile_tables(raw).select("doc_pos", "table_no", "columns", "long_cells", "very_long", "xlong", "wide", "labels").collect()
    assert sorted(map(tuple, got)) == sorted((i, *x) for i, h in enumerate(pages) for x in tables(h))


def test_what_is_not_closed(spark):
    html = "<table><tr><td>a<td>b<td><table><tr><td>in</table><td>c</div><tr><td>x</table><p id=q>one<p>two<ul><li id=r>l1<li>l2</ul><h2 id=s>s<h3>t</h3><script>no <p id=u>x</p></script>"
    rows = pt.number_page(html)
    text = lambda i: "".join(r[10] for r in rows if r[10] and rows[i][0] < r[0] <= rows[i][1])
    assert [(r[3], text(r[0])) for r in rows if r[3] in ("td", "p", "li", "h2", "h3")] == [("td", "a"), ("td", "b"), ("td", "in"), ("td", "in"), ("td", "c"), ("td", "x"), ("p", "one"), ("p", "two"), ("li", "l1"), ("li", "l2"), ("h2", "s"), ("h3", "t")]
    raw = spark.createDataFrame([("b", "/p", 1, html)], "book_id string, path string, doc_pos int, html string")
    assert [(r.table_no, r.columns, r.labels) for r in pt.profile_tables(raw).collect()] == [(0, 4, False)]


@pytest.mark.parametrize("html", ["<div>" * 180_000 + "x", "<table><tr><td>" * 60_000 + "y", "<a name=x>" * 90_000, "<p>t" * 250_000, "<li>" * 250_000, "</b>" * 250_000, "<div id=a>" * 5 + "<ul>" + "<li>z</p>" * 100_000, "text " * 200_000, "<h2><b>" * 130_000])
def test_a_megabyte_takes_linear_time(html):
    began = time.time()
    rows = pt.number_page(html)
    small = time.time() - began
    assert small < 30 and len(rows) <= 2 * html.count("<") + len(html) // pt.PIECE + 1


def test_deep_pages_and_no_pages(spark):
    deep = "<table><tr><td>" * 5000 + "some text of the innermost cell" + "</td></tr></table>" * 5000 + "<div id=q>" * 3000 + "<p>end</p>"
    raw = spark.createDataFrame([("b", "/d", 1, deep), ("b", "/n", 2, None), ("b", "/e", 3, "")], "book_id string, path string, doc_pos int, html string")
    assert [(r.columns, r.long_cells, r.xlong) for r in pt.profile_tables(raw).collect()] == [(1, 5000, 0)]
    asked = spark.createDataFrame([("b", "/d", "q", None), ("b", "/d", "none", ""), ("b", "/n", "q", "x")], "book_id string, path string, fragment string, label string")
    assert [(r.title, r.text) for r in pt.fragment_preview(pt.page_nodes(raw), asked).collect()] == [("end", "")]
    none = raw.filter("false")
    assert pt.profile_tables(none).count() == 0 and pt.fragment_preview(pt.page_nodes(none), asked).count() == 0
    assert pt.fragment_target(pt.page_nodes(raw), asked.filter("path = '/d'")).first().score == 0
    assert pt.anchors_of(pt.page_nodes(raw)).count() == 1
