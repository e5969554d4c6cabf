"""From pages to titles, texts, terms, links, tables and previews."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tables
from ..functions import text as t
from ..sources.storage import stored
from . import folds
from .page_tree import fragment_preview, fragment_target, page_nodes, profile_tables  # noqa: F401  extraction too

anchor_blocks = page_nodes
HEAD = r"(?is)<(h[1-6])\b([^>]*)>(.*?)</\1>"
STRONG = r"(?is)<(strong|b|dt)\b([^>]*)>(.*?)</\1>"


def indexable(raw: DataFrame, most: int = 20_000, size: int = 16 << 20) -> DataFrame:
    """The first pages of each book that are pages and not too long. Only keys are ranked."""
    ok = raw.filter(t.is_page("path", F.coalesce("length", F.lit(1))))
    w = Window.partitionBy("book_id").orderBy("doc_pos")
    keys = ok.select("book_id", "path", "doc_pos").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    return ok.join(keys, ["book_id", "path", "doc_pos"], "left_semi").filter(F.coalesce("length", F.lit(1)) <= size)


def decoded(raw: DataFrame, book_encoding: Column | None = None) -> DataFrame:
    """raw with html decoded from content."""
    enc = t.detect_encoding("content", "lcid" if "lcid" in raw.columns else None)
    return raw.withColumn("encoding", enc if book_encoding is None else t.active_encoding("content", book_encoding)).withColumn("html", t.decode_bytes(F.col("content"), F.col("encoding"))).drop("content")


def extract_pages(raw: DataFrame) -> DataFrame:
    """book_id, path, doc_pos, title, text, body of pages (book_id, path, doc_pos, html); null html is left to quarantine()."""
    ok = raw.filter("html is not null")
    return ok.select("book_id", "path", "doc_pos", t.page_title("html", "path").alias("title"), t.page_text("html").alias("text"), t.page_body("html").alias("body"))


def quarantine(raw: DataFrame) -> DataFrame:
    return raw.filter("html is null").select("book_id", "path", F.lit("no text").alias("reason"))


#: Pages of more bytes are not indexed.
LARGEST = 16 << 20


def checked_pages(raw: DataFrame, size: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """(pages, failed) of raw pages (book_id, path, doc_pos, content[, length, lcid]), decoded and split in one stored pass.

    pages has book_id, path, doc_pos, encoding, title, text, body. failed has book_id, path, doc_pos, indexed and
    reason: `no content` and `too long` are not indexed; `unknown label` (a charset that no table has; another
    encoding was taken) and `replacement characters` (bytes that are none in the encoding) are, and are in both.
    """
    length = F.coalesce("length", F.octet_length("content")) if "length" in raw.columns else F.octet_length("content")
    label = t.charset_label("content")
    lost = F.when(F.col("content").isNull(), "no content").when(length > size, "too long")
    kept = ["book_id", "path", "doc_pos", *[x for x in ("lcid",) if x in raw.columns]]
    # what is not indexed is not decoded either
    some = raw.select(*kept, lost.alias("_lost"), F.when(lost.isNull(), F.col("content")).alias("content")).withColumn("_unknown", (label != "") & t.charset_alias(label).isNull())
    html = decoded(some)
    reason = F.coalesce("_lost", F.when(F.col("_unknown"), "unknown label"), F.when(F.col("html").contains("\ufffd"), "replacement characters"))
    whole = stored(html.select("book_id", "path", "doc_pos", "encoding", t.page_title("html", "path").alias("title"), t.page_text("html").alias("text"), t.page_body("html").alias("body"), F.col("_lost").isNull().alias("indexed"), reason.alias("reason")))
    return whole.filter("indexed").drop("indexed", "reason"), whole.filter("reason is not null").select("book_id", "path", "doc_pos", "indexed", "reason")


def _anchor(attrs: Column, inner: Column) -> Column:
    first = F.regexp_extract(inner, r"(?i)<a\b([^>]*)>", 1)
    return t._first(t.attr_value(attrs, "id"), t.attr_value(attrs, "name"), t.attr_value(first, "id"), t.attr_value(first, "name"))


def term_candidates(pages: DataFrame) -> DataFrame:
    """book_id, path, doc_pos, pattern_no, match_pos, label, anchor, source of pages (with title and body)."""

    def of(pattern: str, number: int) -> DataFrame:
        groups = [F.regexp_extract_all("body", F.lit(pattern), i).alias(n) for i, n in ((1, "tag"), (2, "attrs"), (3, "inner"))]
        each = pages.select("book_id", "path", "doc_pos", F.posexplode(F.arrays_zip(*groups)).alias("match_pos", "m"))
        return each.select("book_id", "path", "doc_pos", F.lit(number).alias("pattern_no"), "match_pos", F.lower("m.tag").alias("tag"), t.collapse(t.strip_tags(F.col("m.inner"))).alias("label"), _anchor(F.col("m.attrs"), F.col("m.inner")).alias("anchor"), F.lit("正文术语").alias("source"))

    title = pages.filter("title != ''").select("book_id", "path", "doc_pos", F.lit(0).alias("pattern_no"), F.lit(0).alias("match_pos"), F.lit("h1").alias("tag"), t.collapse(t.strip_tags("title")).alias("label"), F.lit("").alias("anchor"), F.lit("页面标题").alias("source"))
    rows = title.unionByName(of(HEAD, 1)).unionByName(of(STRONG, 2))
    n = F.length("label")
    stops = F.size(F.regexp_extract_all("label", F.lit("([。！？!?；;])"), 1))
    both = F.col("label").rlike(t.HAN) & F.col("label").rlike("[A-Za-z]")
    head, dt = F.col("tag").startswith("h"), F.col("tag") == "dt"
    return rows.filter(n.between(2, 70) & (stops <= 1) & (head | dt | both | (n <= 18)) & (~dt | (n <= 36))).drop("tag")


def dedupe_terms(candidates: DataFrame) -> DataFrame:
    """A label once per book: first page, first pattern, first place."""
    w = Window.partitionBy("book_id", F.lower("label")).orderBy("doc_pos", "pattern_no", "match_pos", "path")
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


class _Terms(folds.Fold):
    def __init__(self, most: int):
        self.most, self.seen, self.page, self.count = most, set(), None, 0

    def step(self, row):
        page, label = (row["doc_pos"], row["path"]), row["_l"]
        if page != self.page:
            self.page, self.count = page, 0
        if label not in self.seen and (self.count < self.most or row["pattern_no"] == 0):
            self.seen.add(label)
            self.count += 1
            yield row


def cap_terms(candidates: DataFrame, most: int = 40, exact: bool = False) -> DataFrame:
    """At most 40 terms of a page. exact: in page order, a label cut off on one page stays free for a later one.

    For books whose pages all stay below the cap both forms agree, so the exact one folds
    only books that have a page over it, and stores the candidates, which it reads three times.
    A fold's state is the labels that its book has got: at most 40 for each of the 20,000
    pages that a book is indexed by.
    """
    candidates = stored(candidates) if exact else candidates
    w = Window.partitionBy("book_id", "path", "doc_pos").orderBy("pattern_no", "match_pos")
    fast = dedupe_terms(candidates).withColumn("_n", F.row_number().over(w))
    if not exact:
        return fast.filter(F.col("_n") <= most).drop("_n")
    over = stored(fast.filter(F.col("_n") > most).select("book_id").distinct())
    if over.isEmpty():
        return fast.drop("_n")
    rest = fast.join(over, "book_id", "left_anti").drop("_n")
    return rest.unionByName(folds.fold_by_key(candidates.join(over, "book_id", "left_semi").withColumn("_l", F.lower("label")), "book_id", ["doc_pos", "path", "pattern_no", "match_pos"], lambda: _Terms(most), candidates.schema))


def term_records(rows: DataFrame) -> DataFrame:
    """Term rows from (book_id, label, path, anchor, source[, search_text]); those without a label or path go."""
    label = t.collapse(F.coalesce("label", F.lit("")))
    x = rows.withColumn("_t", label).filter("_t != '' and coalesce(path, '') != ''")
    anchor = F.coalesce("anchor", F.lit(""))
    text = F.coalesce(F.nullif(F.col("search_text"), F.lit("")), F.col("_t")) if "search_text" in rows.columns else F.col("_t")
    return x.select("book_id", t.fnv1a_base36(F.concat_ws("|", "path", anchor, "source", "_t")).alias("term_id"), F.substring("_t", 1, 220).alias("label"), "path", anchor.alias("anchor"), "source", t.make_search_keys("_t").alias("keys"), text.alias("search_text"))


def extract_terms(pages: DataFrame, most: int = 40, exact: bool = False) -> DataFrame:
    return term_records(cap_terms(term_candidates(pages), most, exact))


def seed_terms(spine: DataFrame, index: DataFrame) -> DataFrame:
    """Terms of contents, then of the keyword index (first target); one for each path and label."""
    a = spine.select("book_id", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("local")).alias("label"), F.col("local").alias("path"), F.lit("目录").alias("source"), F.lit(0).alias("_s"), F.col("pos").cast("long").alias("_p"))
    b = index.select("book_id", F.col("name").alias("label"), F.get("targets", F.lit(0)).alias("path"), F.lit("索引").alias("source"), F.lit(1).alias("_s"), F.col("pos").cast("long").alias("_p"))
    rows = a.unionByName(b).withColumn("label", t.collapse(F.coalesce("label", F.lit("")))).filter("label != '' and coalesce(path, '') != ''")
    w = Window.partitionBy("book_id", F.lower("path"), F.lower(F.substring("label", 1, 220))).orderBy("_s", "_p")
    return term_records(rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("book_id", "label", "path", "source", F.lit("").alias("anchor")))


def _refs(rows: DataFrame, base: str = "path") -> DataFrame:
    ref = t.ref_info(F.col(base), F.col("raw"))
    return rows.withColumn("r", ref).select(*[c for c in rows.columns if c != "raw"], "r.kind", F.col("r.path").alias("target_path"), "r.fragment", "r.url")


def extract_links(pages: DataFrame) -> DataFrame:
    """book_id, path, doc_pos, link_pos, label, kind, target_path, fragment, url of every a[href] and area[href]."""
    pattern = r"(?is)<(a|area)\b([^>]*\bhref\s*=[^>]*)>(?:(.*?)</a>)?"
    groups = [F.regexp_extract_all("html", F.lit(pattern), i).alias(n) for i, n in ((1, "tag"), (2, "attrs"), (3, "inner"))]
    each = pages.select("book_id", "path", "doc_pos", F.posexplode(F.arrays_zip(*groups)).alias("link_pos", "m"))
    label = F.substring(t.clean_text(t.decode_entities(F.regexp_replace("m.inner", "<[^>]+>", ""))), 1, 220)
    return _refs(each.select("book_id", "path", "doc_pos", "link_pos", label.alias("label"), t.decode_entities(t.attr_value("m.attrs", "href")).alias("raw")))


def extract_resources(pages: DataFrame) -> DataFrame:
    """References to images, media, backgrounds and style sheets."""
    out = None
    for element, attr in [*tables.RESOURCES, ("link", "href")]:
        pattern = rf"(?is)<{element}\b([^>]*)>"
        each = pages.select("book_id", "path", "doc_pos", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("place", "attrs")).filter(F.col("attrs").rlike(rf"(?i)(?:^|\s){attr}\s*="))
        if element == "link":
            each = each.filter(F.array_contains(F.split(F.lower(t.attr_value("attrs", "rel")), r"\s+"), "stylesheet"))
        rows = each.select("book_id", "path", "doc_pos", F.lit(element).alias("element"), F.lit(attr).alias("attribute"), "place", t.decode_entities(t.attr_value("attrs", attr)).alias("raw"))
        out = rows if out is None else out.unionByName(rows)
    return _refs(out)


def extract_css_urls(pages: DataFrame) -> DataFrame:
    """url(...) targets in style tags and style attributes."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), 1)
    attrs = F.concat(F.regexp_extract_all("html", F.lit(r"(?is)<[^>]*\bstyle\s*=\s*\"([^\"]*)\""), 1), F.regexp_extract_all("html", F.lit(r"(?is)<[^>]*\bstyle\s*=\s*'([^']*)'"), 1))
    css = t.clean_css(F.array_join(F.concat(tags, attrs), "\n"))
    pattern = r"(?i)url\(\s*(\"[^\"]*\"|'[^']*'|[^)'\"\s][^)]*?)\s*\)"
    each = pages.select("book_id", "path", "doc_pos", F.posexplode(F.regexp_extract_all(css, F.lit(pattern), 1)).alias("place", "m"))
    return _refs(each.select("book_id", "path", "doc_pos", "place", t.trim(F.regexp_replace("m", "^[\"']|[\"']$", "")).alias("raw")))


# --- parsers: nesting needs one ------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag, attrs, closed=False):
        if tag in tables.ACTIVE_ELEMENTS:
            if tag not in _VOID and not closed and tag != "frame":
                self.skip.append(tag)
            return
        if self.skip or tag == "meta" and any(k == "http-equiv" for k, _ in attrs):
            return
        kept = "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in attrs if not k.startswith("on") and k not in tables.ACTIVE_ATTRIBUTES)
        self.out.append(f"<{tag}{kept}>")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag not in tables.ACTIVE_ELEMENTS:
            self.out.append(f"</{tag}>")

    def add(self, text):
        if not self.skip:
            self.out.append(text)

    def handle_data(self, data):
        self.add(data)

    def handle_entityref(self, name):
        self.add(f"&{name};")

    def handle_charref(self, name):
        self.add(f"&#{name};")

    def handle_decl(self, decl):
        self.add(f"<!{decl}>")


def clean_html(html: str) -> str:
    p = _Cleaner()
    p.feed(html)
    p.close()
    return "".join(p.out)


@F.pandas_udf(T.StringType())
def sanitize_html(html: pd.Series) -> pd.Series:
    """Pages without active elements and attributes."""
    return pd.Series([None if h is None else clean_html(h) for h in html], dtype=object)


def clean_svg(svg: str) -> str:
    if "<!DOCTYPE" in svg.upper():  # entities of a document type are never expanded
        return ""
    try:
        root = ET.fromstring(svg)
    except ET.ParseError:
        return ""
    local = lambda name: name.rsplit("}", 1)[-1]
    for parent in list(root.iter()):
        for child in list(parent):
            if local(child.tag).lower() in ("script", "foreignobject", "iframe", "object", "embed"):
                parent.remove(child)
    for e in root.iter():
        for k, v in list(e.attrib.items()):
            if local(k).lower().startswith("on") or local(k).lower() == "href" and not v.strip().startswith("#") and not re.match("data:image/", v.strip(), re.I):
                del e.attrib[k]
    return ET.tostring(root, encoding="unicode")


@F.pandas_udf(T.StringType())
def sanitize_svg(svg: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else clean_svg(s) for s in svg], dtype=object)


def page_preview(pages: DataFrame, most: int = 1600) -> DataFrame:
    return pages.select("book_id", "path", "title", t._first(F.substring(t.clean_text("text"), 1, most), F.lit("此页没有可预览的正文。")).alias("preview"))
