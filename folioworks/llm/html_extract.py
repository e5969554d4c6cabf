"""Main text of web pages by equivalence classes of template tokens.

A token is an element with its path of named ancestors (digits in names read as one), or
the k-th occurrence of a word in a page's elements of one path. Over the pages of a host, each
token has an occurrence vector: how often each page has it. Tokens of equal vectors form
an equivalence class. A class is valid if it has several tokens, or is the page root's
(once on every page), and most pages of the host have it; a word whose place among those
of its class differs from page to page leaves it, so that what is left is in order. The
root's class cuts a page into slots; the words of another class count where two or more
lie in one slot, nested there. A block of text is template if
these words cover it; headings and paragraphs inside an article or main
element are the author's own and never template. Every other block is kept, in page
order, wherever it lies, if it is not in an element made for something else: one such by
its element (nav, footer, script and so on), or outside articles by a class, id or role
of which every word says so. Such a name is a hint only: it does not count where it
encloses the page's own article, main element or first heading. A form is made for something
else too, unless it holds all articles, main elements and first headings of the page, or
over half of its text and more than its fields need: some sites wrap whole pages in one.

A host of fewer pages than `LEAST_PAGES` shows no template: there a page gives its own
main element, else the innermost element that holds all its articles and what its first
headings stand in, else its body. A page of which nothing would be left is a copy of most others of its
host, and is kept.

Scale: vectors are kept as sums of hashed pages, so a token's statistics are one row per
host and token however many pages there are, summed in tasks before the shuffle. The
template (one row per host) is broadcast up to a checked number of hosts and bytes. A page
is read three times: for its tokens, for their places, and for its text.

Defined results: null or empty html gives empty text; a null or odd address is a host of
its own kind (""); repeated rows each give a row; no length is cut off. Text outside
articles' headings and paragraphs that most pages of a host share counts as template.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Elements that never hold main text, and words in classes or ids of elements made for something else.
ASIDE_ELEMENTS = frozenset("head nav footer aside script style noscript template iframe object select option textarea button svg math canvas audio video dialog menu".split())
ASIDE_WORDS = frozenset(
    """ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs
    masthead topbar footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    comment comments respond disqus reply replies reactions share sharing social related recommended recommendations widget toolbar pagination pager copyright legal
    disclaimer skip search form hidden""".split()
)
#: Words that may stand beside those in a name: site-footer, main-nav, share-buttons.
NEUTRAL_WORDS = frozenset("site page main global top bottom left right primary secondary inner outer box bar wrap wrapper container block list links area section widget buttons posts articles".split())
#: Elements whose names are no hint: the page, its text and its own parts.
UNNAMED = frozenset("html body main article p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Elements that no template is looked for in, inside an article.
OWN_TEXT = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Pages of a host from which a template can be told.
LEAST_PAGES = 3
#: Characters of labels and hints that a field of a form may have.
FIELD_TEXT = 60
HEADER_NAMES = frozenset("header site-header page-header main-header top-header".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body main article section div td".split())
#: Values of aside: not inside an element made for something else, or in one that never holds main text. Others: the node whose name is a hint.
NOT, NEVER = -1, -2
#: Elements that are fields of a form.
FIELDS = frozenset("input select button".split())
_HIDDEN = re.compile(r"""(?:^|[\s"'])type\s*=\s*["']?hidden""", re.I)

RAW = frozenset("script style textarea title noscript iframe template svg".split())
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")
#: The rest of a tag; no part of it is ever given back, so a failure is found in one go.
_REST = re.compile(r"""([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
#: What an open element is ended by, if another of these starts.
_P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_LISTS = frozenset("ul ol dl table".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@functools.lru_cache(1 << 14)
def aside_name(name: str) -> bool:
    """A class, id or role that says as a whole that its element is made for something else."""
    found = [w.lower() for w in _WORDS.findall(name)]
    return name.lower() in HEADER_NAMES or not ASIDE_WORDS.isdisjoint(found) and all(w in ASIDE_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in found)


def _hash(*what: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(what).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Page:
    """A page's events and blocks over its tree of paths: a node for each path of named elements, numbered in page order.

    Of node i: parent, key (the same on all pages for the same path), article (inside an
    article or main element, or one itself), own (a heading or paragraph inside one).
    Reading takes a time in proportion to the page, however it is nested or broken.
    """

    def __init__(self, page: str):
        self.page = page
        self.parent, self.key, self.article, self.own = [-1], [""], [False], [False]
        self.children: dict[tuple[int, str], int] = {}
        self.heads: list[tuple[str, int, int, int]] = []
        self.fields = [0]  # of each form, in page order from 1; 0 is no form
        self.blocks = self._blocks()

    def child(self, node: int, tag: str, names: list[str]) -> int:
        label = ".".join([tag, *(_DIGITS.sub("0", x) for x in names)])
        new = self.children.setdefault((node, label), len(self.parent))
        if new == len(self.parent):
            self.parent.append(node)
            self.key.append(f"{_hash(self.key[node], label) & (1 << 64) - 1:x}")
            self.article.append(self.article[node] or tag in ("article", "main"))
            self.own.append(self.article[new] and tag in OWN_TEXT)
        return new

    def marks(self):
        """(text start, text end, tag, is an end, attributes) of each tag, with the text before it; then the rest. No tag: None."""
        page, last, quotes = self.page, self.page.rfind(">"), True
        text, at = 0, page.find("<")
        while 0 <= at < last:
            m = _TAG.match(page, at + 1)
            end = 0
            if m:
                rest = _REST.match(page, m.end()) if quotes else None
                if rest:
                    end, attrs = rest.end(), rest[1]
                else:  # a quote is never closed: from here on quotes are letters
                    quotes, end = False, page.find(">", m.end()) + 1
                    attrs = page[m.end() : end - 1]
                tag, close = m[2].lower(), bool(m[1])
                raw = tag in RAW and not close
                yield text, at, None if raw else tag, close, attrs
                if raw and not (tag == "svg" and attrs.endswith("/")):
                    found = _raw_end(tag).search(page, end)
                    end = found.end() if found else len(page)
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3
                end = end if end > 2 else len(page)
                yield text, at, None, False, ""
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at) + 1
                yield text, at, None, False, ""
            if end:
                text = end
            at = page.find("<", end or at + 1)
        yield text, len(page), None, False, ""

    def events(self):
        """(node, aside, form, started, text) of each start of an element and each text, in page order.

        started: the element that starts here; text: the raw text here, or None at a start or end.
        """
        stack: list[tuple[str, int, int, int, dict[str, int], int]] = []  # element, node, aside, open p, open items of lists, form
        count: Counter[str] = Counter()
        top = ("", 0, NOT, -1, {}, 0)

        def cut(k: int) -> tuple:
            for x in stack[k:]:
                count[x[0]] -= 1
            del stack[k:]
            return stack[-1] if stack else ("", 0, NOT, -1, {}, 0)

        for a, b, tag, close, attrs in self.marks():
            _, node, aside, p, items, form = top
            if b > a:
                yield node, aside, form, None, self.page[a:b]
            if tag is None:
                continue
            if close:
                if count[tag]:
                    top = cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                if tag not in INLINE:
                    yield top[1], top[2], top[5], None, None
                continue
            if tag in _P_ENDS and p >= 0:
                top = cut(p)
            elif tag in _SIBLINGS and (k := max(items.get(x, -1) for x in _SIBLINGS[tag])) >= 0:
                top = cut(k)
            _, node, aside, p, items, form = top
            if tag == "form" and not form:
                form = len(self.fields)
                self.fields.append(0)
            elif tag in FIELDS and not _HIDDEN.search(attrs):
                self.fields[form] += 1
            names = sorted({x for y in _NAMES.findall(attrs) for x in "".join(y[1:]).split()}) if attrs else []
            own = node if tag in INLINE else self.child(node, tag, names)
            inner = aside
            if aside != NEVER:
                article = self.article[node]
                if tag in ASIDE_ELEMENTS or tag == "header" and not article:
                    inner = NEVER
                elif aside == NOT and (not article and tag not in UNNAMED and tag not in INLINE and any(map(aside_name, names))):
                    inner = own
            if tag not in VOID:
                k = len(stack)
                top = (tag, own, inner, k if tag == "p" else -1 if tag in CONTAINERS else p, {} if tag in _LISTS else {**items, tag: k} if tag in _SIBLINGS else items, form)
                stack.append(top)
                count[tag] += 1
            if tag not in INLINE:
                yield own, inner, form, tag, None

    def _blocks(self) -> list[tuple[int, bool, str]]:
        """(node, whether aside, text) of each block with text that is not in a NEVER element: references decoded, white space one blank.

        A name that is a hint is forgotten where it encloses what the page is about.
        """
        out: list[tuple[int, int, int, str]] = []
        parts: list[str] = []
        where = (0, NOT, 0)

        def done() -> None:
            if parts and where[1] != NEVER and (text := " ".join(entities.unescape("".join(parts)).split())):
                out.append((*where, text))

        for node, aside, form, tag, text in self.events():
            if tag in ("article", "main", "h1") and aside != NEVER:
                self.heads.append((tag, self.parent[node] if tag == "h1" else node, aside, form))
            if text is None or (node, aside, form) != where:
                done()
                parts, where = [], (node, aside, form)
            if text is not None:
                parts.append(text)
        done()
        gone = self._forms(out)
        self.heads = [(tag, node, aside) for tag, node, aside, form in self.heads if form not in gone]
        if all(aside != NOT or form in gone for _, aside, form, _ in out):
            return [(node, False, text) for node, _, _, text in out]
        own = self.heads[0][2] if self.heads and all(x[2] != NOT for x in self.heads) else NOT
        return [(node, form in gone or aside not in (NOT, own), text) for node, aside, form, text in out]

    def _forms(self, blocks: list[tuple[int, int, int, str]]) -> set[int]:
        """The forms that are made for something else."""
        size: Counter[int] = Counter()
        for _, aside, form, text in blocks:
            if aside == NOT:
                size[form] += len(text)
        heads = {form for _, _, aside, form in self.heads if aside == NOT}
        enough = sum(size.values()) / 2
        return {form for form, fields in enumerate(self.fields) if form and heads != {form} and size[form] <= max(enough, FIELD_TEXT * fields)}

    def words(self):
        """(block, tokens of its words) of blocks that are not aside and not the author's own text."""
        seen: Counter[str] = Counter()
        for i, (node, aside, text) in enumerate(self.blocks):
            if not aside and not self.own[node]:
                tokens = []
                for w in text.split():
                    word = f"{self.key[node]} {w}"
                    seen[word] += 1
                    tokens.append(f"{word} {seen[word]}")
                yield i, tokens

    def main_part(self) -> list[bool]:
        """For each node whether it lies in the main element, or else in the innermost one that holds all articles and first headings."""
        heads = [x for x in self.heads if x[2] == NOT]
        nodes = [node for tag, node, _ in heads if tag == "main"] or [node for _, node, _ in heads]
        inside = nodes[0] if nodes else 0
        for node in nodes[1:]:  # a parent has a smaller number than its children
            while inside != node:
                inside, node = (self.parent[inside], node) if inside > node else (inside, self.parent[node])
        out: list[bool] = []
        for i, parent in enumerate(self.parent):
            out.append(i == inside or parent >= 0 and out[parent])
        return out


@functools.lru_cache(64)
def _raw_end(tag: str):
    return re.compile(rf"</{tag}\s*>", re.I)


def tokens(page: Page) -> Counter[str]:
    """How often the page has each token: the root (""), elements, and words outside own texts."""
    out: Counter[str] = Counter({"": 1})
    for node, _, _ in page.blocks:
        out[page.key[node] or "-"] += 1
    for _, found in page.words():
        out.update(found)
    return out


def _rows(batch: pa.RecordBatch, *names: str):
    """The rows of some columns, as Python values a slice at a time."""
    for rows, _, _ in c.text_slices([batch]):
        yield from zip(*(rows.column(x).to_pylist() for x in names), strict=True)


def token_statistics(pages: DataFrame) -> DataFrame:
    """host, token, vector (sum of hashed pages times occurrences), pages. Rows are (_host, _text)."""

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
            for host, text in _rows(batch, "_host", "_text"):
                page = _hash(text)
                for token, often in tokens(Page(text)).items():
                    s = sums[host, token]
                    s[0] = s[0] + page * often & (1 << 64) - 1
                    s[1] += 1
            rows = [(h, t, v - (1 << 64) if v >> 63 else v, n) for (h, t), (v, n) in sums.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["host", "token", "vector", "pages"])

    # sums of hashes are taken modulo 2**64: halves are summed apart, so that no sum overflows
    part = pages.select("_host", "_text").mapInArrow(run, "host string, token string, vector long, pages long")
    low, high = F.col("vector").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("vector", 32)
    sums = part.groupBy("host", "token").agg(F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("pages").alias("pages"))
    vector = F.concat_ws(":", F.col("low").bitwiseAND(0xFFFFFFFF), (F.col("high") + F.shiftright("low", 32)).bitwiseAND(0xFFFFFFFF))
    return sums.select("host", "token", vector.alias("vector"), "pages")


def classes(statistics: DataFrame, most: float = 0.5) -> DataFrame:
    """host, token, class ("" is the root's) of classes that are large enough, for hosts with enough pages."""
    root = statistics.filter("token = ''").select("host", F.col("vector").alias("root_vector"), F.col("pages").alias("all_pages")).filter(F.col("all_pages") >= LEAST_PAGES)
    often = statistics.join(root, "host").filter(F.col("pages") > most * F.col("all_pages"))
    size = often.groupBy("host", "vector").agg(F.count("*").alias("size"))
    known = often.join(size, ["host", "vector"]).filter((F.col("vector") == F.col("root_vector")) | (F.col("size") > 1))
    name = F.when(F.col("vector") == F.col("root_vector"), "").otherwise(F.col("vector"))
    return known.select("host", "token", name.alias("class"))


def by_host(known: DataFrame) -> DataFrame:
    """host, tokens (their number), template: a line for each class and token."""
    lines = F.collect_list(F.concat_ws("\t", "class", "token"))
    return known.groupBy("host").agg(F.array_sort(lines).alias("lines")).select("host", F.size("lines").alias("tokens"), F.array_join("lines", "\n").alias("template"))


@functools.lru_cache(1 << 10)
def _template(lines: str) -> dict[str, str]:
    """The class of each token."""
    return {token: name for name, _, token in (x.partition("\t") for x in lines.split("\n") if x)}


def places(pages: DataFrame) -> DataFrame:
    """host, token, class, first and last: the least and largest place of the token among those of its class on a page. Rows are (_host, _text, template)."""

    def run(batches):
        for batch in batches:
            found: dict[tuple[str, str, str], list[int]] = {}
            for host, text, lines in _rows(batch, "_host", "_text", "template"):
                known = _template(lines)
                seen: Counter[str] = Counter()
                for _, words in Page(text).words() if known else ():
                    for token in words:
                        if (name := known.get(token)) is not None:
                            at = found.setdefault((host, token, name), [seen[name], seen[name]])
                            at[0], at[1] = min(at[0], seen[name]), max(at[1], seen[name])
                            seen[name] += 1
            if found:
                rows = [(*k, *v) for k, v in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["host", "token", "class", "first", "last"])

    part = pages.filter("template is not null").select("_host", "_text", "template").mapInArrow(run, "host string, token string, class string, first long, last long")
    return part.groupBy("host", "token", "class").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def template_words(page: Page, known: dict[str, str]) -> set[str]:
    """The tokens on the page that are template: those of the root's class, and of others that lie at least two together in one slot between those."""
    slot, words, nested, out = 0, dict(page.words()), defaultdict(list), set()
    for i, (node, _, _) in enumerate(page.blocks):
        for token in (page.key[node] or "-", *words.get(i, ())):
            name = known.get(token)
            if name == "" and " " in token:
                slot += 1
                out.add(token)
            elif name:
                nested[name, slot].append(token)
    return out.union(*(x for x in nested.values() if len(x) > 1))


def main_text(html: str, template: str | None) -> str:
    """The page's text that is neither aside nor template; on a host without template (None), that of its own main part."""
    page = Page(html)
    if template is not None:
        known = template_words(page, _template(template))
        gone = {i for i, words in page.words() if known.issuperset(words)}
        own = [text for i, (_, aside, text) in enumerate(page.blocks) if not aside and i not in gone]
    else:
        inside = page.main_part()
        own = [text for node, aside, text in page.blocks if not aside and inside[node]]
    return " ".join(own or [text for _, aside, text in page.blocks if not aside])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = 100_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    p = pages.select(F.col(page_id).alias("_id"), F.col(url).cast("string").alias("_url"), host.alias("_host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_text"))
    known = c.materialize(classes(c.materialize(token_statistics(p))))

    def joined(known: DataFrame) -> DataFrame:
        template = c.materialize(by_host(known)).withColumnRenamed("host", "_host")
        size = template.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.octet_length("template")), F.lit(0)).alias("bytes")).first()
        few = size["hosts"] <= broadcast_hosts and size["bytes"] <= broadcast_bytes
        return p.join(F.broadcast(template) if few else template, "_host", "left")

    # a class in order: each of its words has the same place on all pages
    unsteady = places(joined(known)).filter("first < last").select("host", "token", "class")
    joined = joined(known.join(c.materialize(unsteady), ["host", "token", "class"], "left_anti")).select("_id", "_url", "_text", "template")
    schema = T.StructType([T.StructField(page_id, p.schema["_id"].dataType), T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch, _, _ in c.text_slices(batches):
            out = [main_text(*row) for row in _rows(batch, "_text", "template")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
