"""Pages as trees in rows: tables profiled, and previews of what an anchor leads to.

One pass over a page numbers its elements and texts in page order. An element holds the numbers
from its own to `last`, so what lies in it is a range, not a copy: each text is kept once, and
a page takes rows in proportion to its length, however deep it nests. `seen` counts the
characters before a place that are not blank. Texts of an element are joined by blocks of `seen`;
where a rule needs only the first so many characters, a join reads no more of them.

Blank pages and null html have no rows. Scripts, styles and noscript are left out with content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.storage import stored

# How markup closes elements that have no end tag.
VOID = "area base br col embed frame hr img input keygen link meta param source track wbr".split()
LEFT_OUT = "script style noscript".split()
SCOPES = "table td th caption".split()
SECTIONS = "thead tbody tfoot".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
CLOSES_P = "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CLOSED_BY = {"td": (["td", "th"], ["table"]), "th": (["td", "th"], ["table"]), "tr": (["tr"], ["table"]), "li": (["li"], ["ul", "ol", "menu", *SCOPES]), "dt": (["dt", "dd"], ["dl", *SCOPES]), "dd": (["dt", "dd"], ["dl", *SCOPES]), **{x: (["thead", "tbody", "tfoot"], ["table"]) for x in SECTIONS}, **{x: (["p"], SCOPES) for x in CLOSES_P}}

_BLANKS = re.compile("[" + t.WS[1:-1] + "]+")
_SPAN = re.compile(r"\s*([+-]?\d{1,15})")
#: Characters of one text row, blocks of `seen` that texts are joined by, and rows handed on together.
PIECE, BLOCK, CHUNK = 1024, 256, 4096

NODE = "number int, last int, parent int, tag string, level int, heading int, span long, anchors array<string>, seen int, seen_end int, text string"


def _gap(blanks: str) -> str:
    """White space between texts, as short as cleaning would leave it."""
    blanks = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", blanks.replace("\xa0", " "))))
    return blanks if len(blanks) <= 8 else blanks[:4] + blanks[-4:]


class _Numbers(HTMLParser):
    """Rows of elements and of texts in page order; each tag takes constant time, apart from what it closes."""

    def __init__(self):
        super().__init__()
        self.rows: list[list] = []
        self.stack: list[list] = []
        self.open: dict[str, list[int]] = {}
        self.headings: list[int] = []
        self.skip, self.seen, self.blanks = "", 0, ""

    def depth(self, tags) -> int:
        return max((self.open[x][-1] for x in tags if self.open.get(x)), default=-1)

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            row = self.stack.pop()
            row[1], row[9] = len(self.rows) - 1, self.seen
            self.open[row[3]].pop()
            if row[4]:
                self.headings.pop()

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in LEFT_OUT:
            self.skip = tag
            return
        if tag in CLOSED_BY:
            ends, bounds = CLOSED_BY[tag]
            at = min((self.open[x][-1] for x in ends if self.open.get(x) and self.open[x][-1] > self.depth(bounds)), default=-1)
            if at >= 0:
                self.close_to(at)
        level = int(tag[1]) if tag in HEADINGS else 0
        if level and self.stack and self.stack[-1][4]:
            self.close_to(len(self.stack) - 1)
        number, a = len(self.rows), dict(reversed(attrs))
        span = _SPAN.match(a.get("colspan") or "")
        anchors = list(dict.fromkeys(x for x in (a.get("id"), a.get("name")) if x))
        heading = number if level else self.headings[-1] if self.headings else None
        row = [number, number, self.stack[-1][0] if self.stack else -1, tag, level, heading, max(1, int(span[1]) if span else 1), anchors, self.seen, self.seen, None]
        self.rows.append(row)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(row)
            if level:
                self.headings.append(number)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip:
                self.skip = ""
            return
        at = self.depth([tag])
        if at >= 0 and (tag == "table" or at > self.depth(["table"] if tag in ("td", "th", "tr", "caption", *SECTIONS) else SCOPES)):
            self.close_to(at)

    def handle_data(self, data):
        if self.skip:
            return
        for i in range(0, len(data), PIECE):
            piece = data[i : i + PIECE]
            full = len(_BLANKS.sub("", piece))
            if not full:
                self.blanks = _gap(self.blanks + piece)
                continue
            number = len(self.rows)
            self.rows.append([number, number, self.stack[-1][0] if self.stack else -1, None, 0, None, 1, [], self.seen, self.seen + full, self.blanks + piece])
            self.seen, self.blanks = self.seen + full, ""


def number_page(html: str | None) -> list[list]:
    p = _Numbers()
    p.feed(html or "")
    p.close()
    p.close_to(0)
    return p.rows


def _keys(rows: DataFrame) -> list[str]:
    return [x for x in ("book_id", "path", "doc_pos") if x in rows.columns]


def page_nodes(pages: DataFrame) -> DataFrame:
    """The keys of pages (book_id, path and, if there, doc_pos) with a row for each element (tag, ...) and text (text)."""
    keys = _keys(pages)
    names = [*keys, *[x.split()[0] for x in NODE.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[list] = []
            for *key, html in frame.itertuples(index=False, name=None):
                for node in number_page(html):
                    rows.append([*key, *node])
                    if len(rows) == CHUNK:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
            yield pd.DataFrame(rows, columns=names, dtype=object)

    schema = ", ".join(f"{x} {pages.schema[x].dataType.simpleString()}" for x in keys)
    return pages.select(*keys, "html").mapInPandas(run, f"{schema}, {NODE}")


def texts_of(spans: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """The columns `by` (page keys first) of spans (number, last, lo, hi) with `text`: the texts of that range that begin before `hi`.

    Spans without text are left out. Both sides meet by page and block of `seen`, so a span reads
    its own blocks only.
    """
    keys = _keys(nodes)
    pieces = nodes.filter("text is not null").select(*keys, F.col("number").alias("_n"), F.col("seen").alias("_s"), F.col("text").alias("_t"), F.expr(f"seen div {BLOCK}").alias("_block"))
    each = spans.filter("hi > lo").select(*by, "number", "last", "hi", F.explode(F.expr(f"sequence(lo div {BLOCK}, (hi - 1) div {BLOCK})")).alias("_block"))
    met = each.join(pieces, [*keys, "_block"]).filter("_n between number and last and _s < hi")
    lists = met.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_l"))
    return lists.select(*by, F.array_join(F.transform("_l", lambda x: x["_t"]), "").alias("text"))


# --- tables -------------------------------------------------------------------------

#: Rows of a table that its columns are counted in; characters after which a cell is surely of the longest kind.
FIRST_ROWS, LONGEST = 12, 50


def profile_tables(pages: DataFrame) -> DataFrame:
    """Per top table of a page (table_no from 0): columns, long_cells, very_long, xlong, wide, labels.

    Columns are the most that one of the first 12 rows spans. Cells of inner tables count for the outer
    one; of a cell's text, as many characters are read as decide its kind.
    """
    keys = _keys(pages)
    nodes = stored(page_nodes(pages.filter(F.lower("html").contains("<table"))))
    elements = nodes.filter("tag is not null")
    order = Window.partitionBy(*keys).orderBy("number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    some = elements.filter(F.col("tag").isin("table", "tr", "td", "th", *SECTIONS))
    outer = F.max(F.when(F.col("tag") == "table", F.col("last"))).over(before)
    marked = some.withColumn("_top", (F.col("tag") == "table") & (F.coalesce(outer, F.lit(-1)) < F.col("number")))
    at = F.last(F.when(F.col("_top"), F.struct("number", "last")), ignorenulls=True).over(order)
    inside = stored(marked.withColumn("_table", at).filter(F.col("number") <= F.col("_table.last")).select(*keys, F.col("_table.number").alias("table"), "number", "last", "parent", "tag", "seen", "seen_end"))
    tops = inside.filter("number = table").select(*keys, "table", (F.row_number().over(order) - 1).alias("table_no"))
    holders = inside.filter((F.col("number") == F.col("table")) | (F.col("tag").isin(*SECTIONS) & (F.col("parent") == F.col("table")))).select(*keys, "table", F.col("number").alias("parent"))
    rows = inside.filter("tag = 'tr'").join(holders, [*keys, "table", "parent"])
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "table").orderBy("number"))).filter(F.col("_r") <= FIRST_ROWS)
    wide = elements.select(*keys, F.col("parent").alias("number"), "span").join(rows.select(*keys, "table", "number"), [*keys, "number"])
    columns = wide.groupBy(*keys, "table", "number").agg(F.sum("span").alias("span")).groupBy(*keys, "table").agg(F.max("span").alias("columns"))
    cells = inside.filter("tag in ('td', 'th')").withColumns({"lo": F.col("seen"), "hi": F.least("seen_end", F.col("seen") + LONGEST)})
    weight = texts_of(cells, nodes, [*keys, "table", "number"]).withColumn("weight", t.text_weight("text"))
    long = weight.groupBy(*keys, "table").agg(*[F.sum((F.col("weight") > w).cast("int")).alias(n) for w, n in ((9, "long_cells"), (12, "very_long"), (24, "xlong"))])
    x = tops.join(columns, [*keys, "table"], "left").join(long, [*keys, "table"], "left").fillna(0, ["columns", "long_cells", "very_long", "xlong"])
    is_wide = (F.col("columns") >= 5) | ((F.col("columns") >= 4) & (F.col("long_cells") >= 2))
    return x.withColumn("wide", is_wide).withColumn("labels", F.col("columns").between(2, 3) & ~F.col("wide")).drop("table")


# --- anchors ------------------------------------------------------------------------

#: Characters of a preview.
PREVIEW = 1800


def _asked(nodes: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the pages that are asked for, stored, and the questions (book_id, path, fragment, label), each once."""
    questions = asked.select("book_id", "path", "fragment", F.coalesce("label", F.lit("")).alias("label")).distinct()
    return stored(nodes.join(questions.select("book_id", "path").distinct(), ["book_id", "path"], "left_semi")), questions


def _placed(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Elements with `after` (the next sibling with text), `stops` (the next sibling heading of rank 1, up to 2, ... up to 6) and
    `inner` (characters of the siblings before)."""
    w = Window.partitionBy(*keys, "parent").orderBy(F.col("number").desc()).rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy(*keys, "parent").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("seen_end") - F.col("seen")
    stop = lambda rank: F.last(F.when(F.col("level").between(1, rank), F.col("number")), ignorenulls=True).over(w)
    return nodes.filter("tag is not null").withColumns({"after": F.last(F.when(full > 0, F.col("number")), ignorenulls=True).over(w), "stops": F.array(*[stop(k) for k in range(1, 7)]), "inner": F.coalesce(F.sum(full).over(to_here), F.lit(0))})


def _targets(nodes: DataFrame, elements: DataFrame, questions: DataFrame) -> DataFrame:
    keys = _keys(nodes)
    wanted = F.replace("fragment", F.lit("+"), F.lit("%2B"))
    questions = questions.withColumn("_f", F.coalesce(F.try_url_decode(wanted), F.col("fragment"))).filter("_f != ''")
    hits = elements.withColumn("_f", F.explode("anchors")).join(questions, ["book_id", "path", "_f"])
    # what is seen of an anchor: its heading, itself, the next sibling with text, or what it lies in
    seen = F.coalesce("heading", F.when(F.col("seen_end") > F.col("seen"), F.col("number")), "after", F.when(F.col("parent") >= 0, F.col("parent")), "number")
    many = F.count("*").over(Window.partitionBy(*keys, "fragment", "label"))
    hits = hits.select(*keys, "fragment", "label", F.col("number").alias("anchor"), seen.alias("number"), t.compact_compare("label").alias("_want"), many.alias("_many"))
    shown = elements.select(*keys, "number", "last", F.col("seen").alias("lo"), F.col("seen_end").alias("hi"))
    by = [*keys, "fragment", "label", "anchor"]
    texts = texts_of(hits.filter("_many > 1 and _want != ''").join(shown, [*keys, "number"]), nodes, by).withColumn("_own", t.compact_compare("text")).drop("text")
    x = hits.join(texts, by, "left").withColumn("_own", F.coalesce("_own", F.lit("")))
    same = F.aggregate(F.zip_with(F.split("_own", ""), F.split("_want", ""), lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, y: n + F.coalesce(y, F.lit(0)))
    score = F.when((F.col("_want") == "") | (F.col("_own") == ""), 0).when(F.col("_want").contains(F.col("_own")), 10_000 + F.length("_own")).when(F.col("_own").contains(F.col("_want")), 9_000 + F.length("_want")).otherwise(same)
    best = Window.partitionBy(*keys, "fragment", "label").orderBy(F.col("score").desc(), "anchor")
    return x.withColumn("score", score).withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*keys, "fragment", "label", "anchor", "number", "score")


def fragment_target(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (book_id, path, fragment, label) the element with this anchor that fits the label best, the first of equals:
    anchor (its number), number (of what is seen of it) and score."""
    nodes, questions = _asked(nodes, asked)
    return _targets(nodes, stored(_placed(nodes, _keys(nodes))), questions)


def fragment_preview(nodes: DataFrame, asked: DataFrame, most: int = PREVIEW) -> DataFrame:
    """page keys, fragment, label, title, text: what an anchor shows and the siblings that follow, to the next heading of its rank or above.

    A sibling is taken while those before it have less than `most` characters; the whole is cut there.
    """
    keys = _keys(nodes)
    nodes, questions = _asked(nodes, asked)
    elements = stored(_placed(nodes, keys))
    by = [*keys, "fragment", "label"]
    at = stored(_targets(nodes, elements, questions).join(elements.select(*keys, "number", "last", "parent", "level", "seen", "seen_end", "stops", "inner"), [*keys, "number"]))
    focus = texts_of(at.withColumns({"lo": F.col("seen"), "hi": F.col("seen_end")}), nodes, by).select(*by, t.clean_text("text").alias("_focus"))
    end = (F.col("inner") + F.col("seen_end") - F.col("seen")).alias("_end")
    stop = F.when(F.col("level") > 0, F.get("stops", F.col("level") - 1)).alias("_stop")
    reach = at.select(*by, "parent", F.col("last").alias("_last"), end, stop).withColumn("_block", F.explode(F.expr(f"sequence(_end div {BLOCK}, (_end + {most - 1}) div {BLOCK})")))
    next_ones = elements.filter("seen_end > seen").select(*keys, "parent", "number", "last", "seen", "seen_end", "inner", F.expr(f"inner div {BLOCK}").alias("_block"))
    follow = reach.join(next_ones, [*keys, "parent", "_block"]).filter(f"number > _last and inner < _end + {most} and (_stop is null or number < _stop)")
    cut = F.least(F.col("seen_end"), F.col("seen") + most + F.col("_end") - F.col("inner"))
    parts = texts_of(follow.withColumns({"lo": F.col("seen"), "hi": cut}), nodes, [*by, "number"]).withColumn("text", t.clean_text("text")).filter("text != ''")
    size = F.length("text")
    before = F.sum(size).over(Window.partitionBy(*by).orderBy("number")) - size
    lists = parts.withColumn("_before", before).filter(F.col("_before") < most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("_l"))
    text = lists.select(*by, F.substring(F.array_join(F.transform("_l", lambda x: x["text"]), "\n\n"), 1, most).alias("text"))
    titles = elements.filter("tag = 'title'").groupBy(*keys).agg(F.min_by(F.struct("number", "last", F.col("seen").alias("lo"), F.col("seen_end").alias("hi")), "number").alias("x")).select(*keys, "x.*")
    title = texts_of(titles, nodes, keys).select(*keys, t.clean_text("text").alias("_title"))
    x = at.select(*by).join(focus, by, "left").join(text, by, "left").join(title, keys, "left")
    return x.select(*by, t._first(F.col("_focus"), t.clean_text("label"), F.col("_title"), F.lit("规则预览")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def anchors_of(nodes: DataFrame) -> DataFrame:
    """book_id, path, fragment, label ('') of every anchor of pages: what could be asked."""
    return nodes.select("book_id", "path", F.explode("anchors").alias("fragment"), F.lit("").alias("label")).distinct()

