"""Tables of contents: nodes (book_id, node_id, parent_id, pos, depth, name, local, locals, ancestors), spines, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.storage import stored

#: A tag: what closes, its name, its attributes.
TAG = rf"<{t.WS}*(/?){t.WS}*([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)>"
LISTS = ["ul", "menu", "dir"]
#: So many pieces of a text, from left to right: a tag, a text up to the next bracket, or a bracket that begins no tag.
PIECES = 256
BLOCK = rf"(?:[^<]++|{TAG}|<){{1,{PIECES}}}+"


def _tag_rows(files: DataFrame) -> DataFrame:
    """file, book_id, base, n, tag, opens, attrs: the tags of contents files that matter, in order."""
    # what a file has one of is computed before its parts are dealt out: beside them it would be computed, and the text carried, for each of them
    key = F.xxhash64("book_id", "base", "text").alias("file")
    found = files.select(key, "book_id", F.coalesce("base", F.lit("/")).alias("base"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(BLOCK), 0).alias("_blocks"))
    # a block begins and ends between pieces, so it has its tags whole, and the same as the text; few files are few tasks, so blocks are dealt anew
    blocks = found.select("file", "book_id", "base", F.posexplode("_blocks").alias("_b", "_block")).repartition("file", "_b")
    tags = blocks.select("file", "book_id", "base", "_b", F.posexplode(F.regexp_extract_all("_block", F.lit(TAG), 0)).alias("_i", "_m"))
    each = tags.select("file", "book_id", "base", (F.col("_b") * PIECES + F.col("_i")).alias("n"), "_m")
    part = lambda i: F.regexp_extract("_m", TAG, i)
    rows = each.select("file", "book_id", "base", "n", F.lower(part(2)).alias("tag"), (part(1) == "").alias("opens"), part(3).alias("body")).filter(F.col("tag").isin(*LISTS, "object", "param"))
    return rows.withColumn("attrs", F.when(F.col("opens") & F.col("tag").isin("object", "param"), t.attrs_map("body"))).drop("body")


def _topics(tags: DataFrame) -> DataFrame:
    """file, book_id, base, n, name, local, locals: one row for each object that names a topic, at the tag that ends it."""
    w = Window.partitionBy("file").orderBy("n")
    start = F.last(F.when((F.col("tag") == "object") & F.col("opens"), F.struct("n", F.lower(F.coalesce(F.col("attrs")["type"], F.lit(""))).contains("text/sitemap").alias("topic"))), ignorenulls=True).over(w)
    inside = tags.filter(~F.col("tag").isin(*LISTS)).withColumn("_o", start).filter("_o.topic")
    ends = F.min(F.when((F.col("tag") == "object") & ~F.col("opens"), F.col("n"))).over(Window.partitionBy("file", "_o.n"))
    own = inside.withColumn("_end", ends).filter("_end is not null and (tag = 'param' and opens and n < _end or n = _end)")
    kind, value = F.lower(F.col("attrs")["name"]), F.coalesce(F.col("attrs")["value"], F.lit(""))
    named = own.withColumns({"_k": kind, "_v": value}).withColumn("_path", F.when(F.col("_k") == "local", t.normalize_path("base", "_v")))
    first = lambda k: F.min_by(F.when(F.col("_v") != "", F.col("_v")), F.when((F.col("_k") == k) & (F.col("_v") != ""), F.col("n")))
    x = named.groupBy("file", "book_id", "base", F.col("_end").alias("n")).agg(first("name").alias("_name"), first("local").alias("_local"), F.array_sort(F.collect_list(F.when(F.col("_path").isNotNull(), F.struct("n", "_path")))).alias("_l"))
    x = x.filter("_name is not null or _local is not null")
    return x.select("file", "book_id", "n", t.trim(F.coalesce("_name", "_local")).alias("name"), t.normalize_path("base", "_local").alias("local"), F.transform("_l", lambda y: y["_path"]).alias("locals"))


def parse_sitemap(files: DataFrame) -> DataFrame:
    """Nodes of contents files (book_id, base, text), one row each: lists nest, an object that names a topic is a node.

    Tags become rows, and nesting is bracket matching by windows. How many lists are open is a sum
    of what opens and closes so far, less the lowest it fell (what closes too much closes
    nothing). The list that a row lies in began at the last row that raised the sum to its level. A list
    belongs to the last node before it in the list around it; one without such a node nests nothing. Counting
    only lists with an owner in the same way gives each node its depth, and the owner at each level its ancestors.
    """
    tags = stored(_tag_rows(files))
    numbered = stored(_topics(tags).withColumn("node_id", F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1))
    w = Window.partitionBy("file").orderBy("n")
    both = tags.filter(F.col("tag").isin(*LISTS)).select("file", "n", F.when(F.col("opens"), 1).otherwise(-1).alias("step"), F.lit(None).cast("int").alias("node_id")).unionByName(numbered.select("file", "n", F.lit(0).alias("step"), "node_id"))
    total = both.withColumn("_sum", F.sum("step").over(w))
    level = total.withColumn("level", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    level = level.withColumn("_before", F.lag("level", 1, 0).over(w)).filter("step >= 0 or _before > 0")
    # each row at the level it lies in, and each list also where it begins, one level further in
    at = level.select("file", "n", "step", "node_id", F.when(F.col("step") == 1, F.col("_before")).otherwise(F.greatest("level", "_before")).alias("level"), F.lit(False).alias("begins"))
    begins = level.filter("step = 1").select("file", "n", "step", "node_id", "level", F.lit(True).alias("begins"))
    same = Window.partitionBy("file", "level").orderBy("n", F.col("begins").desc())
    lists = at.unionByName(begins).withColumn("list", F.last(F.when(F.col("begins"), F.col("n")), ignorenulls=True).over(same))
    last = F.last("node_id", ignorenulls=True).over(Window.partitionBy("file", "level", "list").orderBy("n"))
    inside = lists.filter("not begins").withColumn("_owner", last)
    owners = stored(inside.filter("step = 1 and _owner is not null").select("file", F.col("n").alias("list"), F.col("_owner").alias("owner")))
    # what opens such lists, what closes them, and the nodes
    opened = owners.select("file", F.col("list").alias("n"), F.lit(1).alias("step"), "owner", F.lit(None).cast("int").alias("node_id"))
    closed = inside.filter("step = -1").join(owners, ["file", "list"], "left_semi").select("file", "n", "step", F.lit(None).cast("int").alias("owner"), "node_id")
    nodes = numbered.select("file", "n", F.lit(0).alias("step"), F.lit(None).cast("int").alias("owner"), "node_id")
    depths = stored(opened.unionByName(closed).unionByName(nodes).withColumn("depth", F.sum("step").over(w).cast("int")))
    levels = depths.filter("node_id is not null and depth > 0").select("file", "n", "node_id", "owner", F.explode(F.sequence(F.lit(1), "depth")).alias("level")).unionByName(depths.filter("step = 1").select("file", "n", "node_id", "owner", F.col("depth").alias("level")))
    above = levels.withColumn("_a", F.last("owner", ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("n"))).filter("node_id is not null")
    ancestors = above.groupBy("file", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "_a"))), lambda x: x["_a"]).alias("ancestors"))
    whole = numbered.join(ancestors, ["file", "node_id"], "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<int>")))
    return whole.select("book_id", "node_id", F.try_element_at("ancestors", F.lit(-1)).alias("parent_id"), F.col("node_id").alias("pos"), F.size("ancestors").alias("depth"), "name", "local", "locals", "ancestors")


def by_book(*order) -> Window:
    return Window.partitionBy("book_id").orderBy(*order)


def flatten_toc(nodes: DataFrame) -> DataFrame:
    """The spine: nodes with a page in preorder, numbered from 0."""
    return nodes.filter("local is not null and local != ''").select("book_id", (F.row_number().over(by_book("pos")) - 1).alias("pos"), "name", "local", "depth")


def flatten_index(nodes: DataFrame) -> DataFrame:
    """Keyword entries: names below those of their ancestors, with targets, in natural order."""
    up = nodes.select("book_id", "node_id", "name", "pos", "locals", F.posexplode_outer("ancestors").alias("level", "above"))
    names = nodes.select("book_id", F.col("node_id").alias("above"), F.col("name").alias("up_name"))
    path = up.join(names, ["book_id", "above"], "left").groupBy("book_id", "node_id", "pos").agg(F.first("name").alias("name"), F.first("locals").alias("targets"), F.array_sort(F.collect_list(F.when(F.col("up_name").isNotNull(), F.struct("level", "up_name")))).alias("ups"))
    label = F.array_join(F.concat(F.transform("ups", lambda u: u["up_name"]), F.array("name")), ", ")
    return path.filter(F.size("targets") > 0).select("book_id", label.alias("name"), "targets", "pos").orderBy("book_id", t.natural_sort_key("name"), "pos")


def fallback_toc(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """Pages (book_id, path, doc_pos) as flat nodes named by their files."""
    first = docs.withColumn("n", F.row_number().over(by_book("doc_pos"))).filter(F.col("n") <= most)
    name = F.regexp_replace(t.last_segment("path"), r"(?i)\.(x?html?|xht)$", "")
    node = (F.col("n") - 1).alias("node_id")
    return first.select("book_id", node, F.lit(None).cast("int").alias("parent_id"), (F.col("n") - 1).alias("pos"), F.lit(0).alias("depth"), name.alias("name"), F.col("path").alias("local"), F.array("path").alias("locals"), F.array().cast("array<int>").alias("ancestors"))


def fallback_spine(spine: DataFrame, docs: DataFrame) -> DataFrame:
    """Books without a spine read their pages in order."""
    rest = docs.join(spine.select("book_id").distinct(), "book_id", "left_anti")
    own = rest.select("book_id", (F.row_number().over(by_book("doc_pos")) - 1).alias("pos"), t.last_segment("path").alias("name"), F.col("path").alias("local"), F.lit(0).alias("depth"))
    return spine.select("book_id", "pos", "name", "local", "depth").unionByName(own)


LANDING = ["/index.html", "/index.htm", "/default.html", "/default.htm", "/welcome.html", "/welcome.htm"]


def landing_page(docs: DataFrame, spine: DataFrame | None = None, defaults: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """book_id, path: the named default, else the first page of the contents, else a usual name, else the first page (of `pages`, if given)."""
    entries = docs.select("book_id", F.lower("path").alias("_k"), "path", "doc_pos")
    usual = F.array_position(F.array(*map(F.lit, LANDING)), F.col("_k"))
    found = [entries.filter(usual > 0).select("book_id", "path", F.lit(2).alias("prio"), usual.cast("long").alias("place")), (entries if pages is None else pages).select("book_id", "path", F.lit(3).alias("prio"), F.col("doc_pos").cast("long").alias("place"))]
    if spine is not None:
        found.append(spine.select("book_id", F.lower("local").alias("_k"), F.col("local").alias("path"), F.lit(1).alias("prio"), F.col("pos").cast("long").alias("place")).join(entries.select("book_id", "_k"), ["book_id", "_k"], "left_semi").drop("_k"))
    if defaults is not None:
        named = defaults.select("book_id", t.normalize_path(F.lit("/"), F.col("path")).alias("path")).withColumn("_k", F.lower("path"))
        found.append(named.join(entries.select("book_id", "_k"), ["book_id", "_k"], "left_semi").select("book_id", "path", F.lit(0).alias("prio"), F.lit(0).cast("long").alias("place")))
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("book_id").agg(F.min_by("path", F.struct("prio", "place", "path")).alias("path"))


def choose_sitemap(entries: DataFrame, named: DataFrame, extension: str) -> DataFrame:
    """book_id, path: the named file if the book has it, else its first entry with the extension."""
    asked = named.select("book_id", F.lower(t.normalize_path(F.lit("/"), F.col("path"))).alias("_k"), t.normalize_path(F.lit("/"), F.col("path")).alias("own"))
    hit = asked.join(entries.select("book_id", F.lower("path").alias("_k")).distinct(), ["book_id", "_k"], "left_semi").select("book_id", "own")
    first = entries.groupBy("book_id").agg(F.min_by("path", F.when(F.lower("path").endswith(extension.lower()), F.col("entry_pos"))).alias("_first"), F.min(F.when(F.lower("path").endswith(extension.lower()), F.col("entry_pos"))).alias("_any"))
    return first.join(hit, "book_id", "left").select("book_id", F.coalesce("own", F.when(F.col("_any").isNotNull(), F.col("_first"))).alias("path")).filter("path is not null")


def spine_prev_next(spine: DataFrame) -> DataFrame:
    """book_id, local, prev_local, next_local around the first place of each page."""
    near = spine.withColumns({"prev_local": F.lag("local").over(by_book("pos")), "next_local": F.lead("local").over(by_book("pos"))})
    return near.groupBy("book_id", F.lower("local").alias("_k")).agg(F.min_by(F.struct("local", "prev_local", "next_local"), "pos").alias("x")).select("book_id", "x.*")


def filter_toc(nodes: DataFrame, q: str) -> DataFrame:
    """Nodes whose own name contains q, and groups above a leaf that does."""
    q = q.strip().lower()
    if not q:
        return nodes
    parents = nodes.select("book_id", F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct()
    own = nodes.filter(F.lower("name").contains(q))
    leaves = own.join(parents, ["book_id", "node_id"], "left_anti")
    keep = own.select("book_id", "node_id").unionByName(leaves.select("book_id", F.explode("ancestors").alias("node_id"))).distinct()
    return nodes.join(keep, ["book_id", "node_id"], "left_semi")


def toc_chain(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """book_id, path, level, node_id: the first node of each page, below its ancestors."""
    first = nodes.filter("local is not null").groupBy("book_id", F.lower("local").alias("_k")).agg(F.min_by(F.struct("node_id", "ancestors"), "pos").alias("x"))
    own = paths.withColumn("_k", F.lower("path")).join(first, ["book_id", "_k"])
    return own.select("book_id", "path", F.posexplode(F.concat("x.ancestors", F.array("x.node_id"))).alias("level", "node_id"))


def scope_paths(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """book_id, node_id, path, pos: the distinct pages of each node's subtree, by their first place."""
    known = docs.select("book_id", F.lower("path").alias("_k")).distinct()
    each = nodes.select("book_id", "ancestors", F.col("node_id").alias("own"), "pos", F.explode("locals").alias("path")).withColumn("_k", F.lower("path")).join(known, ["book_id", "_k"], "left_semi")
    closure = each.select("book_id", F.explode(F.concat("ancestors", F.array("own"))).alias("node_id"), "path", "_k", "pos")
    return closure.groupBy("book_id", "node_id", "_k").agg(F.min_by("path", "pos").alias("path"), F.min("pos").alias("pos")).drop("_k")


def scope_signature(scopes: DataFrame) -> DataFrame:
    """book_id, node_id, n_paths, signature: sums of hashed (path, place) pairs, so that no list of a scope's pages is built.

    Equal signatures mean equal lists: places are preorder places of the same tree.
    """
    h = lambda salt: F.sum(F.xxhash64("path", "pos", F.lit(salt)).cast("decimal(38,0)")).cast("string")
    return scopes.groupBy("book_id", "node_id").agg(F.count("*").alias("n_paths"), F.concat_ws(":", h(1), h(2)).alias("signature"))


def search_scopes(nodes: DataFrame, docs: DataFrame, paths: DataFrame, with_library: bool = True) -> DataFrame:
    """book_id, path, node_id, depth, kind: scopes of a page from its leaf up; of equal ones the deepest; then book and library."""
    parents = nodes.select("book_id", F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct().withColumn("group", F.lit(True))
    chain = toc_chain(nodes, paths)
    leaf = F.max("level").over(Window.partitionBy("book_id", "path"))
    chain = chain.withColumn("leaf", leaf).join(parents, ["book_id", "node_id"], "left").filter((F.col("level") == F.col("leaf")) | F.col("group"))
    own = chain.join(scope_signature(scope_paths(nodes, docs)), ["book_id", "node_id"])
    rank = F.row_number().over(Window.partitionBy("book_id", "path", "signature").orderBy(F.col("level").desc()))
    toc = own.withColumn("n", rank).filter("n = 1").select("book_id", "path", "node_id", F.col("level").alias("depth"), F.lit("toc").alias("kind"))
    null = F.lit(None).cast(nodes.schema["node_id"].dataType)
    ends = [("book", -1)] + [("library", -2)] * with_library
    for kind, depth in ends:
        toc = toc.unionByName(paths.select("book_id", "path", null.alias("node_id"), F.lit(depth).alias("depth"), F.lit(kind).alias("kind")))
    return toc


def docs_of_node(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    each = nodes.select("book_id", "node_id", F.explode("locals").alias("path"))
    known = docs.select("book_id", F.lower("path").alias("_k")).distinct()
    return each.withColumn("_k", F.lower("path")).join(known, ["book_id", "_k"], "left_semi").drop("_k")


def toc_rows(nodes: DataFrame, most: int = 20_000) -> DataFrame:
    """The first nodes of each book in preorder, with whether they have nodes below."""
    parents = nodes.select("book_id", F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct().withColumn("is_group", F.lit(True))
    rows = nodes.withColumn("n", F.row_number().over(by_book("pos"))).filter(F.col("n") <= most).join(parents, ["book_id", "node_id"], "left")
    return rows.select("book_id", "n", "node_id", "depth", "name", F.coalesce("is_group", F.lit(False)).alias("is_group"))


def keyword_listing(entries: DataFrame, most: int = 20_000) -> DataFrame:
    """The first entries of each book in natural order, with their first target."""
    w = by_book(t.natural_sort_key("name"), "name", "pos")
    return entries.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("book_id", "n", "name", F.get("targets", F.lit(0)).alias("target"))


def readable_books(summary: DataFrame) -> DataFrame:
    return summary.filter((F.coalesce("landing", F.lit("")) != "") | (F.col("spine_length") > 0))
