"""Quick and full-text search, and what is done with hits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.storage import stored


def _query(q) -> Column:
    return F.lit(q) if isinstance(q, str) else q


# --- occurrences --------------------------------------------------------------------


def occurrence_count(text, q) -> Column:
    """Non-overlapping hits of q, whatever the case."""
    low, q = F.lower(t._c(text)), F.lower(_query(q))
    return F.when(F.length(q) > 0, ((F.length(low) - F.length(F.replace(low, q, F.lit("")))) / F.length(q)).cast("int")).otherwise(F.lit(0))


def match_positions(low, q) -> Column:
    """Start positions (from 0) of q in low, left to right, non-overlapping."""
    low, q = t._c(low), _query(q)
    parts = F.split(low, F.concat(F.lit("\\Q"), F.replace(q, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    none = F.array().cast("array<int>")
    # each part but the last ends where a hit begins
    walk = F.aggregate(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda s, p: F.struct((s["at"] + F.length(p) + F.length(q)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found")),
    )
    return walk["found"]


def _snippets(text, positions, q, before: int, after: int, most: int, trimmed: bool) -> Column:
    def one(p, i):
        cut = F.substr(t._c(text), F.greatest(p - before, F.lit(0)) + 1, p + F.length(_query(q)) + after - F.greatest(p - before, F.lit(0)))
        return F.struct(i.alias("occurrence_index"), (t.trim(cut) if trimmed else cut).alias("snippet"))

    return F.transform(F.slice(positions, 1, most), one)


def snippets_live(text, positions, q, most: int = 60) -> Column:
    return _snippets(text, positions, q, 60, 120, most, False)


def snippets_library(text, q, most: int = 4) -> Column:
    return _snippets(text, match_positions(F.lower(t._c(text)), F.lower(_query(q))), q, 55, 115, most, True)


def nth_occurrence_span(text, q, n) -> Column:
    """STRUCT<start, end> of occurrence n, the last one if there are fewer; null without any."""
    found = match_positions(F.lower(t._c(text)), F.lower(_query(q)))
    start = F.element_at(found, F.least(F.greatest(F.lit(n), F.lit(0)) + 1, F.size(found)))
    return F.when(F.size(found) > 0, F.struct(start.alias("start"), (start + F.length(_query(q))).alias("end")))


def highlight(text, q, n=0) -> Column:
    span = nth_occurrence_span(text, q, n)
    x = t._c(text)
    marked = F.concat(F.substr(x, F.lit(1), span["start"]), F.lit("<mark>"), F.substr(x, span["start"] + 1, span["end"] - span["start"]), F.lit("</mark>"), F.substr(x, span["end"] + 1, F.length(x)))
    return F.coalesce(marked, x)


# --- scores -------------------------------------------------------------------------


def score_quick(keys, label, q: str) -> Column:
    q = F.lit(t.normalized(q))
    own, keys = t.normalize_search(label), F.coalesce(t._c(keys), F.array().cast("array<string>"))
    some = lambda test: F.exists(keys, test)
    return (
        F.when(q == "", 0)
        .when(own == q, 140)
        .when(some(lambda k: k == q), 135)
        .when(own.startswith(q), 112)
        .when(some(lambda k: k.startswith(q)), 108)
        .when(own.contains(q), 86)
        .when(some(lambda k: k.contains(q)), 82)
        .otherwise(0)
    )


def _score_name(name, q: str, equal: int, prefix: int, inside: int) -> Column:
    low, q = F.lower(t._c(name)), F.lower(F.lit(q.strip()))
    return F.when(q == "", 0).when(low == q, equal).when(low.startswith(q), prefix).when(low.contains(q), inside).otherwise(0)


def score_toc(name, q: str) -> Column:
    return _score_name(name, q, 120, 95, 70)


def score_index(name, q: str) -> Column:
    return _score_name(name, q, 110, 90, 68)


# --- searches -----------------------------------------------------------------------


def quick_search_library(terms: DataFrame, q: str, limit: int = 160) -> DataFrame:
    """Terms by score, then title, then key. Only scored rows are sorted, and only `limit` of them leave a task."""
    scored = terms.withColumn("score", score_quick("keys", "label", q)).filter("score > 0").withColumn("title", F.col("label"))
    return scored.orderBy(F.col("score").desc(), F.collate("title", "UNICODE"), "title", "book_id", "term_id").limit(limit)


def in_scope(rows: DataFrame, scope: DataFrame | None, path: str = "path") -> DataFrame:
    """Rows whose path is in the scope; no scope keeps all."""
    if scope is None:
        return rows
    norm = lambda c: F.lower(F.coalesce(t.normalize_path(F.lit("/"), F.col(c)), F.col(c)))
    allowed = scope.select(norm("path").alias("_scope")).distinct()
    return rows.join(allowed, norm(path) == F.col("_scope"), "left_semi")


def union_sources(spine: DataFrame, index: DataFrame, terms: DataFrame, q: str) -> DataFrame:
    """Hits of contents, keyword index and terms in one pool, with their source and place."""
    toc = spine.select(F.col("local").alias("path"), F.coalesce("name", "local").alias("title"), score_toc(F.coalesce("name", "local"), q).alias("score"), F.lit("目录").alias("source"), F.lit("").alias("anchor"), F.lit(None).cast("string").alias("target_query"), F.lit(0).alias("source_no"), F.col("pos").cast("long").alias("place"))
    idx = index.select(F.get("targets", F.lit(0)).alias("path"), F.col("name").alias("title"), score_index("name", q).alias("score"), F.lit("索引").alias("source"), F.lit("").alias("anchor"), F.lit(None).cast("string").alias("target_query"), F.lit(1).alias("source_no"), F.col("pos").cast("long").alias("place"))
    score = score_quick("keys", "label", q)
    own = terms.select("path", F.col("label").alias("title"), F.when(score > 0, score + 8).otherwise(0).alias("score"), "source", F.coalesce("anchor", F.lit("")).alias("anchor"), F.coalesce("search_text", "label").alias("target_query"), F.lit(2).alias("source_no"), F.col("pos").cast("long").alias("place"))
    return toc.unionByName(idx).unionByName(own).filter("score > 0 and path is not null and path != ''")


def best_per_key(hits: DataFrame) -> DataFrame:
    """Per path (whatever the case) and anchor the best hit; of equals the first source, then the first place."""
    rest = [x for x in hits.columns if x not in ("score", "source_no", "place")]
    best = F.max(F.struct("score", (-F.col("source_no")).alias("s"), (-F.col("place")).alias("p"), F.struct(*rest).alias("row")))
    x = hits.groupBy(F.lower("path").alias("_p"), "anchor").agg(best.alias("x"))
    return x.select(*[F.col(f"x.row.{c}").alias(c) for c in rest], F.col("x.score").alias("score"), (-F.col("x.s")).alias("source_no"), (-F.col("x.p")).alias("place"))


def quick_search_book(spine: DataFrame, index: DataFrame, terms: DataFrame, q: str, scope: DataFrame | None = None, limit: int = 80) -> DataFrame:
    hits = best_per_key(in_scope(union_sources(spine, index, terms, q), scope))
    return hits.orderBy(F.col("score").desc(), F.collate("title", "UNICODE"), "title", "source_no", "place").limit(limit)


def full_text_search(raw: DataFrame, q: str, limit: int = 80, scope: DataFrame | None = None, most: int = 60) -> DataFrame:
    """Live search of pages (book_id, path, doc_pos, html): the first `limit` pages in page order that contain q."""
    q = q.strip().lower()
    rows = raw if scope is None else raw.join(scope.select(F.lower("path").alias("_s"), F.col("pos").alias("_pos")), F.lower("path") == F.col("_s")).withColumn("doc_pos", F.col("_pos"))
    if len(q) < 2:
        rows = rows.filter("false")
    body = rows.filter(F.octet_length("html") <= 16 << 20).select("book_id", "path", "doc_pos", t.page_title_search("html", "path").alias("title"), t.search_text(t.page_body("html")).alias("text"))
    found = body.withColumn("low", F.lower("text")).filter(F.col("low").contains(q)).withColumn("found", match_positions("low", q))
    hits = found.select("book_id", "path", "doc_pos", "title", F.size("found").alias("occurrence_total"), snippets_live("text", "found", q, most).alias("matches"))
    return hits.orderBy("doc_pos", "book_id", "path").limit(limit)


def search_library(pages: DataFrame, books: DataFrame, q: str, limit: int = 120, most: int = 6) -> DataFrame:
    """Stored pages that contain q, in shelf order, then by path; totals count the shown matches."""
    q = q.strip().lower()
    shelf = books.select(F.col("id").alias("book_id"), "shelf_pos")
    rows = pages.filter(F.lower("text").contains(q) if len(q) >= 2 else F.lit(False)).join(shelf, "book_id")
    hits = rows.select("book_id", "shelf_pos", "path", "title", snippets_library("text", q, most).alias("matches")).withColumn("occurrence_total", F.size("matches"))
    return hits.orderBy("shelf_pos", "path").limit(limit)


def _grams(x: Column, n: int) -> Column:
    """Distinct runs of n characters, by one pass of a pattern that looks ahead at each place."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def _word_grams(x: Column) -> Column:
    """Distinct runs of eight characters at the start of a word, with the character before it."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?s)(?=([^\p{L}\p{N}][\p{L}\p{N}].{6}))"), 1))


def _rarest_gram_pairs(low: DataFrame, queries: DataFrame, grams) -> DataFrame:
    """book_id, path, query_id, q where the page has the query's rarest gram. Grams of pages are taken once; those of no query end at the semi join."""
    wanted = queries.select("query_id", "q", F.explode(grams(F.col("q"))).alias("gram"))
    found = stored(low.select("book_id", "path", F.explode(grams(F.col("low"))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"))
    weight = found.groupBy("gram").agg(F.count("*").alias("n"))
    rare = wanted.join(weight, "gram", "left").groupBy("query_id", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return found.join(rare, "gram").select("book_id", "path", "query_id", "q")


#: Pairs of page and query, and their bytes, that are broadcast at most.
BROADCAST_PAIRS, BROADCAST_BYTES = 200_000, 32 << 20


def batch_search(pages: DataFrame, queries: DataFrame, few: int = 64) -> DataFrame:
    """query_id, book_id, path, occurrence_total for a whole table of queries.

    Up to `few` queries (counted) are broadcast and tested on every page. More queries go
    by their rarest gram: pages and queries meet by equality on it, and a test of the text
    follows. Where a query has a word's start inside, its grams are eight characters from
    there, of which a page has few; else three characters (or two, if it has no more).
    Texts are not shuffled while the pairs to test are few enough to broadcast.
    """
    queries = queries.select("query_id", F.lower(t.trim(F.col("q"))).alias("q")).filter(F.length("q") >= 2)
    low = pages.select("book_id", "path", F.lower("text").alias("low"))
    out = ["query_id", "book_id", "path", occurrence_count("low", F.col("q")).alias("occurrence_total")]
    if queries.limit(few + 1).count() <= few:
        return low.join(F.broadcast(queries), F.col("low").contains(F.col("q"))).select(*out)
    kind = F.when(F.size(_word_grams(F.col("q"))) > 0, "words").when(F.length("q") > 2, "three").otherwise("two")
    queries = stored(queries.withColumn("kind", kind))
    kinds = {r["kind"] for r in queries.select("kind").distinct().collect()}
    # a query of two characters is a gram itself
    grams = {"words": _word_grams, "three": lambda x: _grams(x, 3), "two": lambda x: _grams(x, 2)}
    found = [_rarest_gram_pairs(low, queries.filter(F.col("kind") == k), grams[k]) for k in sorted(kinds)]
    pairs = stored(functools.reduce(DataFrame.unionByName, found).distinct())
    size = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("q") + F.octet_length("path") + F.octet_length("book_id")), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= BROADCAST_PAIRS and size["bytes"] <= BROADCAST_BYTES
    return low.join(F.broadcast(pairs) if small else pairs, ["book_id", "path"]).filter(F.col("low").contains(F.col("q"))).select(*out)


# --- hits ---------------------------------------------------------------------------


def hit_summary(hits: DataFrame) -> DataFrame:
    shown = F.coalesce(F.col("occurrence_total"), F.size("matches"), F.lit(1))
    return hits.agg(F.count("*").alias("pages"), F.coalesce(F.sum(shown), F.lit(0)).alias("occurrences"))


def hits_with_books(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Hits with their shelf record; those of unknown books go."""
    return hits.join(books.withColumnRenamed("id", "book_id").withColumnRenamed("title", "book_title"), "book_id")


def group_by_book(hits: DataFrame) -> DataFrame:
    return hits.groupBy("book_id").agg(F.count("*").alias("hits"))


def cap_per_book(hits: DataFrame, order: list, most: int = 45) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy(*order)
    return hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)


def explode_matches(hits: DataFrame) -> DataFrame:
    """One row for each shown match; a hit without matches gives one with an empty snippet."""
    none = F.array(F.struct(F.lit(0).alias("occurrence_index"), F.lit("").alias("snippet")))
    return hits.withColumn("m", F.explode(F.when(F.size("matches") > 0, F.col("matches")).otherwise(none))).select("*", "m.occurrence_index", "m.snippet").drop("m", "matches")


def running_cap(hits: DataFrame, order: list[str], most: int = 180) -> DataFrame:
    """The first matches over all hits; of equal (path, occurrence) the first hit's."""
    rows = explode_matches(hits)
    w = Window.partitionBy(F.lower("path"), "occurrence_index").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(*order, "occurrence_index").limit(most)


def distinct_hits(hits: DataFrame, order: list) -> DataFrame:
    w = Window.partitionBy(F.lower("path"), F.coalesce("anchor", F.lit(""))).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def instant_minus_full(local: DataFrame, full: DataFrame) -> DataFrame:
    return local.join(full.select(F.lower("path").alias("_p")).distinct(), F.lower("path") == F.col("_p"), "left_anti")


def merged_results(local: DataFrame, full: DataFrame, instant: int = 60, most: int = 180) -> DataFrame:
    """section, path, title, occurrence_index: quick hits on pages without full-text hits, then the full-text matches."""
    order = [F.col("score").desc(), F.col("title"), F.col("path")]
    quick = distinct_hits(instant_minus_full(local, full), order).orderBy(*order).limit(instant)
    text = running_cap(full, ["doc_pos", "path"], most)
    return quick.select(F.lit("instant").alias("section"), "path", "title", F.lit(None).cast("int").alias("occurrence_index")).unionByName(text.select(F.lit("full").alias("section"), "path", "title", "occurrence_index"))


def library_grouped_results(quick: DataFrame, full: DataFrame, books: DataFrame, most: int = 45) -> DataFrame:
    """kind, shelf_pos, n, book_id, path, title: at most 45 rows of each book and kind, quick ones by score, texts by match."""
    q = cap_per_book(quick.join(books.select(F.col("id").alias("book_id"), "shelf_pos"), "book_id"), [F.col("score").desc(), "title", "term_id"], most)
    f = cap_per_book(explode_matches(full), ["path", "occurrence_index"], most)
    keep = ["shelf_pos", "n", "book_id", "path", "title"]
    return q.select(F.lit("quick").alias("kind"), *keep).unionByName(f.select(F.lit("full").alias("kind"), *keep))


def filter_entries(items: DataFrame, q: str, name: str = "name") -> DataFrame:
    q = q.strip().lower()
    return items.filter(F.lower(name).contains(q)) if q else items


def indexed_books(books: DataFrame) -> DataFrame:
    return books.filter((F.col("index_state") == "ready") | (F.coalesce("index_done", F.lit(0)) > 0))


def needs_index(books: DataFrame) -> DataFrame:
    return books.filter(~F.col("index_state").eqNullSafe("ready"))


def resolve_entries(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """refs with the entry (path as stored) that path means, or else raw; the last of entries that differ in case counts."""
    known = entries.groupBy("book_id", F.lower("path").alias("_k")).agg(F.max_by("path", "entry_pos").alias("_found"))
    two = refs.withColumn("_n", F.lower(F.coalesce(t.normalize_path(F.lit("/"), F.col("raw")), F.col("raw")))).withColumn("_r", F.lower("raw"))
    a = two.join(known.withColumnsRenamed({"_k": "_n", "_found": "_a"}), ["book_id", "_n"], "left")
    b = a.join(known.withColumnsRenamed({"_k": "_r", "_found": "_b"}), ["book_id", "_r"], "left")
    return b.withColumn("entry", F.coalesce("_a", "_b")).drop("_n", "_r", "_a", "_b")


def broken_refs(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Internal references that no entry answers."""
    known = entries.select("book_id", F.lower("path").alias("_k")).distinct()
    inner = links.filter("kind = 'internal'")
    return inner.join(known, (inner["book_id"] == known["book_id"]) & (F.lower(inner["target_path"]) == known["_k"]), "left_anti")
