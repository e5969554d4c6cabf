"""The whole jobs: building an index, and searching a library or a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extract, search, tree
from ..sources import books as b
from ..sources.page_store import PageStore
from ..sources.storage import stored


def build_index(raw: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages, terms) of raw pages (book_id, path, doc_pos, html). Page texts are never shuffled."""
    pages = extract.extract_pages(raw)
    return pages.drop("body"), extract.extract_terms(pages.select("book_id", "path", "doc_pos", "title", "body"), exact=exact)


def reindex(raw: DataFrame, shelf: DataFrame, store: PageStore) -> DataFrame:
    """Rebuilds the pages of books that need an index, and gives the shelf with its states after that.

    raw has pages (book_id, path, doc_pos, html). A book is ready when all its pages that can be indexed are in
    the store, else its state is error; index_done and index_total say how many. Ready books are not touched.
    """
    todo = stored(search.needs_index(shelf).select(F.col("id").alias("book_id")))
    own = extract.indexable(raw.join(todo, "book_id", "left_semi").withColumn("length", F.octet_length("html").cast("long"))).drop("length")
    store.rebuild(extract.extract_pages(own).drop("body"), todo)
    total = own.groupBy("book_id").agg(F.count("*").alias("_total"))
    done = store.read().join(todo, "book_id", "left_semi").groupBy("book_id").agg(F.count("*").alias("_done"))
    counts = todo.join(total, "book_id", "left").join(done, "book_id", "left").select(F.col("book_id").alias("id"), F.coalesce("_total", F.lit(0)).alias("_total"), F.coalesce("_done", F.lit(0)).alias("_done"))
    both = shelf.drop("index_done", "index_total").join(counts, "id", "left")
    state = F.when(F.col("_total").isNull(), F.col("index_state")).when(F.col("_done") == F.col("_total"), "ready").otherwise("error")
    return both.withColumn("index_state", state).withColumnsRenamed({"_done": "index_done", "_total": "index_total"})


def shelf_order(shelf: DataFrame) -> DataFrame:
    """Books with their place on the shelf."""
    return shelf.withColumn("shelf_pos", F.row_number().over(Window.orderBy(b.shelf_time().desc(), "id")))


def search_library(pages: DataFrame, terms: DataFrame, shelf: DataFrame, q: str) -> DataFrame:
    """Quick hits of all terms and text hits of indexed books, grouped by book in shelf order."""
    order = shelf_order(shelf)
    quick = search.quick_search_library(terms, q)
    full = search.search_library(pages, search.indexed_books(order), q, limit=150)
    return search.library_grouped_results(quick, full, order)


def search_book(raw: DataFrame, spine: DataFrame, index: DataFrame, terms: DataFrame, q: str, scope: DataFrame | None = None) -> DataFrame:
    """Quick and text hits of one book (or scope of it), merged."""
    return search.merged_results(search.quick_search_book(spine, index, terms, q, scope), search.full_text_search(raw, q, 100, scope))


def book_summary(raw: DataFrame, spine: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """book_id, entry_count, docs, size, spine_length, landing. defaults (book_id, path): pages that books name as their first.

    A book without contents reads its content pages in order; a book that has neither has no spine.
    """
    size = F.octet_length("html")
    docs = raw.groupBy("book_id").agg(F.count("*").alias("entry_count"), F.sum(t.is_content_page("path", size).cast("int")).alias("docs"), F.sum(size.cast("long")).alias("size"))
    content = raw.filter(t.is_content_page("path", size))
    full = tree.fallback_spine(spine, content)
    length = full.groupBy("book_id").agg(F.count("*").alias("spine_length"))
    return docs.join(length, "book_id", "left").join(tree.landing_page(raw, full, defaults, content).withColumnRenamed("path", "landing"), "book_id", "left").withColumn("spine_length", F.coalesce("spine_length", F.lit(0)))
