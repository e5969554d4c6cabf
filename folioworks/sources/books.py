"""Reading page files, and the tables of books, pages and terms as sets of keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t

PAGE_KEYS, TERM_KEYS = ["book_id", "path"], ["book_id", "term_id"]


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, path, length, modified, content of all files below folder; the first folder is the book."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inner = F.regexp_extract("path", r"^.*" + f"{folder.rstrip('/').rsplit('/', 1)[-1]}" + r"/(.*)$", 1)
    return files.select(F.element_at(F.split(inner, "/"), 1).alias("book_id"), F.concat(F.lit("/"), F.regexp_replace(inner, "^[^/]*/", "")).alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def write_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by book; with dynamic overwrite a rewritten book replaces itself only."""
    pages.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(x).desc() for x in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of batch replace those of the same key; within the batch the last by order counts. Idempotent."""
    new = last_by(batch, keys, order).select(*existing.columns)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without_books(rows: DataFrame, ids: DataFrame, column: str = "book_id") -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_anti")


def clear_book_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages without those of the books; their terms stay."""
    return without_books(pages, ids)


def clear_book_index(pages: DataFrame, terms: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return without_books(pages, ids), without_books(terms, ids)


def delete_books(books: DataFrame, files: DataFrame, pages: DataFrame, terms: DataFrame, ids: DataFrame) -> tuple[DataFrame, ...]:
    return (without_books(books, ids, "id"), *(without_books(x, ids) for x in (files, pages, terms)))


def all_terms(terms: DataFrame) -> DataFrame:
    return terms.orderBy("book_id", "term_id")


def count_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg(F.count("*").alias("pages"))


def shelf_time() -> Column:
    """When a book counts as used: last opened, else added; 0 and null fall through."""
    return F.coalesce(F.nullif(F.col("last_opened"), F.lit(0)), F.nullif(F.col("added_at"), F.lit(0)), F.lit(0))


def list_books(books: DataFrame) -> DataFrame:
    return books.orderBy(shelf_time().desc(), "id")


def get_book(books: DataFrame, book_id) -> DataFrame:
    return books.filter(F.col("id") == book_id)


def patch_books(books: DataFrame, patches: DataFrame, order: str = "seq") -> DataFrame:
    """Fields given in patches win, the last one of each; patches of unknown books are ignored."""
    fields = [x for x in patches.columns if x not in ("id", order) and x in books.columns]
    folded = patches.groupBy("id").agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias(f"_p_{x}") for x in fields])
    return books.join(folded, "id", "left").select(*[F.coalesce(f"_p_{x}", x).alias(x) if x in fields else F.col(x) for x in books.columns])


def save_to_shelf(books: DataFrame, opened: DataFrame, now: int) -> DataFrame:
    """Opened files become books, or refresh theirs: a custom title stays, sizes and counts are new."""
    old = books.select(*[F.col(x).alias(f"_o_{x}") for x in books.columns])
    both = old.join(opened, F.col("_o_id") == F.col("id"), "full")
    fresh = F.col("id").isNotNull()
    own = {"id": F.coalesce("id", "_o_id"), "last_opened": F.when(fresh, F.lit(now)).otherwise(F.col("_o_last_opened")), "added_at": F.coalesce("_o_added_at", F.when(fresh, F.lit(now)))}
    own["title"] = F.when(F.col("_o_custom_title"), F.col("_o_title")).otherwise(F.coalesce("title", "_o_title"))
    own["custom_title"] = F.coalesce("_o_custom_title", F.lit(False))
    for x in books.columns:
        if x not in own:
            own[x] = F.coalesce(F.col(x), F.col(f"_o_{x}")) if x in opened.columns else F.col(f"_o_{x}")
    return both.select(*[own[x].alias(x) for x in books.columns])


def file_catalogue(files: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("book.chm"))
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("application/vnd.ms-htmlhelp"))
    return files.select("book_id", name.alias("name"), kind.alias("type"), F.coalesce("last_modified", F.lit(0)).alias("last_modified"), F.coalesce("size", F.lit(0)).alias("size"))


def rename_book(books: DataFrame, book_id, title: str) -> DataFrame:
    """Sets a custom title; an empty one is refused."""
    new = t.rename(F.lit(title))
    hit = (F.col("id") == book_id) & new.isNotNull()
    return books.withColumns({"title": F.when(hit, new).otherwise(F.col("title")), "custom_title": F.when(hit, F.lit(True)).otherwise(F.col("custom_title"))})


# --- the driver's tables as this library's ------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id (host), path, doc_pos, html of the table pages; the path ends in .html."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1), "/$", ""), r"(\.html)?$", ".html")
    return table(spark, sf_dir, "pages").select(host.alias("book_id"), F.regexp_replace(path, r"\.html\.html$", ".html").alias("path"), F.col("page_id").alias("doc_pos"), "html")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id (source), path, title (first line), text, doc_pos of the table documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("book_id"), F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.element_at(F.split("text", "\n"), 1).alias("title"), "text", F.col("doc_id").alias("doc_pos"))


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id (brand), label, path, doc_pos of the table part."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_id"), F.col("p_name").alias("label"), F.concat(F.lit("/part/"), F.col("p_partkey").cast("string"), F.lit(".html")).alias("path"), F.col("p_partkey").alias("doc_pos"), F.col("p_type").alias("kind"))


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, last_opened, added_at, title, size, index_state of books made from the sources of documents."""
    d = table(spark, sf_dir, "documents")
    n = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    return d.groupBy("source").agg(F.count("*").alias("page_count"), F.sum("n_chars").alias("size")).select(F.col("source").alias("id"), F.concat(F.lit("Book "), "source").alias("title"), F.lit(False).alias("custom_title"), "size", "page_count", F.when(n % 5 == 4, "error").when(n % 5 == 3, "building").otherwise("ready").alias("index_state"), F.when(n % 5 == 3, F.lit(3)).otherwise(F.lit(0)).alias("index_done"), (n * 1000).alias("added_at"), F.when(n % 3 == 0, n * 5000).otherwise(F.lit(0)).alias("last_opened"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reader_id, seq, ts (ms), kind (visit, toggle, back, forward), path, title of the table events."""
    return activity_of(table(spark, sf_dir, "events"))


def activity_of(e: DataFrame) -> DataFrame:
    """The same of rows of events, a table's or a stream's."""
    kind = F.when(F.col("event_type") == "view", "visit").when(F.col("event_type") == "click", "toggle").when(F.col("event_type") == "purchase", "back").when(F.col("event_type") == "signup", "forward")
    path = F.concat(F.lit("/k/"), F.get_json_object("props", "$.k"), F.lit(".html"))
    return e.select(F.col("user_id").alias("reader_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("title"))


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, seq, type (done, error, progress), done, total of the table events."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("progress")
    return e.select(F.col("user_id").alias("book_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.floor(F.abs("value")).cast("long").alias("done"), F.lit(500).alias("total"))


def toc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, node_id, parent_id, pos (preorder), depth, name, local, locals, ancestors: region, nation, customer as one book."""
    r, n, cu = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    none = F.array().cast("array<long>")
    rows = r.select((F.col("r_regionkey").cast("long") * 10_000_000_000).alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("depth"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("local"), none.alias("ancestors"))
    region = F.col("n_regionkey").cast("long") * 10_000_000_000
    nation = region + (F.col("n_nationkey").cast("long") + 1) * 100_000_000
    rows = rows.unionByName(n.select(nation.alias("node_id"), region.alias("parent_id"), F.lit(1).alias("depth"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("local"), F.array(region).alias("ancestors")))
    c = cu.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.unionByName(c.select((nation + F.col("c_custkey") + 1).alias("node_id"), nation.alias("parent_id"), F.lit(2).alias("depth"), F.col("c_name").alias("name"), F.concat(F.lit("/customer/"), F.col("c_custkey").cast("string"), F.lit(".html")).alias("local"), F.array(region, nation).alias("ancestors")))
    return rows.select(F.lit("world").alias("book_id"), "*", F.col("node_id").alias("pos"), F.when(F.col("local").isNotNull(), F.array("local")).otherwise(F.array().cast("array<string>")).alias("locals"))
