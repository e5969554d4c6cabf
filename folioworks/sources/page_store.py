"""A store of pages by book that is rebuilt while it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PageStore:
    """Pages (book_id and other columns) in Parquet files, by version.

    A rebuild writes the new pages of its books beside the old ones, and when they are whole
    one more row for each book, in one file, that names their version. A reader takes of each book the version
    that is named last, so it sees a book's old pages or its new ones, never some of both,
    and nothing of a rebuild that failed. Other books are not touched. One rebuild at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.pages, self.log = spark, f"{path}/pages", f"{path}/log"

    def _versions(self) -> DataFrame | None:
        """book_id, version of all rebuilds, or None before the first."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return None
        return self.spark.read.schema("book_id string, version long").parquet(self.log)

    def rebuild(self, pages: DataFrame, books: DataFrame | None = None) -> None:
        """Pages replace all that their books had. books (book_id) may name more books, which then have no pages."""
        known = self._versions()
        version = 0 if known is None else (known.agg(F.max("version")).first()[0] or 0) + 1
        pages.write.mode("overwrite").parquet(f"{self.pages}/version={version}")
        named = (pages if books is None else books).select(F.col("book_id").cast("string").alias("book_id")).distinct()
        named.select("book_id", F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(self.log)

    def clear(self, books: DataFrame) -> None:
        """The books (book_id) have no pages any more."""
        self.rebuild(self.spark.read.parquet(self.pages).drop("version").limit(0), books)

    def read(self) -> DataFrame:
        """Each book's pages of its last whole rebuild."""
        newest = self._versions().groupBy(F.col("book_id").alias("_b")).agg(F.max("version").alias("_v"))
        rows = self.spark.read.parquet(self.pages)
        return rows.join(newest, F.col("book_id").cast("string").eqNullSafe(F.col("_b")) & (F.col("version") == F.col("_v")), "left_semi").drop("version")
