"""What readers did (reader_id, seq, ts, kind, path, title), and the state of indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from . import folds

LISTS = "array<struct<path:string,title:string,ts:bigint>>"


def recent_pages(visits: DataFrame, most: int = 40) -> DataFrame:
    """reader_id, n, path, title, ts: the last visit of each page, newest first."""
    latest = visits.groupBy("reader_id", F.lower("path").alias("_p")).agg(F.max(F.struct("ts", "seq", "path", "title")).alias("x")).select("reader_id", "x.*")
    w = Window.partitionBy("reader_id").orderBy(F.col("ts").desc(), F.col("seq").desc())
    return latest.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("reader_id", "n", "path", F.coalesce("title", t.last_segment("path")).alias("title"), "ts")


class _Marks(folds.Fold):
    def __init__(self, most: int):
        self.most, self.marks, self.reader = most, {}, None  # newest last

    def step(self, row):
        self.reader, key = row["reader_id"], row["_p"]
        if self.marks.pop(key, None) is None:
            self.marks[key] = (row["path"], row["ts"])
            if len(self.marks) > self.most:
                del self.marks[next(iter(self.marks))]
        return ()

    def end(self):
        for n, (path, ts) in enumerate(reversed(self.marks.values()), 1):
            yield {"reader_id": self.reader, "n": n, "path": path, "ts": ts}


def bookmarks(toggles: DataFrame, most: int = 120) -> DataFrame:
    """reader_id, n, path, ts: a toggle adds a page in front or removes it; what a full list drops can be added again.

    Readers who toggled at most `most` different pages never fill the list, so theirs comes
    from aggregates that combine before the shuffle, however long the history. The others'
    toggles are folded in order; a fold's state is the list.
    """
    rows = toggles.filter("path is not null").select("reader_id", "seq", "ts", "path", F.lower("path").alias("_p"))
    pages = rows.groupBy("reader_id", "_p").agg(F.count("*").alias("_n"), F.max(F.struct("ts", "seq", "path")).alias("x"))
    many = pages.groupBy("reader_id").agg(F.count("*").alias("_all")).filter(F.col("_all") > most).select(F.col("reader_id").alias("_r"))
    over = F.col("reader_id").eqNullSafe(F.col("_r"))
    newest = F.row_number().over(Window.partitionBy("reader_id").orderBy(F.col("x.ts").desc(), F.col("x.seq").desc()))
    few = pages.filter("_n % 2 = 1").join(many, over, "left_anti").select("reader_id", newest.alias("n"), "x.path", "x.ts")
    long = rows.join(many, over, "left_semi")
    schema = T.StructType([toggles.schema["reader_id"], T.StructField("n", T.IntegerType()), toggles.schema["path"], toggles.schema["ts"]])
    return few.unionByName(folds.fold_by_key(long, "reader_id", ["ts", "seq"], lambda: _Marks(most), schema))


def bookmarks_below_cap(toggles: DataFrame) -> DataFrame:
    """reader_id, path, ts of bookmarks by parity of toggles: for readers who never had more than the cap."""
    return toggles.groupBy("reader_id", F.lower("path").alias("_p")).agg(F.count("*").alias("n"), F.max(F.struct("ts", "seq", "path")).alias("x")).filter("n % 2 = 1").select("reader_id", "x.path", "x.ts")


def history_pushes(visits: DataFrame, same: tuple[str, ...] = ("path",)) -> DataFrame:
    """Visits that differ from the one before in what makes an entry."""
    w = Window.partitionBy("reader_id").orderBy("ts", "seq")
    first = F.row_number().over(w) == 1
    equal = F.lit(True)
    for x in same:
        value = F.lower(x) if x == "path" else F.col(x)
        equal = equal & value.eqNullSafe(F.lag(value).over(w))
    return visits.withColumn("_push", first | ~equal).filter("_push").drop("_push")


class _Stack(folds.Fold):
    def __init__(self):
        self.stack, self.at, self.reader = [], -1, None  # entries: path, and its lower case

    def step(self, row):
        self.reader, path = row["reader_id"], row["path"]
        if row["kind"] == "visit":
            if path is not None and (self.at < 0 or self.stack[self.at][1] != row["_p"]):
                self.at += 1
                del self.stack[self.at :]
                self.stack.append((path, row["_p"]))
        else:
            to = self.at + (1 if row["kind"] == "forward" else -1)
            if 0 <= to < len(self.stack):
                self.at = to
        return ()

    def end(self):
        for i, (path, _) in enumerate(self.stack):
            yield {"reader_id": self.reader, "n": i + 1, "path": path, "current": i == self.at}


def history_stack(moves: DataFrame) -> DataFrame:
    """reader_id, n, path, current: entries after all visits and moves; a visit cuts what lies ahead, one without a path does nothing.

    Folded in order; a fold's state is the stack, which is the reader's result.
    """
    schema = T.StructType([moves.schema["reader_id"], T.StructField("n", T.IntegerType()), moves.schema["path"], T.StructField("current", T.BooleanType())])
    rows = moves.filter("kind in ('visit', 'back', 'forward')").select("reader_id", "seq", "ts", "kind", "path", F.lower("path").alias("_p"))
    return folds.fold_by_key(rows, "reader_id", ["ts", "seq"], _Stack, schema)


def latest_status(status: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """book_id, state, done, total: the last message of each book; unknown books are left out."""
    rows = status if books is None else status.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    last = rows.groupBy("book_id").agg(F.max(F.struct("seq", "type", "done", "total")).alias("x"))
    state = F.when(F.col("x.type") == "done", "ready").when(F.col("x.type") == "error", "error").otherwise("building")
    return last.select("book_id", state.alias("state"), F.col("x.done").alias("done"), F.col("x.total").alias("total"))


def index_progress(status: DataFrame) -> DataFrame:
    return latest_status(status).withColumn("percent", t.percent("done", "total"))


def drop_stale(responses: DataFrame, session: str, generation: str) -> DataFrame:
    """Responses of the newest generation of each session."""
    newest = responses.groupBy(session).agg(F.max(generation).alias(generation))
    return responses.join(newest, [session, generation], "left_semi")


def lists_to_json(lists: DataFrame, order: str = "n") -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(order, F.struct("path", "title", "ts").alias("item"))))
    return lists.groupBy("reader_id").agg(F.to_json(F.transform(items, lambda x: x["item"])).alias("json"))


def lists_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Items of lists kept as JSON; what is no list reads as empty."""
    return rows.withColumn("items", F.coalesce(F.when(F.col(column).rlike(r"^\s*\["), F.from_json(column, LISTS)), F.array().cast(LISTS)))
