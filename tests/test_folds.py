"""Folds keep each key in one task, whatever the plan below them."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from folioworks.operators import extract, folds


def seen():
    class Seen(folds.Fold):
        """The task, and the order of the numbers that one state saw."""

        def __init__(self):
            self.rows, self.key = [], None

        def step(self, row):
            self.key = row["k"]
            self.rows.append(row["n"])
            return ()

        def end(self):
            yield {"k": self.key, "task": TaskContext.get().partitionId(), "rows": self.rows}

    return Seen  # made here, so that tasks get it by value


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("task", T.IntegerType()), T.StructField("rows", T.ArrayType(T.LongType()))])


def below(spark, kind, rows, few):
    """Rows (k, n) that a union, joins or an aggregate have dealt by k."""
    if kind == "union":
        return rows.repartition("k").unionByName(rows.withColumn("n", F.col("n") + 1000).repartition("k"))
    if kind == "semi":
        return rows.unionByName(rows.withColumn("n", F.col("n") + 1000)).join(few, "k", "left_semi")
    if kind == "unions of joins":
        return rows.join(few, "k", "left_semi").unionByName(rows.withColumn("n", F.col("n") + 1000).join(few, "k", "left_semi"))
    each = rows.groupBy("k").agg(F.collect_list("n").alias("l")).select("k", F.explode("l").alias("n"))
    return each.unionByName(rows.withColumn("n", F.col("n") + 1000))


@pytest.mark.parametrize("kind", ["union", "semi", "unions of joins", "aggregate"])
@pytest.mark.parametrize("threshold", ["1", "10485760"])
def test_a_key_is_in_one_task(spark, tmp_path, kind, threshold):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(7)}", i) for i in range(200)]
    spark.createDataFrame(rows, "k string, n long").repartition(5).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(f"k{i}",) for i in range(7)] * 20, "k string").write.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10485760")
    try:
        data = below(spark, kind, spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "f")).distinct())
        got = folds.fold_by_key(data, "k", ["n"], seen(), SCHEMA).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    want = {}
    for k, n in rows:
        want.setdefault(k, []).extend([n, n + 1000])
    assert {r.k: r.rows for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)


@pytest.mark.parametrize("threshold", ["1", "10485760"])
def test_exact_cap_in_the_plans_of_an_index(spark, tmp_path, threshold):
    """Pages over the cap in files, with joins that become broadcasts only at run time."""
    page = lambda i: f"<title>Page {i}</title><body>" + "".join(f"<h2>Head {(7 * i + k) % 300}</h2>" for k in range(60)) + "</body>"
    spark.createDataFrame([(f"b{i % 2}", f"/{i}", i, page(i) if i % 3 else "<title>x</title>") for i in range(60)], "book_id string, path string, doc_pos int, html string").repartition(6).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10485760")
    try:
        got = extract.extract_terms(extract.extract_pages(spark.read.parquet(str(tmp_path / "p"))), exact=True).select("book_id", "path", "label").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    seen, want = set(), []
    for i in range(60):
        n, labels = 0, [f"Page {i}", *[f"Head {(7 * i + k) % 300}" for k in range(60)]] if i % 3 else [""]
        for x in labels:
            if n < 40 and len(x) > 1 and (i % 2, x.lower()) not in seen:
                seen.add((i % 2, x.lower()))
                n += 1
                want.append((f"b{i % 2}", f"/{i}", x))
    assert sorted(map(tuple, got)) == sorted(want)
