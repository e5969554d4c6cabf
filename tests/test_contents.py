"""Contents files: what a tree writes is what parsing reads, and lists that nest in odd ways."""

import random

from pyspark.sql import functions as F

from folioworks.operators import tree


def topic(name, *pages):
    return f'<LI><OBJECT type="text/sitemap"><param name="Name" value="{name}">' + "".join(f"<param name=Local value='{p}'>" for p in pages) + "</OBJECT>"


def grow(rng, depth):
    """(name, pages, children) of a few nodes."""
    return [(f"n{rng.randrange(10**6)}", [f"p{rng.randrange(99)}.htm" for _ in range(rng.randrange(3))], grow(rng, depth - 1) if depth and rng.random() < 0.6 else []) for _ in range(rng.randrange(1, 5))]


def written(rng, nodes):
    around = rng.choice([("<ul>", "</ul>"), ("<UL><b title='</ul>'>", "</b></UL>"), ("<menu><dir>", "</dir></menu>")])
    return around[0] + "".join(topic(n, *p) + (written(rng, c) if c else "") for n, p, c in nodes) + around[1]


def rows(nodes, above=(), out=None):
    out = [] if out is None else out
    for name, pages, children in nodes:
        me = len(out)
        paths = [f"/d/{p}" for p in pages]
        out.append((me, above[-1] if above else None, me, len(above), name, paths[0] if paths else None, paths, list(above)))
        rows(children, (*above, me), out)
    return out


def parsed(spark, texts):
    files = spark.createDataFrame([(f"b{i}", "/d/toc.hhc", t) for i, t in enumerate(texts)], "book_id string, base string, text string").repartition(3)
    out = {}
    for r in tree.parse_sitemap(files).orderBy("pos").collect():
        out.setdefault(r.book_id, []).append(tuple(r)[1:])
    return [out.get(f"b{i}", []) for i in range(len(texts))]


def test_trees(spark):
    rng = random.Random(1)
    trees = [grow(rng, rng.randrange(6)) for _ in range(25)]
    assert parsed(spark, [written(rng, x) for x in trees]) == [rows(x) for x in trees]


def test_odd_lists(spark):
    a, b, c, d = (topic(x) for x in "abcd")
    other = '<object type="image/x"><param name="Name" value="no"></object>'
    cases = {
        "</ul></ul>" + a + "<ul>" + b: "a0 b1",  # what closes too much closes nothing; an open end
        "<ul><ul>" + a + "</ul>" + b + "</ul>": "a0 b0",  # a list without an owner nests nothing
        a + "<ul><ul>" + b + "<ul>" + c + "</ul></ul>" + d: "a0 b1 c2 d1",
        a + "<ul>" + b + "</ul><ul>" + c + "</ul>" + d: "a0 b1 c1 d0",  # two lists of one owner
        "<ul>" + a + "</ul><ul>" + b + "</ul>": "a0 b0",  # the list after a closed one begins anew at the root
        "<ul>" + a + "<ul></ul></ul></ul></ul>" + b + "<ul>" + c: "a0 b0 c1",
        other + a + "</object>" + other: "a0",
        '<object type="text/sitemap"><param name="Name" value="x"><object type="text/sitemap"><param name="Name" value="a"></object>': "a0",
        topic("") + topic("", "a"): "a0",
        "": "",
    }
    got = parsed(spark, list(cases))
    assert [" ".join(f"{r[4]}{r[3]}" for r in x) for x in got] == list(cases.values())


def test_no_files(spark):
    files = spark.createDataFrame([("b", None, None)], "book_id string, base string, text string")
    assert tree.parse_sitemap(files).count() == tree.parse_sitemap(files.filter("false")).count() == 0


def test_a_file_is_read_once(spark):
    """The text of a file ends below the step that deals out its tags: above it, it would be hashed again for each of them."""
    files = spark.createDataFrame([("b", "/d/toc.hhc", topic("a"))], "book_id string, base string, text string").repartition(2)
    plan = tree._tag_rows(files)._jdf.queryExecution().optimizedPlan().toString()
    # from the top: tags of a block, blocks dealt anew, blocks of a file, and only below them its text
    places = [plan.index("Generate "), plan.index("RepartitionByExpression"), plan.rindex("Generate "), plan.index("xxhash64("), plan.index("text#")]
    assert plan.count("Generate ") == 2 and places[:3] == sorted(places[:3]) and min(places[3:]) > places[2]


def test_odd_tags(spark):
    """Tags with brackets in quotes; one that nothing ends is none."""
    a = "<object type='text/sitemap'><param title='x>y' name=\"Name\" value='<ul> &amp;lt; \">\"'></object >"
    cases = {a + '< UL class="a>b">' + topic("c") + "< / ul>" + topic("d"): "<ul> &lt; \">\"0 c1 d0", "<ul \"" + topic("a") + "</ul>": "a0", topic("b") + "<ul '>'" + topic("a"): "b0 a1"}
    got = parsed(spark, list(cases))
    assert [" ".join(f"{r[4]}{r[3]}" for r in x) for x in got] == list(cases.values())


def test_tags_of_one_file_are_dealt(spark):
    """The rows of a large file, one task's to search, are not one task's to read attributes from."""
    files = spark.createDataFrame([("b", "/d/toc.hhc", "<ul>" + "".join(topic(f"n{i}", f"p{i}.htm") for i in range(3000)) + "</ul>")], "book_id string, base string, text string").coalesce(1)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = tree._tag_rows(files).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows) == 4 and sum(r["count"] for r in rows) == 2 + 3000 * 4


def test_blocks_have_the_tags_of_the_text(spark):
    """Texts of brackets, quotes and tags in any order: their blocks join to them, and have the same tags in the same order."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["<", ">", "<ul>", "</ul>", "<ul ", "<object type=", '"', "'", "x", "<b a='>'>", "\n"]) for _ in range(rng.choice([3, 300, 3000]))) for _ in range(60)]
    files = spark.createDataFrame([(f"b{i}", x) for i, x in enumerate(texts)], "book_id string, text string").withColumn("l", F.regexp_extract_all("text", F.lit(tree.BLOCK), 0))
    tags = lambda x: F.regexp_extract_all(x, F.lit(tree.TAG), 0)
    got = files.select(F.array_join("l", "") == F.col("text"), F.flatten(F.transform("l", tags)) == tags("text"), F.size("l")).collect()
    assert all(r[0] and r[1] for r in got) and max(r[2] for r in got) > 4
