"""What is indexed and what is reported of raw pages, against a plain rule."""

from folioworks.operators import extract


def test_good_and_failed(spark):
    raw = [
        ("b", "/1.htm", 1, "<meta charset=gb2312><title>规则</title><body>倒地</body>".encode("gbk"), None),
        ("b", "/2.htm", 2, None, 5),
        ("b", "/3.htm", 3, b"x" * 10, 11),
        ("b", "/4.htm", 4, b"<meta charset=gbk>a\xff b", None),
        ("b", "/5.htm", 5, b"<meta charset='x-nothing'>plain", None),
        ("b", "/6.htm", 6, b"", 0),
        ("b", "/7.htm", 7, "﻿<title></title>é".encode(), None),
        (None, None, None, "<meta charset=shift_jis>ルール".encode("shift_jis"), None),
    ]
    rows = spark.createDataFrame(raw, "book_id string, path string, doc_pos int, content binary, length long").repartition(3)
    pages, failed = extract.checked_pages(rows.withColumn("html", rows["path"]).drop("html"), size=60)
    got = {r.doc_pos: (r.encoding, r.title, r.text) for r in pages.collect()}
    assert got[1] == ("gbk", "规则", "倒地") and got[7][0] == "utf-8" and got[7][1] == "7.htm" and got[None][2] == "ルール"
    assert sorted(got, key=str) == [1, 3, 4, 5, 6, 7, None]
    assert {r.doc_pos: (r.indexed, r.reason) for r in failed.collect()} == {2: (False, "no content"), 4: (True, "replacement characters"), 5: (True, "unknown label")}
    assert {r.doc_pos: r.reason for r in extract.checked_pages(rows, size=8)[1].collect()}[3] == "too long"
    assert extract.checked_pages(rows.filter("false"))[0].count() == 0
