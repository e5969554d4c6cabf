"""Registered queries of whole jobs whose sides all have rows: summaries of books with contents, named files, deletion, a library's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extract, search, tree
from .plans import library
from .registry import BASE36, BODY, COUNT, HASH, ORACLE_SQL, PAGES, QUICK, RAW, SEARCH, TERMS, TEXTS, query
from .sources import books as b

L = F.lit

# --- books of customers, one for each nation ----------------------------------------

CUSTOMER_BOOKS = """docs as (select c_nationkey book_id, '/c/' || c_custkey || case when c_custkey % 11 = 0 then '.png' else '.html' end path, c_custkey doc_pos, case when c_custkey % 7 = 0 then '' else c_name end html from customer
  union all select n_nationkey, '/Welcome.html', 1000000000 + n_nationkey, n_name from nation where n_nationkey % 3 = 1
  union all select n_nationkey, '/index.HTM', 1000000000 + n_nationkey, n_name from nation where n_nationkey % 6 = 1),
content as (select * from docs where regexp_matches(path, '(?i)\\.html?$') and html <> ''),
spine as (select c_nationkey book_id, case when c_nationkey % 4 = 0 then '/none/' else '/C/' end || c_custkey || '.html' as local, 10000000 - c_custkey pos from customer where c_nationkey % 2 = 0 and c_custkey % 3 <> 0),
named as (select c_nationkey book_id, '/C/' || max(c_custkey) || '.html' path from customer where c_nationkey % 5 = 0 group by 1)"""


def _customer_books(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages (some no content pages, some with usual names), contents of every second book (of every fourth they lead nowhere), default pages of every fifth."""
    c, n = b.table(s, d, "customer"), b.table(s, d, "nation")
    k, nation = F.col("c_custkey"), F.col("c_nationkey").alias("book_id")
    docs = c.select(nation, F.concat(L("/c/"), k.cast("string"), F.when(k % 11 == 0, ".png").otherwise(".html")).alias("path"), k.alias("doc_pos"), F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("html"))
    for name, every in (("/Welcome.html", 3), ("/index.HTM", 6)):
        docs = docs.unionByName(n.filter(F.col("n_nationkey") % every == 1).select(F.col("n_nationkey").alias("book_id"), L(name).alias("path"), (1_000_000_000 + F.col("n_nationkey").cast("long")).alias("doc_pos"), F.col("n_name").alias("html")))
    spine = c.filter("c_nationkey % 2 = 0 and c_custkey % 3 <> 0").select(nation, (10_000_000 - k).alias("pos"), F.col("c_name").alias("name"), F.concat(F.when(F.col("c_nationkey") % 4 == 0, "/none/").otherwise("/C/"), k.cast("string"), L(".html")).alias("local"), L(0).alias("depth"))
    named = c.filter("c_nationkey % 5 = 0").groupBy(nation).agg(F.concat(L("x/../C/./"), F.max(k).cast("string"), L(".html")).alias("path"))
    return docs, spine, named


@query(
    f"""with {CUSTOMER_BOOKS}, found as (select n.book_id, n.path, 0 prio, 0 place from named n semi join docs d on d.book_id = n.book_id and lower(d.path) = lower(n.path)
  union all select s.book_id, s.local, 1, s.pos from spine s semi join docs d on d.book_id = s.book_id and lower(d.path) = lower(s.local)
  union all select book_id, path, 1, doc_pos from content where book_id not in (select book_id from spine)
  union all select book_id, path, 2, list_position(['/index.html', '/index.htm', '/default.html', '/default.htm', '/welcome.html', '/welcome.htm'], lower(path)) from docs where lower(path) in ('/index.htm', '/welcome.html')
  union all select book_id, path, 3, doc_pos from content),
landing as (select book_id, path, row_number() over (partition by book_id order by prio, place, path) r from found),
e as (select book_id, count(*) entry_count, count(*) filter (regexp_matches(path, '(?i)\\.html?$') and html <> '') docs, sum(strlen(html))::bigint size from docs group by 1),
l as (select book_id, count(*) spine_length from spine group by 1)
select e.book_id, entry_count, docs, size, landing.path landing, coalesce(spine_length, docs) spine_length from e join landing on landing.book_id = e.book_id and r = 1 left join l on l.book_id = e.book_id"""
)
def summary_with_contents(s, d):
    """Counts, landing page and reading order of books, with and without contents, default pages and usual names."""
    return tree.readable_books(library.book_summary(*_customer_books(s, d)))


@query(
    """with entries as (select c_nationkey book_id, '/t/' || c_custkey || case c_custkey % 3 when 0 then '.HHC' when 1 then '.hhk' else '.html' end path, -c_custkey entry_pos from customer),
named as (select c_nationkey book_id, '/T/' || max(c_custkey) || '.html' path from customer where c_nationkey % 4 <> 3 group by 1),
hit as (select n.book_id, n.path from named n semi join entries e on e.book_id = n.book_id and lower(e.path) = lower(n.path)),
first as (select book_id, min_by(path, entry_pos) path from entries where lower(path) like '%.hhc' group by 1)
select coalesce(hit.book_id, first.book_id) book_id, coalesce(hit.path, first.path) path from first full join hit on hit.book_id = first.book_id"""
)
def named_sitemaps(s, d):
    """The contents file of each book: the one that is named, if the book has it, else its first with the extension."""
    c, k = b.table(s, d, "customer"), F.col("c_custkey")
    book = F.col("c_nationkey").alias("book_id")
    entries = c.select(book, F.concat(L("/t/"), k.cast("string"), F.when(k % 3 == 0, ".HHC").when(k % 3 == 1, ".hhk").otherwise(".html")).alias("path"), (-k).alias("entry_pos"))
    named = c.filter("c_nationkey % 4 <> 3").groupBy(book).agg(F.concat(L("T//"), F.max(k).cast("string"), L(".html")).alias("path"))
    return tree.choose_sitemap(entries, named, ".hhc")


# --- books of documents -------------------------------------------------------------

GONE = "gone as (select source from documents group by source having count(*) % 2 = 1 or regexp_extract(source, '(\\d+)', 1)::bigint < 4)"


@query(
    f"""with {GONE}, d as (select * from documents where source not in (select source from gone))
select 'books' kind, source book_id, source item from d group by source union all select 'files', source, lang from d group by source, lang
union all select 'pages', source, '/' || lang || '/' || doc_id || '.html' from d union all select 'terms', source, lang || ' ' || doc_id from d"""
)
def delete_whole_books(s, d):
    """Books, their files, pages and terms after some books are deleted: every row that stays."""
    shelf, pages = b.shelf(s, d), b.text_pages(s, d)
    docs = b.table(s, d, "documents").withColumnRenamed("source", "book_id")
    files = docs.select("book_id", F.col("lang").alias("name")).distinct()
    label = F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("label")
    terms = extract.term_records(docs.select("book_id", label, F.concat(L("/"), F.col("doc_id").cast("string")).alias("path"), L("").alias("anchor"), L("document").alias("source")))
    left = b.delete_books(shelf, files, pages, terms, shelf.filter("page_count % 2 = 1 or added_at < 4000").select("id"))
    rows = [x.select(L(kind).alias("kind"), F.col(book).alias("book_id"), F.col(item).alias("item")) for x, kind, book, item in zip(left, ("books", "files", "pages", "terms"), ("id", "book_id", "book_id", "book_id"), ("id", "name", "path", "label"), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(
    f"""with {TEXTS}, w as (select *, string_split(lower(text), 'tion') w from texts where contains(lower(text), 'tion')),
p as (select *, list_transform(range(least(6, len(w) - 1)), lambda i: (list_sum(list_transform(w[1 : i + 1], lambda x: length(x))) + 4 * i)::bigint) p from w)
select book_id, path, len(p) shown, md5(list_reduce(list_transform(p, lambda x: regexp_replace(substr(text, greatest(x - 55, 0) + 1, x + 119 - greatest(x - 55, 0)), '^\\s+|\\s+$', '', 'g')), lambda a, c: a || '|' || c)) snippets_md5 from p"""
)
def library_snippets(s, d):
    """The texts of all snippets that a library search shows, for every page with a hit."""
    pages = b.text_pages(s, d).filter(F.lower("text").contains("tion"))
    found = pages.select("book_id", "path", search.snippets_library("text", "tion", 6).alias("m"))
    return found.select("book_id", "path", F.size("m").cast("long").alias("shown"), F.md5(F.array_join(F.transform("m", lambda x: x["snippet"]), "|")).alias("snippets_md5"))


# --- a library of parts -------------------------------------------------------------


@query(
    f"""with {TERMS}, n as (select book_id, regexp_extract(book_id, '(\\d+)', 1)::bigint n from terms group by 1),
placed as (select book_id, n, row_number() over (order by coalesce(nullif(case when n % 3 = 0 then n * 5000 else 0 end, 0), n * 1000) desc, book_id) shelf_pos from n),
h as (select *, {HASH.format("path || '||part|' || label")} h, {QUICK.format("ring")} score from terms), i as (select *, {BASE36} term_id from h where score > 0),
q as (select * from i order by score desc, label, book_id, term_id limit 160),
qn as (select shelf_pos, row_number() over (partition by book_id order by score desc, label, term_id) n, book_id, path, label title from q join placed using (book_id)),
low as (select book_id, path, label title, lower(label || ' ' || kind || ' Ring ' || label) low from terms),
f as (select shelf_pos, book_id, path, title, {COUNT.format("low", "'ring'")} hits from low join placed using (book_id) where contains(low, 'ring') and (n % 5 <> 4) order by shelf_pos, path limit 150),
m as (select *, unnest(range(least(6, hits))) o from f), fn as (select shelf_pos, row_number() over (partition by book_id order by path, o) n, book_id, path, title from m)
select 'quick' kind, * from qn where n <= 45 union all select 'full', * from fn where n <= 45"""
)
def search_library_parts(s, d):
    """A whole library search, both sides: the best terms of all books, texts of indexed ones, by book in shelf order."""
    p = b.part_terms(s, d)
    terms = extract.term_records(p.select("book_id", "label", "path", L("").alias("anchor"), L("part").alias("source")))
    pages = p.select("book_id", "path", F.col("label").alias("title"), F.concat_ws(" ", "label", "kind", L("Ring"), "label").alias("text"))
    n = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    state = F.when(n % 5 == 4, "error").when(n % 5 == 3, "building").otherwise("ready")
    shelf = p.select(F.col("book_id").alias("id")).distinct().select("id", (n * 1000).alias("added_at"), F.when(n % 3 == 0, n * 5000).otherwise(0).alias("last_opened"), state.alias("index_state"), F.when(n % 5 == 3, 3).otherwise(0).alias("index_done"))
    return library.search_library(pages, terms, shelf, "ring").select("kind", "shelf_pos", "n", "book_id", "path", "title")


#: What each page gives to the index: its text, and the terms that no earlier page of the book has.
ORACLE_SQL["build_index"] = f"""with {PAGES}, t as ({ORACLE_SQL["extract_terms"]}), n as (select book_id, path, count(*) terms from t group by 1, 2), c as (select book_id, path, count(*) pages, sum(length(text))::bigint n_chars from pg group by 1, 2)
select book_id, path, pages, n_chars, coalesce(terms, 0) terms from c left join n using (book_id, path)"""

#: Hits of a book: index names and terms (no contents name of the tables has the word), the best of each page, then the texts' matches.
ORACLE_SQL["search_book_all"] = f"""with {RAW}, {TERMS}, x as (select book_id, path, doc_pos, lower({SEARCH.format(BODY.format("html"))}) low from raw where strlen(html) <= 16777216),
h as (select doc_pos, book_id, path, least(60, {COUNT.format("low", "'an'")}) n from x where contains(low, 'an') order by doc_pos, book_id, path limit 100),
m as (select doc_pos, path, unnest(range(n)) o from h), k as (select *, row_number() over (partition by lower(path), o order by doc_pos, path) r from m), f as (select path, o from k where r = 1 order by doc_pos, path, o limit 180),
s as (select path, label title, {QUICK.format("an")} + 8 score, 2 source_no, doc_pos from terms where {QUICK.format("an")} > 0
  union all select path, kind, case when lower(kind) = 'an' then 110 when starts_with(lower(kind), 'an') then 90 else 68 end, 1, doc_pos from terms where contains(lower(kind), 'an')),
b as (select *, row_number() over (partition by lower(path) order by score desc, source_no, doc_pos) r from s),
q as (select * from b where r = 1 order by score desc, title, source_no, doc_pos limit 80),
i as (select path from q where lower(path) not in (select lower(path) from h) order by score desc, title, path limit 60)
select 'instant' as section, path, null::int as occurrence_index from i union all select 'full', path, o::int from f"""
