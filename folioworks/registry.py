"""The registered queries over the driver's tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as t
from .operators import activity, extract, search, tree
from .plans import library
from .sources import books as b
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- views in SQL -------------------------------------------------------------------

RAW = r"""raw as (select regexp_extract(url, '^[a-z]+://([^/]*)', 1) book_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '/$', ''), '\.html$', ''), '$', '.html') path, page_id doc_pos, html from pages)"""
STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/dt|/dd)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))".replace('\\"', '"')
BODY = r"coalesce(nullif(regexp_extract({0}, '(?is)<body\b[^>]*>(.*?)</body>', 1), ''), regexp_replace({0}, '(?is)<head\b[^>]*>.*?</head>', ' ', 'g'))"
TITLE = r"regexp_extract({0}, '(?is)<title\b[^>]*>(.*?)</title>', 1)"
SEARCH = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&(?:amp|lt|gt|quot);', ' ', 'g'), '\s+', ' ', 'g')"
PAGES = f"{RAW}, pg as (select book_id, path, doc_pos, html, {STRIP.format(TITLE.format('html'))} title, {STRIP.format(BODY.format('html'))} text from raw)"
TEXTS = "texts as (select source book_id, '/' || lang || '/' || doc_id || '.html' path, split_part(text, chr(10), 1) title, text, doc_id doc_pos from documents)"
TERMS = "terms as (select p_brand book_id, p_name label, '/part/' || p_partkey || '.html' path, p_partkey doc_pos, p_type kind from part)"
SHELF = "shelf as (select source id, 'Book ' || source title, sum(n_chars) size, count(*) page_count, case cast(regexp_extract(source, '(\\d+)', 1) as bigint) % 5 when 4 then 'error' when 3 then 'building' else 'ready' end index_state, case when cast(regexp_extract(source, '(\\d+)', 1) as bigint) % 5 = 3 then 3 else 0 end index_done, cast(regexp_extract(source, '(\\d+)', 1) as bigint) * 1000 added_at, case when cast(regexp_extract(source, '(\\d+)', 1) as bigint) % 3 = 0 then cast(regexp_extract(source, '(\\d+)', 1) as bigint) * 5000 else 0 end last_opened from documents group by source), placed as (select *, row_number() over (order by coalesce(nullif(last_opened, 0), nullif(added_at, 0), 0) desc, id) shelf_pos from shelf)"
ACTS = "acts as (select user_id reader_id, event_id seq, epoch_us(ts) // 1000 ts, case event_type when 'view' then 'visit' when 'click' then 'toggle' when 'purchase' then 'back' when 'signup' then 'forward' end kind, '/k/' || json_extract_string(props, '$.k') || '.html' path from events)"
STATUS = "status as (select user_id book_id, event_id seq, case event_type when 'error' then 'error' when 'purchase' then 'done' else 'progress' end type, cast(floor(abs(value)) as bigint) done, 500 total from events)"
TOC = "toc as (select r_regionkey * 10000000000 node_id, null::bigint parent_id, 0 depth, r_name name, null local, []::bigint[] ancestors from region union all select n_regionkey * 10000000000 + (n_nationkey::bigint + 1) * 100000000, n_regionkey * 10000000000, 1, n_name, null, [n_regionkey * 10000000000] from nation union all select n_regionkey * 10000000000 + (n_nationkey::bigint + 1) * 100000000 + c_custkey + 1, n_regionkey * 10000000000 + (n_nationkey::bigint + 1) * 100000000, 2, c_name, '/customer/' || c_custkey || '.html', [n_regionkey * 10000000000, n_regionkey * 10000000000 + (n_nationkey::bigint + 1) * 100000000] from customer join nation on c_nationkey = n_nationkey)"
COUNT = "cast((length({0}) - length(replace({0}, {1}, ''))) / length({1}) as integer)"


# --- pages --------------------------------------------------------------------------


def _pages(s: SparkSession, d: str) -> DataFrame:
    return extract.extract_pages(b.raw_pages(s, d))


@query(f"with {RAW}, x as (select book_id, path, doc_pos, coalesce(nullif({TITLE.format('html')}, ''), path) title0, {SEARCH.format(BODY.format('html'))} text, html from raw), y as (select *, lower(text) low, trim(regexp_replace(replace(replace(replace(replace(regexp_replace({TITLE.format('html')}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '\\s+', ' ', 'g')) title from x) select book_id, path, doc_pos, title, {COUNT.format('low', chr(39) + 'an' + chr(39))} occurrence_total, least(60, {COUNT.format('low', chr(39) + 'an' + chr(39))}) shown, substr(text, greatest(strpos(low, 'an') - 1 - 60, 0) + 1, strpos(low, 'an') - 1 + 2 + 120 - greatest(strpos(low, 'an') - 1 - 60, 0)) first_snippet from y where contains(low, 'an') order by doc_pos limit 80")
def full_text_search(s, d):
    hits = search.full_text_search(b.raw_pages(s, d), "an", 80)
    return hits.select("book_id", "path", "doc_pos", "title", "occurrence_total", F.size("matches").alias("shown"), F.col("matches")[0]["snippet"].alias("first_snippet"))


@query(f"with {PAGES} select book_id, path, doc_pos, coalesce(nullif(title, ''), path) title, length(text) n_chars, md5(text) text_md5 from pg")
def extract_pages(s, d):
    return _pages(s, d).select("book_id", "path", "doc_pos", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(f"with {PAGES}, c as (select book_id, path, doc_pos, 0 pattern_no, trim(regexp_replace(title, '\\s+', ' ', 'g')) label, '页面标题' source from pg union all select book_id, path, doc_pos, 1, trim(regexp_replace({STRIP.format('h')}, '\\s+', ' ', 'g')), '正文术语' from (select book_id, path, doc_pos, unnest(regexp_extract_all({BODY.format('html')}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)) h from raw)), k as (select *, row_number() over (partition by book_id, lower(label) order by doc_pos, pattern_no, path) n from c where length(label) between 2 and 70 and len(regexp_extract_all(label, '[。！？!?；;]')) <= 1) select book_id, path, label, source from k where n = 1")
def extract_terms(s, d):
    return extract.extract_terms(_pages(s, d), exact=True).select("book_id", "path", "label", "source")


@query(f"with {PAGES}, c as (select book_id, path, doc_pos, 0 pattern_no, trim(regexp_replace(title, '\\s+', ' ', 'g')) label from pg union all select book_id, path, doc_pos, 1, trim(regexp_replace({STRIP.format('h')}, '\\s+', ' ', 'g')) from (select book_id, path, doc_pos, unnest(regexp_extract_all({BODY.format('html')}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)) h from raw)) select book_id, count(distinct lower(label)) terms from c where length(label) between 2 and 70 and len(regexp_extract_all(label, '[。！？!?；;]')) <= 1 group by book_id")
def terms_per_book_exact(s, d):
    return extract.extract_terms(_pages(s, d), exact=True).groupBy("book_id").agg(F.count("*").alias("terms"))


LINKS = f"{RAW}, l as (select book_id, path, doc_pos, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*\"([^\"]*)\"', 1)) href from raw), links as (select book_id, path, doc_pos, rtrim(href, '/') target_path from l)"


@query(f"with {LINKS} select book_id, path, doc_pos, target_path, count(*) n from links group by all")
def extract_links(s, d):
    return extract.extract_links(b.raw_pages(s, d)).filter("kind = 'internal'").groupBy("book_id", "path", "doc_pos", "target_path").agg(F.count("*").alias("n"))


@query(f"with {LINKS} select book_id, count(*) broken, count(distinct target_path) targets from links l where not exists (select 1 from raw r where r.book_id = l.book_id and lower(r.path) = lower(l.target_path)) group by book_id")
def broken_refs(s, d):
    raw = b.raw_pages(s, d)
    return search.broken_refs(extract.extract_links(raw), raw).groupBy("book_id").agg(F.count("*").alias("broken"), F.countDistinct("target_path").alias("targets"))


@query(f"with {LINKS} select r.book_id, r.path, count(*) asked, count(e.path) found from links r left join (select distinct book_id, path, lower(path) k from raw) e on e.book_id = r.book_id and e.k = lower(r.target_path || '.html') group by 1, 2")
def resolve_entries(s, d):
    raw = b.raw_pages(s, d)
    refs = extract.extract_links(raw).filter("kind = 'internal'").select("book_id", "path", F.concat("target_path", F.lit(".html")).alias("raw"))
    found = search.resolve_entries(refs, raw.select("book_id", "path", F.col("doc_pos").alias("entry_pos")))
    return found.groupBy("book_id", "path").agg(F.count("*").alias("asked"), F.count("entry").alias("found"))


@query(f"with {RAW} select book_id, path, doc_pos, 0 resources, 0 css_urls, length(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<meta http-equiv[^>]*>', '', 'g')) > 0 has_text from raw")
def page_resources(s, d):
    raw = b.raw_pages(s, d)
    keys = ["book_id", "path", "doc_pos"]
    r = extract.extract_resources(raw).groupBy(*keys).agg(F.count("*").alias("r"))
    c = extract.extract_css_urls(raw).groupBy(*keys).agg(F.count("*").alias("c"))
    out = raw.select(*keys, (F.length(extract.sanitize_html("html")) > 0).alias("has_text")).join(r, keys, "left").join(c, keys, "left")
    return out.select(*keys, F.coalesce("r", F.lit(0)).cast("int").alias("resources"), F.coalesce("c", F.lit(0)).cast("int").alias("css_urls"), "has_text")


@query(f"with {RAW} select book_id, path, doc_pos, 'utf-8' encoding, md5(html) html_md5 from raw")
def decode_pages(s, d):
    raw = b.raw_pages(s, d).withColumn("content", F.encode("html", "UTF-8"))
    return extract.decoded(raw.drop("html")).select("book_id", "path", "doc_pos", "encoding", F.md5("html").alias("html_md5"))


@query(f"with {RAW} select book_id, path, doc_pos, regexp_matches(path, '^/[^#$:]') and regexp_matches(path, '(?i)\\.(x?html?|xht)$') and strlen(html) > 0 content_page, 'text/html' mime, split_part(path, '/', -1) file_name from raw")
def content_pages(s, d):
    return b.raw_pages(s, d).select("book_id", "path", "doc_pos", t.is_content_page("path", F.octet_length("html")).alias("content_page"), t.mime_for("path").alias("mime"), t.last_segment("path").alias("file_name"))


@query(f"with {RAW}, e as (select book_id, count(*) entry_count, sum(strlen(html))::bigint size, count(*) spine_length, coalesce(min_by(path, (list_position(['/index.html', '/index.htm', '/default.html', '/default.htm', '/welcome.html', '/welcome.htm'], lower(path)), doc_pos)) filter (lower(path) in ('/index.html', '/index.htm', '/default.html', '/default.htm', '/welcome.html', '/welcome.htm')), min_by(path, doc_pos)) l, min_by(path, doc_pos) first from raw group by book_id) select book_id, entry_count, entry_count docs, size, spine_length, first landing from e")
def book_summary(s, d):
    raw = b.raw_pages(s, d)
    none = tree.flatten_toc(b.toc_nodes(s, d)).filter("false")
    return tree.readable_books(library.book_summary(raw, none))


@query(f"with {RAW}, n as (select *, row_number() over (partition by book_id order by doc_pos) - 1 node_id from raw) select book_id, cast(node_id as integer) node_id, regexp_replace(split_part(path, '/', -1), '(?i)\\.(x?html?|xht)$', '') name, path as \"local\", lag(path) over (partition by book_id order by node_id) prev_local from n")
def fallback_toc(s, d):
    w = Window.partitionBy("book_id").orderBy("node_id")
    return tree.fallback_toc(b.raw_pages(s, d)).select("book_id", "node_id", "name", "local", F.lag("local").over(w).alias("prev_local"))


@query(f"with {RAW}, i as (select *, row_number() over (partition by book_id order by doc_pos) n from raw where regexp_matches(path, '(?i)\\.(x?html?|xht)$') and strlen(html) > 0) select book_id, path, doc_pos from i where n <= 10")
def indexable(s, d):
    raw = b.raw_pages(s, d).withColumn("length", F.octet_length("html").cast("long"))
    return extract.indexable(raw, 10).select("book_id", "path", "doc_pos")


@query(ORACLE_SQL["indexable"].replace("n <= 10", "n <= 20000"))
def indexable_all(s, d):
    """With the reference's limit."""
    raw = b.raw_pages(s, d).withColumn("length", F.octet_length("html").cast("long"))
    return extract.indexable(raw).select("book_id", "path", "doc_pos")


@query()
def build_index(s, d):
    """The whole job: what each page gives to the index."""
    pages, terms = library.build_index(b.raw_pages(s, d), exact=True)
    n = terms.groupBy("book_id", "path").agg(F.count("*").alias("terms"))
    chars = pages.groupBy("book_id", "path").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("n_chars"))
    return chars.join(n, ["book_id", "path"], "left").select("book_id", "path", "pages", "n_chars", F.coalesce("terms", F.lit(0)).alias("terms"))


@query(f"with {PAGES} select book_id, path, coalesce(nullif(title, ''), path) title, coalesce(nullif(trim(substr(regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), 1, 1600), ''), ''), '-') preview from pg")
def page_preview(s, d):
    return extract.page_preview(_pages(s, d))


# --- search -------------------------------------------------------------------------

QUICK = "case when replace(lower(label), ' ', '') = '{0}' then 140 when starts_with(replace(lower(label), ' ', ''), '{0}') then 112 when contains(replace(lower(label), ' ', ''), '{0}') then 86 else 0 end"


def _terms(s: SparkSession, d: str) -> DataFrame:
    rows = b.part_terms(s, d).select("book_id", "label", "path", "doc_pos", F.lit("").alias("anchor"), F.lit("术语").alias("source"))
    pos = rows.select("path", F.col("doc_pos").alias("pos"))
    terms = extract.term_records(rows).join(pos, "path")
    path = f"{jobs.work_folder(s)}/terms"  # searches read a stored index, as a library does
    terms.write.parquet(path)
    return s.read.schema(terms.schema).parquet(path)


@query(f"with {TERMS}, s as (select *, {QUICK.format('green')} score from terms), k as (select score, label, count(*) n from s where score > 0 group by all) select * from k")
def score_terms(s, d):
    rows = _terms(s, d).withColumn("score", search.score_quick("keys", "label", "green"))
    return rows.filter("score > 0").groupBy("score", "label").agg(F.count("*").alias("n"))


@query(f"with {TERMS}, s as (select *, {QUICK.format('e')} score from terms) select score from s where score > 0 order by score desc limit 160")
def quick_search_library(s, d):
    return search.quick_search_library(_terms(s, d), "e").select("score")


BASE36 = "ltrim(list_reduce(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', cast((h // cast(pow(36, i) as hugeint)) % 36 as integer) + 1, 1)), lambda a, c: a || c), '0')"
HASH = "list_reduce(list_prepend(2166136261::hugeint, list_transform(regexp_extract_all({0}, '.'), lambda c: ascii(c)::hugeint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295::hugeint)"


@query(f"with {TERMS}, x as (select book_id, label, path, {HASH.format(chr(39) + chr(39) + ' || path || ' + chr(39) + '||part|' + chr(39) + ' || label')} h from terms) select book_id, label, path, {BASE36} term_id from x")
def term_ids(s, d):
    rows = b.part_terms(s, d).select("book_id", "label", "path", F.lit("").alias("anchor"), F.lit("part").alias("source"))
    return extract.term_records(rows).select("book_id", "label", "path", "term_id")


INDEX = "entries as (select book_id, kind as name, path, doc_pos from terms)"


@query(f"with {TOC}, {TERMS}, hits as (select \"local\" path, name title, case when lower(name) = 'c' then 120 when starts_with(lower(name), 'c') then 95 else 70 end score, 0 s, node_id p from toc where \"local\" is not null and contains(lower(name), 'c') union all select path, kind, case when lower(kind) = 'c' then 110 when starts_with(lower(kind), 'c') then 90 else 68 end, 1, doc_pos from terms where contains(lower(kind), 'c') union all select path, label, 8 + {QUICK.format('c')}, 2, doc_pos from terms where {QUICK.format('c')} > 0), best as (select *, row_number() over (partition by lower(path) order by score desc, s, p) n from hits) select score, count(*) hits from (select score from best where n = 1 order by score desc limit 80) group by score")
def quick_search_book(s, d):
    spine = b.toc_nodes(s, d).filter("local is not null")
    index = b.part_terms(s, d).select("book_id", F.col("kind").alias("name"), F.array("path").alias("targets"), F.col("doc_pos").alias("pos"))
    return search.quick_search_book(spine, index, _terms(s, d), "c").groupBy("score").agg(F.count("*").alias("hits"))


@query(f"with {TERMS}, hits as (select path, label title, 8 + {QUICK.format('a')} score from terms where {QUICK.format('a')} > 0 and doc_pos <= 50) select path, title, score from hits")
def quick_search_in_scope(s, d):
    scope = b.part_terms(s, d).filter("doc_pos <= 50").select("path")
    none = b.toc_nodes(s, d).filter("false")
    index = b.part_terms(s, d).filter("false").select("book_id", F.col("kind").alias("name"), F.array("path").alias("targets"), F.col("doc_pos").alias("pos"))
    return search.quick_search_book(none, index, _terms(s, d), "a", scope, 1000).select("path", "title", "score")


@query(f"with {TOC}, own as (select lower(name) k from toc where \"local\" is not null and list_contains(ancestors, 0) and contains(lower(name), 'e')) select case when k = 'e' then 120 when starts_with(k, 'e') then 95 else 70 end score, '目录' source, count(*) hits from own group by all")
def quick_search_in_node(s, d):
    """All hits of contents, index and terms on the pages of one node of the contents."""
    nodes = b.toc_nodes(s, d)
    spine = nodes.filter("local is not null")
    scope = tree.scope_paths(nodes, spine.select("book_id", F.col("local").alias("path"))).filter("node_id = 0").select("path")
    index = b.part_terms(s, d).select("book_id", F.col("kind").alias("name"), F.array("path").alias("targets"), F.col("doc_pos").alias("pos"))
    return search.best_per_key(search.in_scope(search.union_sources(spine, index, _terms(s, d), "e"), scope)).groupBy("score", "source").agg(F.count("*").alias("hits"))


@query(f"with {TEXTS}, {SHELF}, h as (select book_id, path, shelf_pos, texts.title, {COUNT.format('lower(text)', chr(39) + 'tion' + chr(39))} n from texts join placed on id = book_id where (index_state = 'ready' or index_done > 0) and contains(lower(text), 'tion') order by shelf_pos, path limit 150) select book_id, path, shelf_pos, title, least(n, 6) occurrence_total from h")
def search_library(s, d):
    order = library.shelf_order(b.shelf(s, d))
    return search.search_library(b.text_pages(s, d), search.indexed_books(order), "tion", 150).select("book_id", "path", "shelf_pos", "title", "occurrence_total")


@query(f"with {TEXTS}, {SHELF}, h as (select book_id, path, shelf_pos, texts.title, least(6, {COUNT.format('lower(text)', chr(39) + 'tion' + chr(39))}) n from texts join placed on id = book_id where (index_state = 'ready' or index_done > 0) and contains(lower(text), 'tion') order by shelf_pos, path limit 150), m as (select *, unnest(range(n)) o from h), k as (select *, row_number() over (partition by book_id order by path, o) r from m) select shelf_pos, book_id, path, r n from k where r <= 45")
def library_grouped_results(s, d):
    order = library.shelf_order(b.shelf(s, d))
    full = search.search_library(b.text_pages(s, d), search.indexed_books(order), "tion", 150)
    quick = b.part_terms(s, d).filter("false").select("book_id", "path", F.col("label").alias("title"), F.lit(0).alias("score"), F.lit("").alias("term_id"))
    return search.library_grouped_results(quick, full, order).select("shelf_pos", "book_id", "path", "n")


@query(f"with {TEXTS} select count(*) pages, sum({COUNT.format('lower(text)', chr(39) + 'the' + chr(39))})::bigint occurrences from texts where contains(lower(text), 'the')")
def hit_summary(s, d):
    hits = b.text_pages(s, d).filter(F.lower("text").contains("the")).select(search.occurrence_count("text", "the").alias("occurrence_total"), F.array().cast("array<string>").alias("matches"))
    return search.hit_summary(hits)


@query(f"with {TEXTS}, h as (select doc_pos, path, title, least(60, {COUNT.format('lower(text)', chr(39) + 'ing' + chr(39))}) n from texts where contains(lower(text), 'ing') order by doc_pos limit 40), m as (select doc_pos, path, unnest(range(n)) occurrence_index from h) select path, cast(occurrence_index as integer) occurrence_index from m order by doc_pos, path, occurrence_index limit 180")
def running_cap(s, d):
    low = b.text_pages(s, d).filter(F.lower("text").contains("ing")).withColumn("found", search.match_positions(F.lower("text"), "ing"))
    hits = low.select("doc_pos", "path", "title", search.snippets_live("text", "found", "ing").alias("matches")).orderBy("doc_pos").limit(40)
    return search.running_cap(hits, ["doc_pos", "path"]).select("path", "occurrence_index")


@query(f"with {TEXTS} select path, {COUNT.format('lower(text)', chr(39) + 'er' + chr(39))} n, strpos(lower(text), 'er') - 1 first_start, md5(case when contains(lower(text), 'er') then substr(text, 1, strpos(lower(text), 'er') - 1) || '<mark>' || substr(text, strpos(lower(text), 'er'), 2) || '</mark>' || substr(text, strpos(lower(text), 'er') + 2) else text end) marked from texts")
def highlight(s, d):
    rows = b.text_pages(s, d)
    return rows.select("path", search.occurrence_count("text", "er").alias("n"), F.coalesce(search.nth_occurrence_span("text", "er", 0)["start"], F.lit(-1)).alias("first_start"), F.md5(search.highlight("text", "er")).alias("marked"))


@query(f"with {TEXTS} select cast(item_id as varchar) query_id, book_id, path, {COUNT.format('lower(t.text)', 'lower(trim(b.text))')} occurrence_total from texts t join benchmark b on contains(lower(t.text), lower(trim(b.text)))")
def batch_search(s, d):
    queries = b.table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("q"))
    return search.batch_search(b.text_pages(s, d), queries)


@query(f"with {TEXTS} select cast(item_id as varchar) query_id, book_id, path, {COUNT.format('lower(t.text)', 'lower(trim(b.text))')} occurrence_total from texts t join benchmark b on contains(lower(t.text), lower(trim(b.text)))")
def batch_search_by_grams(s, d):
    queries = b.table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("q"))
    return search.batch_search(b.text_pages(s, d), queries, few=8)


@query(f"with {TEXTS}, {TERMS}, full_ as (select path, title, doc_pos from texts where contains(lower(text), 'tion') order by doc_pos limit 30) select 'full' section, count(*) n from full_ where path is not null union all select 'instant', 60 from (select 1) where (select count(*) from terms where {QUICK.format('e')} > 0) >= 60")
def merged_results(s, d):
    full = b.text_pages(s, d).filter(F.lower("text").contains("tion")).orderBy("doc_pos").limit(30).select("doc_pos", "path", "title", F.array(F.struct(F.lit(0).alias("occurrence_index"), F.lit("").alias("snippet"))).alias("matches"))
    quick = search.quick_search_library(_terms(s, d), "e")
    return search.merged_results(quick, full).groupBy("section").agg(F.count("*").alias("n"))


@query(ORACLE_SQL["running_cap"].replace("limit 40)", "limit 100)"))
def running_cap_all(s, d):
    """Over as many hits as callers give."""
    low = b.text_pages(s, d).filter(F.lower("text").contains("ing")).withColumn("found", search.match_positions(F.lower("text"), "ing"))
    hits = low.select("doc_pos", "path", "title", search.snippets_live("text", "found", "ing").alias("matches")).orderBy("doc_pos").limit(100)
    return search.running_cap(hits, ["doc_pos", "path"]).select("path", "occurrence_index")


@query()
def search_library_all(s, d):
    """The whole job: quick hits on the first lines of texts and text hits, grouped by book."""
    pages = b.text_pages(s, d)
    terms = extract.term_records(pages.select("book_id", F.col("title").alias("label"), "path", F.lit("").alias("anchor"), F.lit("页面标题").alias("source")))
    return library.search_library(pages, terms, b.shelf(s, d), "tion").select("kind", "shelf_pos", "book_id", "path", "n")


@query()
def search_book_all(s, d):
    """The whole job: hits of contents, index, terms and texts, merged."""
    raw = b.raw_pages(s, d)
    spine = tree.flatten_toc(b.toc_nodes(s, d))
    index = b.part_terms(s, d).select("book_id", F.col("kind").alias("name"), F.array("path").alias("targets"), F.col("doc_pos").alias("pos"))
    return library.search_book(raw, spine, index, _terms(s, d), "an").select("section", "path", "occurrence_index")


# --- contents -----------------------------------------------------------------------


@query(f"with {TOC} select node_id, depth, name, depth < 2 is_group, row_number() over (order by node_id) n from toc order by node_id limit 20000")
def toc_rows(s, d):
    return tree.toc_rows(b.toc_nodes(s, d)).select("node_id", "depth", "name", "is_group", "n")


@query(f"with {TOC}, s as (select row_number() over (order by node_id) - 1 pos, \"local\" l, node_id from toc where \"local\" is not null) select l as \"local\", lag(l) over (order by pos) prev_local, lead(l) over (order by pos) next_local from s")
def spine_prev_next(s, d):
    return tree.spine_prev_next(tree.flatten_toc(b.toc_nodes(s, d))).select("local", "prev_local", "next_local")


@query(f"with {TOC}, own as (select * from toc where contains(lower(name), '7')), keep as (select node_id from own union select unnest(ancestors) from own where depth = 2) select node_id, name from toc where node_id in (select node_id from keep)")
def filter_toc(s, d):
    return tree.filter_toc(b.toc_nodes(s, d), "7").select("node_id", "name")


@query(f"with {TOC}, c as (select node_id own, \"local\" path, unnest(list_append(ancestors, node_id)) node_id from toc where \"local\" is not null) select node_id, count(*) n_paths, min(own) first_pos from c group by node_id")
def scope_paths(s, d):
    nodes = b.toc_nodes(s, d)
    docs = nodes.filter("local is not null").select("book_id", F.col("local").alias("path"))
    return tree.scope_paths(nodes, docs).groupBy("node_id").agg(F.count("*").alias("n_paths"), F.min("pos").alias("first_pos"))


@query(f"with {TOC}, leaf as (select node_id, \"local\" path, ancestors from toc where \"local\" is not null and node_id % 10 = 0), chain as (select path, unnest(list_append(ancestors, node_id)) node_id from leaf), sizes as (select node_id, count(*) n from (select unnest(list_append(ancestors, node_id)) node_id from toc where \"local\" is not null) group by 1), ranked as (select path, t.node_id, t.depth, row_number() over (partition by path, n order by t.depth desc) r from chain c join toc t on t.node_id = c.node_id join sizes z on z.node_id = c.node_id) select path, depth, 'toc' kind from ranked where r = 1 union all select path, -1, 'book' from leaf union all select path, -2, 'library' from leaf")
def search_scopes(s, d):
    nodes = b.toc_nodes(s, d)
    docs = nodes.filter("local is not null").select("book_id", F.col("local").alias("path"), "node_id")
    return tree.search_scopes(nodes, docs, docs.filter("node_id % 10 = 0").select("book_id", "path")).select("path", "depth", "kind")


@query(ORACLE_SQL["search_scopes"].replace(" and node_id % 10 = 0", ""))
def search_scopes_all(s, d):
    """The scopes of every page."""
    nodes = b.toc_nodes(s, d)
    docs = nodes.filter("local is not null").select("book_id", F.col("local").alias("path"))
    return tree.search_scopes(nodes, docs, docs).select("path", "depth", "kind")


@query(f"with {TOC}, x as (select t.name, t.\"local\" target, a.name n1, b.name n2 from toc t join toc a on a.node_id = t.ancestors[1] join toc b on b.node_id = t.ancestors[2] where t.\"local\" is not null) select n1 || ', ' || n2 || ', ' || name as name, target from x")
def flatten_index(s, d):
    return tree.flatten_index(b.toc_nodes(s, d)).select("name", F.col("targets")[0].alias("target"))


@query(f"with {TERMS}, {INDEX}, k as (select book_id, name, row_number() over (partition by book_id order by lower(name), name, doc_pos) n from entries) select book_id, n, name from k where n <= 50")
def keyword_listing(s, d):
    entries = b.part_terms(s, d).select("book_id", F.col("kind").alias("name"), F.array("path").alias("targets"), F.col("doc_pos").alias("pos"))
    return tree.keyword_listing(entries, 50).select("book_id", "n", "name")


@query(ORACLE_SQL["keyword_listing"].replace("n <= 50", "n <= 20000"))
def keyword_listing_all(s, d):
    """With the reference's limit."""
    entries = b.part_terms(s, d).select("book_id", F.col("kind").alias("name"), F.array("path").alias("targets"), F.col("doc_pos").alias("pos"))
    return tree.keyword_listing(entries).select("book_id", "n", "name")


@query(f"with {TERMS}, k as (select *, row_number() over (partition by book_id, lower(path), lower(label) order by doc_pos) n from terms) select book_id, label, path from k where n = 1")
def seed_terms(s, d):
    spine = b.part_terms(s, d).select("book_id", F.col("doc_pos").alias("pos"), F.col("label").alias("name"), F.col("path").alias("local"))
    index = spine.select("book_id", "name", F.array("local").alias("targets"), "pos")
    return extract.seed_terms(spine, index).select("book_id", "label", "path")


# --- books --------------------------------------------------------------------------


@query(f"with {SHELF} select id, shelf_pos, title, case index_state when 'ready' then '索引已就绪' when 'error' then '索引构建失败' else '正在构建索引 ' || cast(floor(index_done * 100.0 / page_count + 0.5) as integer) || '%' end label, index_state <> 'ready' needs_index from placed")
def list_books(s, d):
    rows = library.shelf_order(b.shelf(s, d))
    return rows.select("id", "shelf_pos", "title", t.index_label("index_state", "index_done", "page_count").alias("label"), (~F.col("index_state").eqNullSafe("ready")).alias("needs_index"))


@query("with o as (select o_custkey id, max(o_orderdate) last_opened, count(*) n, max_by(o_orderstatus, (o_orderdate, o_orderkey)) index_state from orders group by 1) select c_custkey id, c_name title, coalesce(o.index_state, 'queued') index_state from customer left join o on o.id = c_custkey")
def patch_books(s, d):
    c, o = b.table(s, d, "customer"), b.table(s, d, "orders")
    books = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("queued").alias("index_state"))
    patches = o.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("index_state"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return b.patch_books(books, patches)


@query("with n as (select distinct l_orderkey book_id, cast(l_linenumber as varchar) path, 'new' text from lineitem where l_orderkey % 3 = 0 and l_linenumber <= 2), e as (select l_orderkey book_id, cast(l_linenumber as varchar) path, 'old' text from lineitem where l_orderkey % 2 = 0) select text, count(*) n, count(distinct book_id) books from (select book_id, path, text from n union all select * from e where not exists (select 1 from n where n.book_id = e.book_id and n.path = e.path)) group by text")
def upsert(s, d):
    li = b.table(s, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("string").alias("path"), F.col("l_linenumber").alias("k"))
    old = li.filter("book_id % 2 = 0").select("book_id", "path", F.lit("old").alias("text"))
    new = li.filter("book_id % 3 = 0 and k <= 2").withColumn("text", F.lit("new"))
    return b.upsert(old, new, b.PAGE_KEYS, ["k"]).groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("books"))


@query("with n as (select o_orderkey book_id, '1' path, o_orderstatus text from orders), e as (select l_orderkey book_id, cast(l_linenumber as varchar) path, 'old' text from lineitem) select text, count(*) n, count(distinct book_id) books from (select * from n union all select distinct * from e where not exists (select 1 from n where n.book_id = e.book_id and n.path = e.path)) group by text")
def upsert_all(s, d):
    """Every line of every order as stored, and a new first line of every order."""
    old = b.table(s, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("string").alias("path"), F.lit("old").alias("text"))
    new = b.table(s, d, "orders").select(F.col("o_orderkey").alias("book_id"), F.lit("1").alias("path"), F.col("o_orderstatus").alias("text"), F.lit(1).alias("k"))
    return b.upsert(old.distinct(), new, b.PAGE_KEYS, ["k"]).groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("books"))


@query(f"with {TEXTS}, gone as (select source from documents group by 1 having cast(regexp_extract(source, '(\\d+)', 1) as bigint) % 2 = 0) select book_id, count(*) pages from texts where book_id not in (select source from gone) group by 1")
def clear_books(s, d):
    ids = b.shelf(s, d).filter(F.regexp_extract("id", r"(\d+)", 1).cast("long") % 2 == 0).select("id")
    return b.count_pages(b.clear_book_pages(b.text_pages(s, d), ids))


@query(f"with {SHELF} select id, case when cast(regexp_extract(id, '(\\d+)', 1) as bigint) % 4 = 0 then 99000 else last_opened end last_opened, title, case when cast(regexp_extract(id, '(\\d+)', 1) as bigint) % 4 = 0 then size + 1 else size end size from shelf")
def save_to_shelf(s, d):
    shelf = b.shelf(s, d)
    opened = shelf.filter(F.regexp_extract("id", r"(\d+)", 1).cast("long") % 4 == 0).select("id", "title", (F.col("size") + 1).alias("size"))
    return b.save_to_shelf(shelf, opened, 99_000).select("id", "last_opened", "title", "size")


@query("select doc_id, 'b' || chr(45) || '' prefix, case when n_chars >= 102400 then printf('%.0f KiB', round(n_chars / 1024.0, 0)) when n_chars >= 10240 then printf('%.1f KiB', round(n_chars / 1024.0, 1)) when n_chars >= 1024 then printf('%.2f KiB', round(n_chars / 1024.0, 2)) else n_chars || ' B' end size, lower(regexp_replace(split_part(text, chr(10), 1), '[^a-z0-9A-Z]+', '', 'g')) short from documents where regexp_matches(split_part(text, chr(10), 1), '^[ -~]*$')")
def text_scalars(s, d):
    rows = b.table(s, d, "documents").withColumn("line", F.element_at(F.split("text", "\n"), 1)).filter(F.col("line").rlike("^[ -~]*$"))
    return rows.select("doc_id", F.substring(t.book_id_for_file("source", "n_chars", "doc_id"), 1, 2).alias("prefix"), t.format_bytes("n_chars").alias("size"), t.compact_compare("line").alias("short"))


@query()
def text_scalars_all(s, d):
    """Ids, sizes and names to compare of all documents, whatever their script."""
    rows = b.table(s, d, "documents").withColumn("line", F.element_at(F.split("text", "\n"), 1))
    return rows.select("doc_id", t.book_id_for_file("source", "n_chars", "doc_id").alias("book_id"), t.format_bytes("n_chars").alias("size"), t.compact_compare("line").alias("short"))


@query("select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), ' ' || chr(10) || chr(9))) clean_md5, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 87 html_length from documents")
def text_forms(s, d):
    return b.table(s, d, "documents").select("doc_id", F.md5(t.clean_text("text")).alias("clean_md5"), F.length(t.plain_text_html("text")).alias("html_length"))


@query("select s_suppkey book_id, case when s_suppkey % 2 = 0 then 'book.chm' else s_name end as name, 'application/vnd.ms-htmlhelp' as type, 0 last_modified, case when s_suppkey % 3 = 0 then 0 else s_suppkey end size from supplier")
def file_catalogue(s, d):
    rows = b.table(s, d, "supplier")
    n = F.col("s_suppkey")
    return b.file_catalogue(rows.select(n.alias("book_id"), F.when(n % 2 == 0, "").otherwise(F.col("s_name")).alias("name"), F.lit("").alias("type"), F.lit(None).cast("long").alias("last_modified"), F.when(n % 3 != 0, n).alias("size")))


@query(f"with {SHELF} select id, case when id = 'src1' then 'My own book' else title end title, id = 'src1' custom_title from shelf")
def rename_book(s, d):
    return b.rename_book(b.shelf(s, d), "src1", "  My\t own   book\n").select("id", "title", "custom_title")


@query(f"with {SHELF} select * from (select id, title, size from shelf) where id = 'src2'")
def get_book(s, d):
    return b.get_book(b.shelf(s, d), "src2").select("id", "title", "size")


@query(f"with {TEXTS}, {SHELF}, gone as (select id from shelf where page_count % 2 = 1 or added_at < 4000) select 'books' kind, count(*) n from shelf where id not in (select id from gone) union all select 'pages', count(*) from texts where book_id not in (select id from gone)")
def delete_books(s, d):
    shelf, pages = b.shelf(s, d), b.text_pages(s, d)
    none = pages.select("book_id")
    left = b.delete_books(shelf, none, pages, none, shelf.filter("page_count % 2 = 1 or added_at < 4000").select("id"))
    return left[0].select(F.lit("books").alias("kind")).unionByName(left[2].select(F.lit("pages").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("select l_suppkey book_id, s_name book_title, count(*) hits from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal > 0 group by 1, 2")
def hits_with_books(s, d):
    hits = b.table(s, d, "lineitem").select(F.col("l_suppkey").alias("book_id"))
    shelf = b.table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return search.hits_with_books(hits, shelf).groupBy("book_id", "book_title").agg(F.count("*").alias("hits"))


@query("select l_suppkey book_id, least(45, count(*)) shown from lineitem group by 1")
def cap_per_book(s, d):
    hits = b.table(s, d, "lineitem").select(F.col("l_suppkey").alias("book_id"), "l_orderkey", "l_linenumber")
    return search.cap_per_book(hits, ["l_orderkey", "l_linenumber"]).groupBy("book_id").agg(F.max("n").alias("shown"))


@query("select l_suppkey book_id, count(*) hits from lineitem group by 1")
def group_by_book(s, d):
    return search.group_by_book(b.table(s, d, "lineitem").withColumnRenamed("l_suppkey", "book_id"))


@query(f"with {RAW}, k as (select book_id, path, doc_pos, list_reduce(list_prepend('', list_transform(regexp_extract_all(translate(lower(path), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '(\\d+|\\D+)'), lambda x: case when regexp_matches(x, '^\\d') then repeat('0', greatest(0, 20 - length(x))) || x else x end)), lambda a, c: a || c) sort_key from raw) select book_id, path, doc_pos, sort_key from k")
def natural_order(s, d):
    return b.raw_pages(s, d).select("book_id", "path", "doc_pos", t.natural_sort_key("path").alias("sort_key"))


@query(f"with {TERMS} select path, replace(lower(label), ' ', '') first_key, 1 n_keys from terms")
def search_keys(s, d):
    rows = b.part_terms(s, d).select("path", t.make_search_keys("label").alias("keys"))
    return rows.select("path", F.col("keys")[0].alias("first_key"), F.size("keys").alias("n_keys"))


@query(f"with {RAW} select book_id, min_by(path, doc_pos) path from raw group by 1")
def choose_sitemap(s, d):
    entries = b.raw_pages(s, d).select("book_id", "path", F.col("doc_pos").alias("entry_pos"))
    return tree.choose_sitemap(entries, entries.filter("false"), ".html")


@query(f"with {RAW} select book_id, path, doc_pos, md5({SEARCH.format(BODY.format('html'))}) text_md5, case when regexp_matches(html, '<table') then 1 else 0 end tables_ from raw")
def live_text(s, d):
    raw = b.raw_pages(s, d)
    return raw.select("book_id", "path", "doc_pos", F.md5(t.search_text(t.page_body("html"))).alias("text_md5"), F.col("html").contains("<table").cast("int").alias("tables_"))


@query("select conv_id book_id, cast(turn as bigint) pos, role || ' ' || turn as name, lag(role || ' ' || turn) over (partition by conv_id order by turn) prev_name from conversations")
def conversation_spine(s, d):
    c = b.table(s, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("long").alias("pos"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("name"))
    return c.withColumn("prev_name", F.lag("name").over(tree.by_book("pos")))


# --- activity -----------------------------------------------------------------------


@query(f"with {ACTS}, l as (select reader_id, path, ts, seq, row_number() over (partition by reader_id, lower(path) order by ts desc, seq desc) k from acts where kind = 'visit'), r as (select *, row_number() over (partition by reader_id order by ts desc, seq desc) n from l where k = 1) select reader_id, n, path, split_part(path, '/', -1) title, ts from r where n <= 40")
def recent_pages(s, d):
    return activity.recent_pages(b.activity(s, d).filter("kind = 'visit'"))


@query(f"with {ACTS}, v as (select reader_id, seq, path, row_number() over w r, lag(lower(path)) over w p from acts where kind = 'visit' window w as (partition by reader_id order by ts, seq)) select reader_id, seq, path from v where r = 1 or lower(path) <> p")
def history_pushes(s, d):
    return activity.history_pushes(b.activity(s, d).filter("kind = 'visit'")).select("reader_id", "seq", "path")


@query(f"with {ACTS}, g as (select reader_id, lower(path) p, count(*) c, max_by(path, (ts, seq)) path, max(ts) ts from acts where kind = 'toggle' group by 1, 2) select reader_id, path, ts from g where c % 2 = 1")
def bookmarks_below_cap(s, d):
    return activity.bookmarks_below_cap(b.activity(s, d).filter("kind = 'toggle'"))


@query(f"with {ACTS}, g as (select reader_id, lower(path) p, count(*) c, max_by(path, (ts, seq)) path, max(ts) ts, max((ts, seq)) o from acts where kind = 'toggle' group by 1, 2) select reader_id, cast(row_number() over (partition by reader_id order by o desc) as integer) n, path, ts from g where c % 2 = 1")
def bookmarks(s, d):
    return activity.bookmarks(b.activity(s, d).filter("kind = 'toggle'"))


@query()
def history_stack(s, d):
    return activity.history_stack(b.activity(s, d))


@query(f"with {STATUS}, l as (select book_id, max_by(type, seq) type, max_by(done, seq) done, max_by(total, seq) total from status group by 1) select book_id, case type when 'done' then 'ready' when 'error' then 'error' else 'building' end state, done, total, greatest(0, least(100, cast(floor(done * 100.0 / total + 0.5) as integer))) percent from l")
def index_progress(s, d):
    return activity.index_progress(b.index_status(s, d))


@query("with m as (select user_id, max(event_id // 100) g from events group by 1) select e.user_id, event_id from events e join m on m.user_id = e.user_id and event_id // 100 = g")
def drop_stale(s, d):
    rows = b.table(s, d, "events").withColumn("generation", F.floor(F.col("event_id") / 100))
    return activity.drop_stale(rows, "user_id", "generation").select("user_id", "event_id")


@query(f"with {ACTS}, l as (select reader_id, path, ts, seq, row_number() over (partition by reader_id, lower(path) order by ts desc, seq desc) k from acts where kind = 'visit') select reader_id, least(40, count(*))::integer n_items, max_by(path, (ts, seq)) first_path from l where k = 1 group by 1")
def lists_json(s, d):
    lists = activity.lists_to_json(activity.recent_pages(b.activity(s, d).filter("kind = 'visit'")))
    return activity.lists_from_json(lists).select("reader_id", F.size("items").alias("n_items"), F.col("items")[0]["path"].alias("first_path"))


# --- streams ------------------------------------------------------------------------


@query(f"with {STATUS}, l as (select book_id, max_by(type, seq) type, max_by(done, seq) done, max_by(total, seq) total from status group by 1) select book_id, case type when 'done' then 'ready' when 'error' then 'error' else 'building' end state, done, total from l")
def stream_latest_status(s, d):
    e = jobs.table_stream(s, d, "events")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("progress")
    return jobs.latest_status(e.select(F.col("user_id").alias("book_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.floor(F.abs("value")).cast("long").alias("done"), F.lit(500).alias("total")))


@query(ORACLE_SQL["recent_pages"])
def stream_recent_pages(s, d):
    e = jobs.table_stream(s, d, "events").filter("event_type = 'view'")
    path = F.concat(F.lit("/k/"), F.get_json_object("props", "$.k"), F.lit(".html"))
    return jobs.recent_pages(e.select(F.col("user_id").alias("reader_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), path.alias("path"), F.lit(None).cast("string").alias("title")))


def _page_stream(s, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    path = F.concat(F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1), "/$", ""), r"\.html$", ""), F.lit(".html"))
    return jobs.table_stream(s, d, "pages").select(host.alias("book_id"), path.alias("path"), F.col("page_id").alias("doc_pos"), "html")


@query(f"with {PAGES}, k as (select *, row_number() over (partition by book_id, path order by doc_pos desc) n from pg) select book_id, path, doc_pos, length(text) n_chars from k where n = 1")
def stream_index(s, d):
    return jobs.incremental_index(_page_stream(s, d))[0].select("book_id", "path", "doc_pos", F.length("text").alias("n_chars"))


@query(f"with {PAGES}, last as (select * from (select *, row_number() over (partition by book_id, path order by doc_pos desc) m from pg) where m = 1), c as (select book_id, path, doc_pos, 0 pattern_no, trim(regexp_replace(title, '\\s+', ' ', 'g')) label, '页面标题' source from last union all select book_id, path, doc_pos, 1, trim(regexp_replace({STRIP.format('h')}, '\\s+', ' ', 'g')), '正文术语' from (select book_id, path, doc_pos, unnest(regexp_extract_all({BODY.format('html')}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)) h from last)), k as (select *, row_number() over (partition by book_id, lower(label) order by doc_pos, pattern_no, path) n from c where length(label) between 2 and 70 and len(regexp_extract_all(label, '[。！？!?；;]')) <= 1) select book_id, path, label, source from k where n = 1")
def stream_index_terms(s, d):
    return jobs.incremental_index(_page_stream(s, d))[1].select("book_id", "path", "label", "source")
