"""Registered queries over books made of the tables' rows: pages with many terms, tables, anchors, foreign encodings, contents files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as t
from .operators import activity, extract, page_tree, search, tree
from .plans import library
from .registry import ACTS, COUNT, ORACLE_SQL, PAGES, QUERIES, RAW, TEXTS, query
from .sources import books as b
from .sources.page_store import PageStore
from .sources.storage import work_folder
from .streaming import jobs

L = F.lit


def _part(s: SparkSession, d: str) -> DataFrame:
    return b.table(s, d, "part").withColumn("k", F.col("p_partkey").cast("string"))


def _pages(rows: DataFrame, size: int, section: Column) -> DataFrame:
    """page, inner: so many parts a page, each with its section, in order of keys."""
    page = F.expr(f"p_partkey div {size}").alias("page")
    lists = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("p_partkey", section.alias("html")))).alias("l"))
    return lists.select("page", F.array_join(F.transform("l", lambda x: x["html"]), "").alias("inner"))


@query(
    """with recursive c as (select p_partkey // 50 page, p_partkey k, p_name || ' ' || (p_partkey % 3) h, p_type t from part),
l as (select distinct page, 0 pat, 0 pos, 'Page ' || page x from c union all select page, 1, k, h from c union all select page, 2, k, t from c),
u as (select page, x, min(pat * 1000000000 + pos) place from l group by page, x),
p as (select page % 5 b, page // 5 n, page, list(x order by place) xs from u group by page),
r as (select b, n, page, xs[1:40] got, xs[1:40] seen from p where n = 0 union all select p.b, p.n, p.page, list_filter(p.xs, lambda x: not list_contains(r.seen, x))[1:40], list_concat(r.seen, list_filter(p.xs, lambda x: not list_contains(r.seen, x))[1:40]) from r join p on p.b = r.b and p.n = r.n + 1)
select 'b' || b as book_id, '/' || page || '.html' as path, unnest(got) as label from r"""
)
def terms_over_cap(s, d):
    """Pages with over 40 terms: what one page cuts off is free for the next page of its book."""
    section = F.concat(L("<h2>"), "p_name", L(" "), (F.col("p_partkey") % 3).cast("string"), L("</h2><dl><dt>"), "p_type", L("</dt></dl>"))
    page = F.col("page").cast("string")
    raw = _pages(_part(s, d), 50, section).select(F.concat(L("b"), (F.col("page") % 5).cast("string")).alias("book_id"), F.concat(L("/"), page, L(".html")).alias("path"), F.col("page").alias("doc_pos"), F.concat(L("<html><title>Page "), page, L("</title><body>"), "inner", L("</body></html>")).alias("html"))
    return extract.extract_terms(extract.extract_pages(raw), exact=True).select("book_id", "path", "label")


_WEIGHT = "(0.28 * (length({0}) - length(replace({0}, ' ', ''))) + 0.62 * length(regexp_replace({0}, '[^A-Z0-9]', '', 'g')) + 0.5 * length(regexp_replace({0}, '[A-Z0-9 ]', '', 'g')))"


@query(
    f"""with c as (select p_partkey k, p_size % 4 + 1 + p_size % 3 span, {_WEIGHT.format("p_name")} n, {_WEIGHT.format("p_type")} t, {_WEIGHT.format("p_brand")} b, {_WEIGHT.format("(p_type || ' ' || p_name)")} tn from part),
w as (select k, 0 no, greatest(span, 2) columns, [n, n, t * 2, t, t] w from c union all select k, 1, 2, [b, tn] from c),
x as (select k, no, columns, len(list_filter(w, lambda x: x > 9)) l, len(list_filter(w, lambda x: x > 12)) v, len(list_filter(w, lambda x: x > 24)) xl from w)
select k as doc_pos, no::int as table_no, columns::bigint as columns, l::bigint as long_cells, v::bigint as very_long, xl::bigint as xlong, columns >= 5 or (columns >= 4 and l >= 2) as wide, columns between 2 and 3 as labels from x"""
)
def table_profiles(s, d):
    """Tables with spans, cells that nothing closes, and tables inside; a second one with a body."""
    span, more = (F.col("p_size") % 4 + 1).cast("string"), F.repeat(L("<td>x"), (F.col("p_size") % 3).cast("int"))
    one = F.concat(L("<table><tr><th colspan='"), span, L("'>"), "p_name", more, L("<tr><td>"), "p_name", L("<td><table><tr><td>"), "p_type", L("<td>"), "p_type", L("</table></td></tr></table>"))
    two = F.concat(L("<p>then</p><table><tbody><tr><th>"), "p_brand", L("<td>"), "p_type", L(" <b>"), "p_name", L("</b></tbody></table>"))
    raw = _part(s, d).select(F.col("p_brand").alias("book_id"), F.concat(L("/part/"), "k", L(".html")).alias("path"), F.col("p_partkey").alias("doc_pos"), F.concat(one, two).alias("html"))
    return page_tree.profile_tables(raw).select("doc_pos", "table_no", "columns", "long_cells", "very_long", "xlong", "wide", "labels")


@query(
    """with c as (select p_partkey k, p_partkey // 20 page, p_name n, trim(repeat(p_type || ' ', p_partkey % 120)) f, p_size z, p_brand b from part),
x as (select page, k, n, left(concat_ws(chr(10) || chr(10), nullif(f, ''), 'Size ' || z, 'x' || k, b), 1800) t from c)
select '/' || page || '.html' as path, a || k as fragment, n as title, length(t)::int as n_chars, md5(t) as text_md5 from x, (values ('p'), ('q')) v(a)"""
)
def fragment_previews(s, d):
    """What every heading and every anchor inside one leads to: up to the next heading of its rank."""
    filler = F.repeat(F.concat("p_type", L(" ")), (F.col("p_partkey") % 120).cast("int"))
    section = F.concat(L("<h2 id='p"), "k", L("'><a name='q"), "k", L("'></a>"), "p_name", L("</h2><p>"), filler, L("</p><div>Size <b>"), F.col("p_size").cast("string"), L("</b></div><h3>x"), "k", L("</h3>loose<ul><li>"), "p_brand", L("</ul>"))
    raw = _pages(_part(s, d), 20, section).select(L("parts").alias("book_id"), F.concat(L("/"), F.col("page").cast("string"), L(".html")).alias("path"), F.concat(L("<body>"), "inner", L("</body>")).alias("html"))
    nodes = page_tree.page_nodes(raw)
    got = page_tree.fragment_preview(nodes, page_tree.anchors_of(nodes))
    return got.select("path", "fragment", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    """select '/' || p_partkey // 20 || '.html' as path, p_name || ' ' || p_partkey as label, (2 * (p_partkey % 20) + 1)::int as anchor, 10000 + length(regexp_replace(p_name || p_partkey, ' ', '', 'g'))::int as score from part"""
)
def fragment_targets(s, d):
    """Twenty elements of one anchor: the label says which is meant."""
    p = _part(s, d)
    own = F.concat("p_name", L(" "), "k")
    page = F.concat(L("/"), F.expr("p_partkey div 20").cast("string"), L(".html"))
    raw = _pages(p, 20, F.concat(L("<p id='a b'>"), own, L("</p>"))).select(L("parts").alias("book_id"), F.concat(L("/"), F.col("page").cast("string"), L(".html")).alias("path"), F.concat(L("<body>"), "inner", L("</body>")).alias("html"))
    asked = p.select(L("parts").alias("book_id"), page.alias("path"), L("a%20b").alias("fragment"), F.upper(own).alias("label"))
    got = page_tree.fragment_target(page_tree.page_nodes(raw), asked)
    return got.select("path", F.lower("label").alias("label"), "anchor", "score")


@query(
    """with c as (select r_name, n_nationkey n, n_name, c_custkey c, c_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
x as (select distinct r_name, -1 n, -1 c, r_name as name, null::varchar p, 0 depth, '' above from c union all select distinct r_name, n, -1, n_name, r_name, 1, r_name from c union all select r_name, n, c, c_name, n_name, 2, r_name || '>' || n_name from c)
select r_name as book_id, (row_number() over (partition by r_name order by n, c) - 1)::int as node_id, name, p as parent, depth, above, case depth when 0 then '/toc/index.htm' when 1 then '/n/' || n || '.htm' else '/toc/c/' || c || '.htm' end as "local" from x"""
)
def parsed_contents_tree(s, d):
    """Contents files of three levels, one for each region, parsed: order, parents, ancestors and targets."""
    c, n, r = (b.table(s, d, x) for x in ("customer", "nation", "region"))
    topic = lambda name, page: F.concat(L('<li><object type="text/sitemap"><param name="Name" value="'), name, L('"><param name="Local" value="'), page, L('"></object>'))
    lists = lambda rows, by, key: rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "html"))), lambda x: x["html"]), "\n").alias("inner"))
    named = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    low = lists(named.select("r_name", "n_nationkey", "n_name", "c_custkey", topic(F.col("c_name"), F.concat(L("c/"), F.col("c_custkey").cast("string"), L(".htm#top"))).alias("html")), ["r_name", "n_nationkey", "n_name"], "c_custkey")
    page = F.concat(L("../n/"), F.col("n_nationkey").cast("string"), L(".htm"))
    mid = lists(low.select("r_name", "n_nationkey", F.concat(topic(F.col("n_name"), page), L("<ul>"), "inner", L("</ul>")).alias("html")), ["r_name"], "n_nationkey")
    files = mid.select(F.col("r_name").alias("book_id"), L("/toc/a.hhc").alias("base"), F.concat(L("<html><body><ul>"), topic(F.col("r_name"), L("index.htm")), L("<ul>"), "inner", L("</ul></ul></body></html>")).alias("text"))
    nodes = tree.parse_sitemap(files)
    names = nodes.select("book_id", F.col("node_id").alias("_a"), F.col("name").alias("_name"))
    up = nodes.select("book_id", "node_id", F.posexplode("ancestors").alias("_i", "_a")).join(names, ["book_id", "_a"]).groupBy("book_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_name"))).alias("_l"))
    above = F.coalesce(F.array_join(F.transform("_l", lambda x: x["_name"]), ">"), L(""))
    own = nodes.join(names.withColumnRenamed("_a", "parent_id"), ["book_id", "parent_id"], "left")
    return own.join(up, ["book_id", "node_id"], "left").select("book_id", "node_id", "name", F.col("_name").alias("parent"), "depth", above.alias("above"), "local")


#: Moves of each reader one after another: the entries so far and the place among them.
ORACLE_SQL["history_stack"] = f"""with recursive {ACTS}, m as (select reader_id, kind, path, row_number() over (partition by reader_id order by ts, seq) n from acts where kind in ('visit', 'back', 'forward')),
r as (select distinct reader_id, 0::bigint n, []::varchar[] st, 0 cur from m
union all select r.reader_id, m.n, case when kind = 'visit' and path is not null and (cur = 0 or lower(st[cur]) <> lower(path)) then list_append(st[1:cur], path) else st end,
case when kind = 'visit' and path is not null and (cur = 0 or lower(st[cur]) <> lower(path)) then cur + 1 when kind = 'forward' and cur < len(st) then cur + 1 when kind = 'back' and cur > 1 then cur - 1 else cur end
from r join m on m.reader_id = r.reader_id and m.n = r.n + 1),
e as (select reader_id, arg_max(st, n) st, arg_max(cur, n) cur from r group by reader_id)
select reader_id, i::int as n, st[i] as path, i = cur as current from (select *, unnest(range(1, len(st) + 1)) i from e)"""


@query(ORACLE_SQL["history_stack"])
def stream_history_stack(s, d):
    """Reading history from a stream of events, the stack as keyed state."""
    return jobs.history_stack(b.activity_of(jobs.table_stream(s, d, "events")))


@query(ORACLE_SQL["drop_stale"])
def stream_drop_stale(s, d):
    """Answers of each user's newest generation, from a stream of events."""
    rows = jobs.table_stream(s, d, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 100).alias("generation"))
    return jobs.drop_stale(rows, "user_id", "generation", "event_id").select("user_id", "event_id")


@F.pandas_udf(T.BinaryType())
def _encoded(text: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([x.encode(c).replace(b"\x01", b"\xff") for x, c in zip(text, codec, strict=True)])


#: Pages by the last digit of their number: codec, the label that they state, a text of that script.
FOREIGN = [("gbk", "gb2312", "规则 "), ("shift_jis", "Shift_JIS", "ルール "), ("big5", "big5", "規則 "), ("utf-8", "", "règle "), ("gbk", "gbk", "broken \x01 "), ("ascii", "x-none", "plain "), ("euc-kr", "cp949", "규칙 "), ("cp1251", "windows-1251", "Правило ")]


@query(
    f"""with f(i, label, enc, txt, reason) as (values {", ".join(f"({i}, '{n}', '{e}', '{x}', {r})" for i, (n, e, x, r) in enumerate([("gb2312", "gbk", "规则 ", "null"), ("Shift_JIS", "shift_jis", "ルール ", "null"), ("big5", "big5", "規則 ", "null"), ("", "utf-8", "règle ", "null"), ("gbk", "gbk", "broken � ", "'replacement characters'"), ("x-none", "windows-1252", "plain ", "'unknown label'"), ("cp949", "euc-kr", "규칙 ", "null"), ("windows-1251", "windows-1251", "Правило ", "null"), ("", "", "", "'no content'"), ("", "", "", "'too long'")]))})
select p_partkey as doc_pos, case when i < 8 then enc end as encoding, case when i < 8 then txt || p_name end as title, case when i < 8 then txt || p_type || chr(10) || txt || p_brand end as text, i < 8 as indexed, reason from part join f on p_partkey % 10 = i"""
)
def checked_pages(s, d):
    """Pages in eight encodings, some with bytes that are none or labels that nobody knows, some without content or too long: what is indexed, and what is reported."""
    p, i = _part(s, d), F.col("p_partkey") % 10
    pick = lambda k: F.get(F.array(*[L(x[k]) for x in FOREIGN]), i.cast("int"))
    label = F.when(pick(1) != "", F.concat(L("<meta charset='"), pick(1), L("'>"))).otherwise("")
    html = F.concat(label, L("<title>"), pick(2), "p_name", L("</title><body><p>"), pick(2), "p_type", L("</p>"), pick(2), "p_brand", L("</body>"))
    content = F.when(i < 8, _encoded(F.when(i < 8, html).otherwise(""), F.when(i < 8, pick(0)).otherwise("ascii"))).when(i == 9, F.encode("p_name", "UTF-8"))
    raw = p.select(F.col("p_brand").alias("book_id"), F.concat(L("/"), "k", L(".htm")).alias("path"), F.col("p_partkey").alias("doc_pos"), content.alias("content"), F.when(i == 9, extract.LARGEST + 1).cast("long").alias("length"))
    pages, failed = extract.checked_pages(raw)
    return pages.select("doc_pos", "encoding", "title", "text", L(True).alias("_in")).join(failed, "doc_pos", "full").select("doc_pos", "encoding", "title", "text", F.coalesce("_in", "indexed").alias("indexed"), "reason")


@query(
    """with recursive t as (select l_suppkey s, '/part/' || l_partkey p, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) i from lineitem),
r as (select distinct s, 0::bigint i, []::varchar[] l from t union all select r.s, t.i, case when list_contains(r.l, t.p) then list_filter(r.l, lambda x: x <> t.p) else list_prepend(t.p, r.l)[1:120] end from r join t on t.s = r.s and t.i = r.i + 1),
e as (select s, arg_max(l, i) l from r group by s)
select s as reader_id, n::int as n, l[n] as path from (select *, unnest(range(1, len(l) + 1)) n from e)"""
)
def bookmarks_over_cap(s, d):
    """Bookmarks of readers who marked far more pages than a list holds: what a full list drops can be added again."""
    rows = b.table(s, d, "lineitem").select(F.col("l_suppkey").alias("reader_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("seq"), F.col("l_orderkey").cast("long").alias("ts"), F.concat(L("/part/"), F.col("l_partkey").cast("string")).alias("path"))
    return activity.bookmarks(rows).select("reader_id", "n", "path")


def _reindexed(s: SparkSession, d: str) -> tuple[DataFrame, PageStore]:
    """The shelf after a job over all hosts, a third of them ready before, and the store."""
    raw = b.raw_pages(s, d)
    store = PageStore(s, work_folder(s, "pages"))
    old = raw.select("book_id", "path", "doc_pos", L("old").alias("title"), L("before").alias("text"))
    store.rebuild(old)
    state = F.get(F.array(L("ready"), L("building"), L("error")), F.length("book_id") % 3)
    shelf = raw.select("book_id").distinct().select(F.col("book_id").alias("id"), state.alias("index_state"))
    return library.reindex(raw, shelf, store), store


@query(f"with {PAGES} select book_id, path, doc_pos, case when length(book_id) % 3 = 0 then 'old' else coalesce(nullif(title, ''), path) end as title, case when length(book_id) % 3 = 0 then 6 else length(text) end::int as n_chars from pg")
def reindexed_pages(s, d):
    """Pages in the store after books that needed it were rebuilt as wholes; ready books keep what they had."""
    return _reindexed(s, d)[1].read().select("book_id", "path", "doc_pos", "title", F.length("text").alias("n_chars"))


@query(f"with {RAW} select book_id as id, 'ready' as index_state, case when length(book_id) % 3 > 0 then count(*) end as index_done, case when length(book_id) % 3 > 0 then count(*) end as index_total from raw group by book_id")
def reindexed_shelf(s, d):
    """States and counts of the shelf after the job."""
    return _reindexed(s, d)[0].select("id", "index_state", "index_done", "index_total")


#: Labels whose rules add keys, with their initials and the keys.
ALIASED = [("借机攻击", "jjgj", "opportunityattack,opportunity,oa"), ("倒地", "dd", "prone"), ("受擒", "sq", "grapple,grappled"), ("震慑", "zs", "stunned,stun"), ("昏迷", "hm", "unconscious"), ("失能", "sn", "incapacitated"), ("束缚", "sf", "restrained"), ("隐形", "yx", "invisible"), ("魅惑", "mh", "charmed"), ("恐慌", "kh", "frightened"), ("中毒", "zd", "poisoned"), ("无名", "wm", "")]


@query(
    f"""with f(i, label, first, more) as (values {", ".join(f"({i}, '{x}', '{y}', '{z}')" for i, (x, y, z) in enumerate(ALIASED))}), p as (select p_partkey, lower(replace(p_name, ' ', '')) n from part)
select p_partkey, concat_ws(',', label || n, first || n, n, nullif(more, '')) as keys from p join f on p_partkey % {len(ALIASED)} = i"""
)
def alias_keys(s, d):
    """All search keys of labels with an alias: the label, its initials, its English words, and what the rule adds."""
    label = F.concat(F.get(F.array(*[L(x[0]) for x in ALIASED]), (F.col("p_partkey") % len(ALIASED)).cast("int")), L(" "), "p_name")
    return _part(s, d).select("p_partkey", F.array_join(t.make_search_keys(label), ",").alias("keys"))


@query("""select p_partkey, case p_partkey % 3 when 2 then '' else '<svg><title>' || p_name || '</title><g><a href="#p' || p_partkey || '">' || p_type || '</a><image /></g></svg>' end as svg from part""")
def cleaned_svg(s, d):
    """Drawings without scripts, handlers and outer references; what cannot be parsed is empty."""
    body = F.concat(L("<svg onload='x()'><title>"), "p_name", L("</title><script>bad</script><g><a href='#p"), "k", L("' onclick='y'>"), "p_type", L("</a><image href='http://h/"), "k", L(".png'/><foreignObject><p>z</p></foreignObject></g></svg>"))
    return _part(s, d).select("p_partkey", extract.sanitize_svg(F.when(F.col("p_partkey") % 3 == 2, F.concat(L("<svg>"), "p_name")).otherwise(body)).alias("svg"))


@query(
    """with x as (select doc_id, string_split(lower(text), 'er') w, doc_id % 7 n from documents), y as (select doc_id, w, least(n, len(w) - 2) k from x where len(w) > 1)
select doc_id, (list_sum(list_transform(w[1 : k + 1], lambda p: length(p))) + 2 * k)::int as span_start, (list_sum(list_transform(w[1 : k + 1], lambda p: length(p))) + 2 * k + 2)::int as span_end from y"""
)
def nth_spans(s, d):
    """Where the first to seventh hit of a word part lies in each document, the last one where there are fewer."""
    x = search.nth_occurrence_span("text", "ER", (F.col("doc_id") % 7).cast("int"))
    return b.table(s, d, "documents").select("doc_id", x.alias("x")).filter("x is not null").select("doc_id", F.col("x.start").alias("span_start"), F.col("x.end").alias("span_end"))


@query(
    f"""with {TEXTS}, h as (select doc_pos, path, title, least(60, {COUNT.format("lower(text)", "'tion'")}) n from texts where contains(lower(text), 'tion') order by doc_pos limit 100),
m as (select doc_pos, path, title, unnest(range(n)) o from h), f as (select * from m order by doc_pos, path, o limit 180),
i as (select path, title, length(title) % 50 score from texts where contains(lower(title), 'an') and lower(path) not in (select lower(path) from h) order by score desc, title, path limit 60)
select 'instant' as section, path, title, null::int as occurrence_index from i union all select 'full', path, title, o::int from f"""
)
def merged_rows(s, d):
    """Quick hits on first lines, some of them twice, without pages that texts hit, then the texts' matches: all rows."""
    pages = b.text_pages(s, d)
    one = pages.filter(F.lower("title").contains("an")).select("path", "title", (F.length("title") % 50).alias("score"), L(None).cast("string").alias("anchor"))
    local = one.unionByName(one.withColumns({"path": F.upper("path"), "score": F.col("score") - 100}))
    found = pages.filter(F.lower("text").contains("tion")).orderBy("doc_pos").limit(100).withColumn("found", search.match_positions(F.lower("text"), "tion"))
    full = found.select("doc_pos", "path", "title", search.snippets_live("text", "found", "tion").alias("matches"))
    return search.merged_results(local, full).select("section", "path", "title", "occurrence_index")


#: Forms cut to small limits or subsets, and one that finds nothing: each has a whole form registered beside it (indexable_all,
#: keyword_listing_all, running_cap_all, search_scopes_all, quick_search_in_node, upsert_all, score_terms_found, merged_rows).
for _name in ("indexable", "keyword_listing", "running_cap", "search_scopes", "quick_search_in_scope", "upsert", "score_terms", "merged_results"):
    QUERIES.pop(_name), ORACLE_SQL.pop(_name)
