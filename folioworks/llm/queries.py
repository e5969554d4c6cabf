"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, collocations, decontaminate, html_extract, kneser_ney, lexical, near_dedup, simhash, substring_dedup, token_counts, toxicity, warc
from ._common import table

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), MULTI, public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PLAIN, public_tokenizers.PATTERN)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_near_dedup, op4_toxicity, op5_quality, op6_warc, op7_token_counts, op8_html_extraction, op9_nearest_neighbours, op10_substring_dedup, op11_collocations, op12_lexical_search, op13_simhash)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BENCH_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
with d as (select doc_id, {_BENCH_WORDS} as w from documents),
b as (select item_id, {_BENCH_WORDS} as w from benchmark),
bw as (select item_id, w, least(10, len(w)) as m from b where len(w) > 0),
items as (select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as k from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as i from bw)),
places as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from items) where len(w) >= m),
found as (select doc_id, i, p.m, item_id from (select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as k from places) p join items using (m, k)),
hit as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + m)) as j from found) group by doc_id),
ids as (select doc_id, list_sort(list(distinct item_id::varchar)) as l from found group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(len(l), 0)::bigint as n_items, sha256(coalesce(array_to_string(l, ','), '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
from d left join hit using (doc_id) left join ids using (doc_id)""",
    "op6_warc": """
with p as (select page_id, url, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first from p where strlen(h) >= 100 group by h)
select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to, url as target_uri
from p left join f using (h)""",
    "op10_substring_dedup": """
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
k as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from k) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from late),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
kept as (select doc_id, string_agg(x, ' ' order by j) as t, count(*) as n from word anti join gone using (doc_id, j) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op11_collocations": f"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
p as (select lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as p from d)),
g as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as g, count(*) as f from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from p, (values (1), (2), (3)) s(m) where len(w) >= m) group by all),
c as (select *, string_split(g, ' ') as w from g where m > 1 and f >= 10),
k as (select lang, m, g, w, f, unnest(range(1, m)) as k from c),
s as (select k.lang, k.m, k.g, k.w, k.f as a, k.k, x.f as l, y.f as r, (1000000::hugeint * k.f * k.f) // (x.f::hugeint * y.f) as score from k join g x on x.lang = k.lang and x.g = array_to_string(w[1 : k.k], ' ') join g y on y.lang = k.lang and y.g = array_to_string(w[k.k + 1 : k.m], ' ')),
b as (select * from s qualify row_number() over (partition by lang, g order by score, k) = 1),
o as (select lang, array_to_string(w[i : i + 1], ' ') as g, max(f) as longer from (select lang, w, f, unnest([1, 2]) as i from c where m = 3) group by all),
v as (select b.*, row_number() over (partition by lang order by score desc, a desc, g) as rank from b left join o using (lang, g) where longer is null or m = 3 or 100 * longer < 50 * a),
n as (select lang, sum(f)::bigint as n from g where m = 1 group by lang)
select lang, rank, g as phrase, a, l, r, n, score::bigint as score from v join n using (lang) where rank <= 2000""",
    "op12_lexical_search": f"""
with d as (select doc_id, {_BENCH_WORDS} as w from documents),
i as (select distinct item_id, unnest({_BENCH_WORDS}) as t from benchmark),
s as (select count(*) filter (len(w) > 0) as n_docs, sum(len(w))::bigint as n_terms from d),
f as (select doc_id, n, t, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as t from d) where t in (select t from i) group by all),
k as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from (select t, count(*) as df from f group by t), s),
x as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::bigint as score from f join k using (t) join i using (t), s group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10""",
}
