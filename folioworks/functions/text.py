"""Text functions: Column in, Column out, without Python workers unless noted.

White space means the Unicode spaces and the byte order mark, as browsers have it.
Lengths and cuts count code points. Null in gives null out, unless stated.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import helpers, tables

WS = r"[\t-\r    -     　﻿]"
HAN = r"[㐀-鿿]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replace(x, pattern: str, by: str) -> Column:
    return F.regexp_replace(_c(x), pattern, by)


def trim(x) -> Column:
    return replace(x, f"^{WS}+|{WS}+$", "")


def collapse(x) -> Column:
    """Runs of white space to one blank, trimmed."""
    return trim(replace(x, f"{WS}+", " "))


def let(x: Column, f) -> Column:
    """f(x), with x computed once however often f uses it. f takes no Python functions."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(y) for pair in table.items() for y in pair])


def _first(*x: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(y, F.lit("")) for y in x], F.lit(""))


def last_segment(path) -> Column:
    return _first(F.element_at(F.split(_c(path), "/"), -1), _c(path))


# --- predicates and lookups ---------------------------------------------------------


def is_content_page(path, length) -> Column:
    return _c(path).rlike("^/(?![#$:])") & _c(path).rlike(r"(?i)\.(x?html?|xht)$") & (_c(length) > 0)


def is_page(path, length) -> Column:
    return _c(path).rlike(r"(?i)\.(x?html?|xht)$") & (_c(length) > 0)


def natural_sort_key(x) -> Column:
    """Lower case without accents, digit runs padded: sorts numbers by value."""
    folded = F.translate(F.lower(_c(x)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    parts = F.regexp_extract_all(folded, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 20 - F.length(p))), p)).otherwise(p)), "")


def mime_for(path, table: dict = tables.MIME) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(_c(path), F.lit("")), r"\.([^.?#/]+)(?:[?#]|$)", 1))
    return F.coalesce(F.element_at(_lookup(table), ext), F.lit("application/octet-stream"))


def is_external(url) -> Column:
    return trim(F.coalesce(_c(url), F.lit(""))).rlike("(?i)^(?:https?:|mailto:|tel:|ftp:|javascript:|about:|file:|blob:)")


def charset_alias(name, table: dict = tables.CHARSETS) -> Column:
    return F.element_at(_lookup(table), F.lower(_c(name)))


def lcid_charset(lcid, table: dict = tables.LOCALES) -> Column:
    return F.element_at(_lookup(table), _c(lcid).bitwiseAND(0xFFFF).cast("int"))


# --- encodings ----------------------------------------------------------------------


def charset_label(content) -> Column:
    """The charset that the first 8,192 bytes name, '' for none."""
    head = F.decode(F.substring(_c(content), 1, 8192), "ISO-8859-1")
    return F.regexp_extract(head, r"(?i)charset\s*=\s*[\"']?\s*([\w.:-]+)", 1)


def detect_encoding(content, lcid=None) -> Column:
    b = _c(content)
    lcid = F.lit(0) if lcid is None else _c(lcid)
    named = charset_alias(charset_label(b))
    bom = F.hex(F.substring(b, 1, 3)) == "EFBBBF"
    utf8 = F.is_valid_utf8(F.substring(b, 1, 65536)) & (F.octet_length(b) > F.length(F.decode(b, "UTF-8")))
    return F.when(bom, "utf-8").otherwise(F.coalesce(named, F.when(utf8, F.lit("utf-8")), lcid_charset(lcid), F.lit("windows-1252")))


def active_encoding(content, book_encoding, override=None) -> Column:
    sniffed = detect_encoding(content)
    forced = F.lit(None).cast("string") if override is None else F.nullif(_c(override), F.lit(""))
    return F.coalesce(forced, F.when(sniffed != "windows-1252", sniffed), F.nullif(_c(book_encoding), F.lit("")), sniffed)


decode_bytes = helpers.decode_bytes
decode_entities_once = helpers.decode_entities_once
nfkc = helpers.nfkc


# --- markup -------------------------------------------------------------------------


def _char(code: Column) -> Column:
    """The character of a code point; a blank where there is none."""
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char).otherwise(F.lit(" "))


def _numeric(x: Column, pattern: str, base: int) -> Column:
    def decoded(y: Column) -> Column:
        texts = F.split(y, pattern, -1)
        codes = F.transform(F.regexp_extract_all(y, F.lit(pattern), 1), lambda d: F.when(F.length(d) > 15, F.lit(-1)).otherwise(F.conv(d, base, 10).cast("bigint")))
        chars = F.concat(F.transform(codes, _char), F.array(F.lit("")))
        return F.when(y.contains("&#"), F.array_join(F.zip_with(texts, chars, lambda t, ch: F.concat(t, ch)), "")).otherwise(y)

    return let(x, decoded)


def decode_entities(x) -> Column:
    """Named entities one after another, then decimal, then hexadecimal ones."""
    y = _c(x)
    for pattern, by in (("(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'")):
        y = replace(y, pattern, by)
    return _numeric(_numeric(y, r"&#(\d+);", 10), "(?i)&#x([0-9a-f]+);", 16)


def _without_active(x: Column) -> Column:
    return replace(replace(x, r"(?is)<script\b[^>]*>.*?</script>", " "), r"(?is)<style\b[^>]*>.*?</style>", " ")


def strip_tags(html) -> Column:
    y = replace(_without_active(_c(html)), "(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/dt|/dd)>", "\n")
    y = decode_entities(replace(y, "<[^>]+>", " "))
    return trim(replace(replace(replace(y, r"[ \t ]+", " "), r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def search_text(html) -> Column:
    y = replace(_without_active(_c(html)), "<[^>]+>", " ")
    return replace(replace(replace(y, "(?i)&nbsp;", " "), "(?i)&(?:amp|lt|gt|quot);", " "), f"{WS}+", " ")


def _title_markup(html) -> Column:
    return F.regexp_extract(_c(html), r"(?is)<title\b[^>]*>(.*?)</title>", 1)


def page_title(html, path) -> Column:
    return _first(strip_tags(_title_markup(html)), last_segment(path))


def page_title_search(html, path) -> Column:
    y = replace(_title_markup(html), "<[^>]+>", " ")
    for pattern, by in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"')):
        y = replace(y, pattern, by)
    return _first(collapse(y), last_segment(path))


def page_body(html) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_c(html), r"(?is)<body\b[^>]*>(.*?)</body>", 1), F.lit("")), replace(html, r"(?is)<head\b[^>]*>.*?</head>", " "))


def page_text(html, limit: int = 2_000_000) -> Column:
    return F.substring(strip_tags(page_body(html)), 1, limit)


def attr_value(attrs, name: str) -> Column:
    pattern = rf"(?i)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    return F.concat(*[F.regexp_extract(_c(attrs), pattern, i) for i in (1, 2, 3)])


def attrs_map(tag_body) -> Column:
    """Lower-case names to decoded values; of a repeated name the last."""
    pattern = r"(?i)([a-z_][\w:-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"
    names = F.transform(F.regexp_extract_all(_c(tag_body), F.lit(pattern), 1), F.lower)
    values = F.transform(F.regexp_extract_all(_c(tag_body), F.lit(pattern), 2), lambda v: F.regexp_replace(v, r"^[\"']|[\"']$", ""))
    # decoded in one call, so that no helper is needed inside a lambda
    decoded = F.split(decode_entities_once(F.array_join(values, "\u0000")), "\u0000", -1)
    pairs = F.arrays_zip(names.alias("k"), decoded.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]))
    return F.when(F.size(names) > 0, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def clean_css(css) -> Column:
    y = replace(css, r"(?i)@import\s+(?:url\()?\s*(?:\"[^\"]*\"|'[^']*'|[^;)\s]+)\s*\)?\s*;?", "")
    return replace(y, r"(?i)(?:expression\s*\([^)]*\)|-moz-binding\s*:[^;}]+|behavior\s*:[^;}]+)", "")


def plain_text_html(text) -> Column:
    y = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        y = F.replace(y, F.lit(a), F.lit(b))
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"></head><body><pre>'), y, F.lit("</pre></body></html>"))


# --- search keys and ids ------------------------------------------------------------

_DROPPED = r"[\t-\r    -     　﻿·•・—–_\-/\\:：,，.。;；!！?？'\"“”‘’()（）\[\]【】<>《》]+"


def normalize_search(x) -> Column:
    return replace(F.lower(nfkc(_c(x))), _DROPPED, "")


def normalized(q: str) -> str:
    """normalize_search of a query that the driver has."""
    return re.sub(_DROPPED, "", unicodedata.normalize("NFKC", q).lower())


def pinyin_initials(x, table: dict = tables.PINYIN) -> Column:
    """Letters and digits in lower case, Han characters as the initial of their pinyin; others dropped."""
    bounds = [F.collate(F.lit(b), "zh") for b in table]
    letters = list(table.values())

    def one(ch):
        # the last boundary that is not beyond the character
        initial = F.lit("")
        for b, letter in zip(bounds, letters, strict=True):
            initial = F.when(F.collate(ch, "zh") >= b, F.lit(letter)).otherwise(initial)
        return F.when(ch.rlike("^[A-Za-z0-9]$"), F.lower(ch)).when(ch.rlike(f"^{HAN}$"), initial).otherwise(F.lit(""))

    return F.array_join(F.transform(F.split(_c(x), ""), one), "")


def english_words(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit("[A-Za-z][A-Za-z'’ -]{1,80}"), 0)


def alias_keys(x, table: dict = tables.ALIASES) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(_c(x).rlike(p), F.array(*map(F.lit, keys))).otherwise(none) for p, keys in table.items()])


def make_search_keys(label) -> Column:
    raw = trim(_c(label))
    normal, initials = normalize_search(raw), pinyin_initials(raw)
    words = F.split(normalize_search_list(english_words(raw)), "\u0001", -1)
    return F.array_distinct(F.filter(F.concat(F.array(normal, initials), words, alias_keys(raw)), lambda k: k != ""))


def normalize_search_list(words) -> Column:
    """The words normalized, in one string with a separator that no word has."""
    return replace(F.lower(nfkc(F.array_join(words, "\u0001"))), _DROPPED, "")


def fnv1a_base36(x) -> Column:
    """32-bit FNV-1a over UTF-16 units, in base 36."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(_c(x), "UTF-16BE")), F.lit("(.{4})"), 1), lambda u: F.conv(u, 16, 10).cast("bigint"))
    total = F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(4294967295))
    return F.lower(F.conv(total.cast("string"), 10, 36))


def book_id_for_file(name, size, modified) -> Column:
    return F.concat(F.lit("b-"), fnv1a_base36(F.concat_ws("|", _c(name), _c(size).cast("string"), _c(modified).cast("string"))))


# --- paths and references -----------------------------------------------------------


def fragment_of(url) -> Column:
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), "(?s)#(.*)$", 1)


def normalize_path(base, given) -> Column:
    """The path that a reference means, seen from base; null where it means none."""
    folder = replace(_first(_c(base), F.lit("/")), "[^/]*$", "")
    inner = r"(?i)^(?:ms-its:|mk:@msitstore:|its:)?[^:]*?\.chm::(.*)$"
    none = F.array().cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        return F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    def whole(v: Column) -> Column:
        bad = (v == "") | v.rlike("(?i)^(?:https?:|mailto:|tel:|ftp:|javascript:|data:|about:|file:|blob:)")
        return F.when(~bad, F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.when(v.startswith("/"), v).otherwise(F.concat(folder, v)), "/"), none, step), "/")))

    def decoded(v: Column) -> Column:
        plain = F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))
        return let(plain, lambda y: F.when(y.isNull() | (y.contains("\ufffd") & ~v.contains("\ufffd")), v).otherwise(y))

    def shortened(v: Column) -> Column:
        v = F.when(v.rlike(inner), F.regexp_extract(v, inner, 1)).otherwise(v)
        return replace(replace(v, "(?s)#.*$", ""), r"(?s)\?.*$", "")

    def checked(v: Column) -> Column:
        return F.when(~((v == "") | v.rlike(r"[\x00-\x1f\x7f]")), let(let(shortened(v), decoded), whole))

    return let(F.replace(trim(_c(given)), F.lit("\\"), F.lit("/")), checked)


def ref_info(base, raw) -> Column:
    """STRUCT<kind, path, fragment, url> of a reference."""

    def told(v: Column, path: Column) -> Column:
        return (
            F.when(v == "", "blocked")
            .when(v.startswith("#"), "fragment")
            .when(v.rlike("(?i)^data:image/(?:avif|bmp|gif|jpeg|jpg|png|webp);"), "data")
            .when(v.rlike("(?i)^(?:https?:|mailto:|tel:|ftp:)"), "external")
            .when(is_external(v) | v.rlike("(?i)^(?:vbscript:|resource:|shell:)") | path.isNull(), "blocked")
            .otherwise("internal")
        )

    def packed(v: Column) -> Column:
        both = let(normalize_path(base, v), lambda path: F.struct(told(v, path).alias("kind"), path.alias("path")))
        return let(both, lambda b: F.struct(b["kind"].alias("kind"), F.when(b["kind"] == "internal", b["path"]).alias("path"), F.when(b["kind"].isin("fragment", "internal"), fragment_of(v)).alias("fragment"), F.when(b["kind"].isin("data", "external"), v).alias("url")))

    return let(trim(F.coalesce(_c(raw), F.lit(""))), packed)


# --- labels and display -------------------------------------------------------------


def clean_text(x) -> Column:
    y = F.replace(_c(x), F.lit(" "), F.lit(" "))
    return trim(replace(replace(replace(y, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def compact_compare(x) -> Column:
    return replace(F.lower(nfkc(_c(x))), r"[^a-z0-9㐀-鿿]+", "")


def text_weight(x) -> Column:
    y = clean_text(x)
    count = lambda keep: F.length(replace(y, f"[^{keep}]", ""))
    spaces = F.length(y) - F.length(replace(y, WS, ""))
    han, strong = count(r"㐀-鿿豈-﫿"), count("A-Z0-9")
    return spaces * F.lit(0.28) + han * F.lit(1.0) + strong * F.lit(0.62) + (F.length(y) - spaces - han - strong) * F.lit(0.5)


def format_bytes(n) -> Column:
    n = _c(n).cast("double")
    out = F.lit("0 B")
    for i, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB")):
        v = n / 1024**i
        whole = F.format_string(f"%.0f {unit}", v)
        text = whole if i == 0 else F.when(v >= 100, whole).when(v >= 10, F.format_string(f"%.1f {unit}", v)).otherwise(F.format_string(f"%.2f {unit}", v))
        out = F.when(n >= (1 if i == 0 else 1024**i), text).otherwise(out)
    return F.when(n.isNull() | F.isnan(n) | (n == float("inf")), "0 B").otherwise(out)


def rule_card(title, text, book) -> Column:
    """A quotation of a page; null where there is no text."""
    body = F.substring(clean_text(text), 1, 12_000)
    return F.when(body != "", F.concat(F.lit("【"), _c(title), F.lit("】\n\n"), body, F.lit("\n\n—— "), _c(book)))


def percent(done, total) -> Column:
    return F.when(_c(total) > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(_c(done) / _c(total) * 100 + 0.5).cast("int")))).otherwise(F.lit(0))


def index_label(state, done, total) -> Column:
    return (
        F.when(_c(state) == "ready", "索引已就绪")
        .when(_c(state) == "error", "索引构建失败")
        .when(_c(state) == "building", F.concat(F.lit("正在构建索引 "), percent(done, total).cast("string"), F.lit("%")))
        .otherwise("目录索引立即可用 · 正文索引待构建")
    )


def format_ts(ms) -> Column:
    return F.coalesce(F.when(_c(ms) != 0, F.date_format(F.timestamp_millis(_c(ms)), "M/d HH:mm")), F.lit("最近"))


def book_title(system_title, file_name, custom=None) -> Column:
    own = trim(F.coalesce(_c(system_title), F.lit("")))
    return _first(*([] if custom is None else [_c(custom)]), own, replace(file_name, r"\.[^.]+$", ""))


def rename(title) -> Column:
    """A new title as it is stored; null where it is refused."""
    y = F.substring(trim(replace(replace(title, r"[\r\n\t]", " "), f"{WS}{{2,}}", " ")), 1, 120)
    return F.nullif(y, F.lit(""))
