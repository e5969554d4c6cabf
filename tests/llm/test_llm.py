"""Each operator against a plain form of the same contract, on awkward rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioworks.llm import ann, bpe, decontaminate, html_extract, kneser_ney, near_dedup, substring_dedup, token_counts, toxicity, warc

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n  a", "aaaaaaaaaaaaaaaaa", " \x1c\x85 x  y", "é" * 40, "don't'll 123 ｘ你好 ", "x<|endoftext|>y", "\t\v a\r\n", "!?!?" * 9, "word " * 400, "b" * 5000]


def words(n, rng, kinds=200):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def docs(spark, texts):
    """With an extra column whose name clashes with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, _text string").repartition(3)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_matches_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs(spark, ODD)
    got = {r.doc_id: r for r in bpe.encode_documents(df, MULTI, P.PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(df, MULTI, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        want = lib.encode_ordinary(t or "")
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == sha(np.array(want, "<u4").tobytes()) and got[i].decoded_sha256 == sha((t or "").encode())
    assert all(bytes(r.bytes) == (ODD[r.doc_id] or "").encode() for r in bpe.decode(bpe.encode(df, MULTI, P.PATTERN), MULTI, P.PATTERN).collect())


def test_bpe_one_merge_at_a_time_agrees():
    v = bpe.vocabulary(MULTI, P.PATTERN)
    rng = random.Random(0)
    pieces = [bytes(rng.choices(b"abe tr\xc3\xa9", k=rng.randrange(1, 30))) for _ in range(500)]
    ids, n = v.replay(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [v.encode_one(p) for p in pieces]


def test_token_counts_match_library(spark):
    lib = Tokenizer.from_file(PLAIN)
    texts = [*ODD, "a long text, " * 50_000]
    for limit in (100, 7):
        rows = token_counts.token_counts(docs(spark, texts), PLAIN, P.PATTERN, limit=limit).collect()
        fits = {r.doc_id: r.fit_bytes for r in token_counts.fit_budget(token_counts.prefix_index(docs(spark, texts), PLAIN, P.PATTERN), limit).collect()}
        assert len(rows) == len(texts)
        for r in rows:
            t = texts[r.doc_id] or ""
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > limit) and r.fit_bytes == fits[r.doc_id]
            assert len(lib.encode(t.encode()[: r.fit_bytes].decode(), add_special_tokens=False).ids) <= limit or not t.strip()
    assert token_counts.token_counts(docs(spark, ODD).filter("false"), PLAIN, P.PATTERN).count() == 0


def test_prefix_counts(spark):
    lib = Tokenizer.from_file(PLAIN)
    word = "internationalizations"
    counts = token_counts.counter(PLAIN, P.PATTERN).prefix_counts(word.encode())
    assert counts == [len(lib.encode(word[:k], add_special_tokens=False).ids) for k in range(1, len(word) + 1)]
    text = "Prefix counts, don't re-encode: 1234 x"
    index = token_counts.prefix_index(docs(spark, [text]), PLAIN, P.PATTERN).first()
    pieces, at = re.findall(r"'t| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+", text), 0
    for piece in pieces:  # the count at every prefix: that of the pieces before and of the piece's own beginning
        before = index.counts[at - 1] if at else 0
        assert index.counts[at : at + len(piece)] == [before + len(lib.encode(piece[: k + 1], add_special_tokens=False).ids) for k in range(len(piece))]
        at += len(piece)
    assert index.piece_ends == list(np.cumsum([len(x) for x in pieces]))
    index = token_counts.prefix_index(docs(spark, ["one two three four", ""]), PLAIN, P.PATTERN)
    assert {r.doc_id: r.fit_bytes for r in token_counts.fit_budget(index, 2).collect()} == {0: 7, 1: 0}


def hits_of(text, items):
    w = lambda t: [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    d, hit, found = w(text), set(), set()
    for i, t in items:
        own = w(t)
        m = min(10, len(own))
        for k in range(len(own) - m + 1 if own else 0):
            for s in range(len(d) - m + 1):
                if d[s : s + m] == own[k : k + m]:
                    hit.update(range(s, s + m))
                    found.add(str(i))
    return len(d), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_decontamination(spark, block):
    rng = random.Random(1)
    items = [(i, " ".join(words(rng.choice([1, 3, 10, 14, 25]), rng, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "Äö é-x"), (53, items_text := "same words " * 6), (54, items_text)]
    texts = [" ".join(words(300, rng, 60)) for _ in range(15)] + [f"x, {items[k][1]}! {items[k][1].upper()}" for k in (0, 3, 7)] + ["äÖ É x", "Äö é x", items_text * 3] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs(spark, texts), bench, block_bytes=block).collect()}
    assert got == {i: hits_of(t, items) for i, t in enumerate(texts)}
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, texts), bench, block_bytes=block).collect()}
    assert kept == {i for i, g in got.items() if not g[4]}
    assert decontaminate.contamination(docs(spark, ODD), bench.filter("false")).filter("contaminated").count() == 0


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(2)
    texts = list(ODD)
    for n in (8, 40, 120):
        base = words(n, rng)
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + n // 12)):
                own[rng.randrange(n)] = rng.choice(["the", "of", "zz"])
            if rng.random() < 0.3:
                own = own[: rng.randrange(n // 2, n)]
            texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(root))
    kept = {r.doc_id for r in near_dedup.one_of_each(docs(spark, texts)).collect()}
    assert kept == set(root)


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    a, b = pool[:200], pool[50:250]
    sig = near_dedup.dart_signatures(np.concatenate([a, b]), np.ones(400, np.int64), np.array([200, 200]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 150 / 250) < 0.05
    heavy = near_dedup.dart_signatures(np.concatenate([pool[:50], pool[:50]]), np.concatenate([np.full(50, 4), np.full(50, 2)]), np.array([50, 50]), 2000)
    assert abs((heavy[0] == heavy[1]).mean() - 0.5) < 0.05
    w = rng.uniform(0.2, 5000, (2, 200))
    real = near_dedup.dart_signatures(np.concatenate([pool[:200], pool[:200]]), np.concatenate(w), np.array([200, 200]), 2000)
    assert abs((real[0] == real[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum()) < 0.05
    assert (near_dedup.dart_signatures(pool[:1], np.ones(1, np.int64), np.array([0, 1]), 64)[1] != 0).all()


def repeats_of(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        cut = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                cut[k : k + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(w), sum(cut), b" ".join(x for x, c in zip(w, cut, strict=True) if not c))
    return out


def test_substring_dedup(spark):
    rng = random.Random(4)
    passages = [words(n, rng) for n in (20, 21, 30, 90)]
    texts = list(ODD) + ["a b " * 60, "a b a " * 40, "x " * 19, "x " * 20, "x " * 45]
    for _ in range(30):
        own = words(rng.randrange(1, 150), rng)
        for p in rng.sample(passages, 2):
            at = rng.randrange(len(own) + 1)
            own[at:at] = p[rng.randrange(3) :]
        texts.append(" ".join(own))
    texts += texts[-5:]
    want = repeats_of(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_digest(docs(spark, texts)).collect()}
    assert got == {i: (n, k, sha(t)) for i, (n, k, t) in want.items()}
    new = {r.doc_id: r.text for r in substring_dedup.dedup_texts(docs(spark, texts)).collect()}
    assert all(new[i] == (want[i][2].decode() if want[i][1] else t) for i, t in enumerate(texts))


def test_toxicity(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(" ".join(words(30, rng) + ["moron", "you"] * bad))
        toxic.append((i, int(bad)))
    labels = spark.createDataFrame([*toxic, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, texts + ODD), labels).collect()
    assert len(got) == 400 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id < 400 and r.held_out)
    assert not any(r.predicted for r in got if r.doc_id >= 400)
    assert {r.score for r in toxicity.toxicity(docs(spark, ODD), labels.filter("false")).collect()} == {1 / (1 + np.exp(40))}


def fitted(rows, y, **how):
    """A score function of slots, and one that says the same by a loop over all pairs."""
    m = toxicity.fit([np.array(x) for x in rows], np.array(y, float), **how)

    def plain(*k):
        at = [i for s in k for i in np.flatnonzero(m.slots == s)]
        raw = m.bias + sum(float(m.w[i]) for i in at) + sum(float(m.v[a].astype(float) @ m.v[b]) for x, a in enumerate(at) for b in at[x + 1 :])
        return 1 / (1 + np.exp(-raw))

    score = lambda *k: m.score(1, np.zeros(len(k), np.int64), np.array(k, np.int64))[0]
    return score, plain


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(6)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append([k for k, on in ((1, a), (2, b)) if on])
        y.append(a and b)
    score, plain = fitted(rows, y, epochs=40)
    assert score(1, 2) > 0.9 > 0.3 > max(score(1), score(2))
    assert all(abs(score(*k) - plain(*k)) < 1e-6 for k in ((), (1,), (1, 2), (1, 2, 99)))


def test_machine_learns_pairs_without_marginals():
    """Toxic if both of two terms occur or neither: no term alone says anything."""
    rng = np.random.default_rng(7)
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append([k for k, on in ((1, a), (2, b)) if on] + sorted({10 + int(rng.integers(30)) for _ in range(4)}))
        y.append(a == b)
    score, plain = fitted(rows, y, epochs=60)
    assert min(score(1, 2), score()) > 0.7 and max(score(1), score(2)) < 0.3
    assert abs(score(1, 2, 12, 15) - plain(1, 2, 12, 15)) < 1e-5


def test_machine_keeps_factors_of_frequent_terms():
    """Term 2 is as common in both classes, and matters only beside term 1."""
    rng = np.random.default_rng(7)
    rows, y = [], []
    for i in range(3000):
        kind = i % 6  # toxic: 1 with 2, or 3; clean: 1 alone, 2 alone
        rows.append([[1, 2], [3], [1], [2], [2], [1, 2]][kind] + [10 + int(rng.integers(5))])
        y.append(kind in (0, 1, 5))
    score, _ = fitted(rows, y, epochs=40)
    assert score(1, 2) > 0.8 and score(1) < 0.5 and score(2) < 0.5


def test_toxicity_takes_the_same_rows_of_repeated_ids(spark):
    """Labels without a document use up no sample; an id with several texts gives each of them."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(-300, 60)], "doc_id long, toxic int")
    df = docs(spark, [f"t {i}" for i in range(60)])
    both = df.unionByName(df.withColumn("text", F.lit("another")))
    picked, total = toxicity.sampled_rows(both.unionByName(df), labels, "doc_id", "text", "toxic", 10)
    again, _ = toxicity.sampled_rows(both.repartition(7), labels, "doc_id", "text", "toxic", 10)
    assert picked.count() == 20 and {tuple(r) for r in picked.collect()} == {tuple(r) for r in again.collect()}
    assert sum(total.values()) == 2 * df.filter(~toxicity.held_out("doc_id")).count()
    scored = toxicity.score(df.withColumn("score", F.lit("x")), toxicity.fit([], np.zeros(0)))
    assert dict(scored.dtypes)["score"] == "double" and scored.count() == 60


def test_toxicity_does_not_hang_on_the_sample(spark):
    rng = random.Random(9)
    texts, toxic = [], []
    for i in range(2000):
        bad = i % 10 == 0
        unclear = rng.random() < 0.5
        texts.append(f"only{i} " + "grey" * (bad or unclear))
        toxic.append((i, int(bad)))
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    few, all_ = ({r.doc_id: r.score for r in toxicity.toxicity(docs(spark, texts), labels, sample=k).collect()} for k in (150, 4000))
    mean = lambda x: sum(x.values()) / len(x)
    assert abs(mean(few) - 0.1) < 0.04 and abs(mean(all_) - 0.1) < 0.04


def plain_kneser_ney(train, order):
    """p(byte after context) by the definition: dictionaries, one order after the other, recursion."""
    grams = [bytes(order - 1 - min(k, order - 1)) + t[max(0, k - order + 1) : k + 1] for t in train for k in range(len(t))]
    counts = {order: Counter(grams)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, table in counts.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        cuts[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) if n[i] and n[i + 1] else i / 2 for i in (1, 2, 3)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        own = [(g, n) for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        total, cut = sum(n for _, n in own), lambda n: cuts[k][min(n, 3) - 1]
        n = counts[k][gram]
        return (max(n - cut(n), 0) if n else 0) / total + sum(cut(x) for _, x in own) / total * p(gram[1:])

    return p


def test_quality(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat"], k=40)) for _ in range(120)]
    bad = ["".join(rng.choices("#$%&*xqz", k=150)) for _ in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    df = docs(spark, good + bad + ["", None, good[3]])
    df = df.withColumn("lang", F.when(F.col("doc_id") < 60, "en")).unionByName(df.filter("doc_id = 5"))
    both = [{(r.doc_id, r.lang): r for r in kneser_ney.quality(df, labels, broadcast_ngrams=limit).collect()} for limit in (4_000_000, 0)]
    assert both[0] == both[1]  # to the bit
    got = {k[0]: r for k, r in both[0].items()}
    assert len(got) == 133 and got[130].perplexity is None and not got[130].keep and not got[131].keep
    assert sum(got[i].keep for i in range(100, 120)) >= 18 and not any(got[i].keep for i in range(120, 130))
    train = [good[i].encode() for i in [*range(100), 5] if zlib.crc32(str(i).encode()) % 5]  # 5 is there twice
    p = plain_kneser_ney(train, kneser_ney.ORDER)
    for i in (0, 101, 121, 132):
        t = (good + bad + ["", None, good[3]])[i].encode()
        lp = [np.log(p((bytes(kneser_ney.ORDER) + t)[k + 1 : k + 1 + kneser_ney.ORDER])) for k in range(len(t))]
        assert abs(got[i].perplexity / np.exp(-np.mean(lp)) - 1) < 1e-6
    test = [got[i].perplexity for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert got[0].lang == "en" and got[0].threshold >= max(test) > got[0].threshold * np.exp(-2 * kneser_ney.STEP)
    assert kneser_ney.quality(df.filter("false"), labels).count() == 0
    free = kneser_ney.quality(df, labels.filter("false")).collect()
    assert all(r.keep == (r.perplexity is not None) for r in free)


def test_probabilities_sum_to_one(spark):
    rows = docs(spark, ["abracadabra", "abc abd"]).select(F.col("text").alias("_text"), F.lit(True).alias("_train"))
    levels = kneser_ney.model(kneser_ney.corpus_ngrams(rows, 3), 3)
    context = (ord("a") << 8) | ord("b")
    grams = spark.range(256).select((F.lit(context * 256) + F.col("id")).alias("ngram"))
    assert abs(kneser_ney.log_probabilities(grams, levels).agg(F.sum(F.exp("lp"))).first()[0] - 1) < 1e-9


def test_warc(spark, tmp_path):
    pages = [(i, f"http://h/{i}\n é", f"<p>{'x' * (i % 7) * 40}é</p>") for i in range(40)] + [(40, None, None), (41, "", ""), (None, "u", "<p>" + "y" * 200), (42, "u", "<p>" + "y" * 200), (43, "u", "<p>" + "y" * 200), (43, "u", "<p>" + "y" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in pages:
        own = first.get(h, i)
        again = i is not None and own != i
        want.append((i, len((h or "").encode()), sha((h or "").encode()), "revisit" if again else "response", own if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    archive = warc.write_archives(warc.mark_revisits(df), archive_bytes=2000).first()
    (tmp_path / archive.archive).write_bytes(archive.content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read_archives(files, "content", "path").filter("payload is not null").count() > 0
    with pytest.raises(ValueError, match="cut off"):
        list(warc.unpack(bytes(archive.content)[:-3]))
    record = next(iter(warc.unpack(bytes(archive.content))))
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record.replace(b"</p>", b"</q>") if b"</p>" in record else record[:-6] + b"z" + record[-5:])


def test_html(spark):
    body = lambda k: f"<h1>Title {k}</h1><p>One &amp;  two<b>three</b> {k}<p>Four<br>five<div class='share-buttons'>no</div>"
    page = lambda k: f"<html><head><title>t</title><style>p</style></head><body><header>no</header><nav>no</nav><div class=ad>no</div><div id=cookie-notice>no</div><form>no</form><aside>no</aside><article>{body(k)}</article><section class=comments><article>no</article></section><script>'</p>no'</script><footer>no</footer></body></html>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(5)] + [(5, None, None), (6, "x", ""), (7, "http://b.example/", "<body><div><div id=main><p>Long text of the page</p></div></div><div class=footer>no</div></body>"), (8, "http://a.example/z", "plain &lt;b&gt;")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        text = f"Title {i} One & twothree {i} Four five"
        assert got[i] == (text, len(text))
    assert got[5] == got[6] == ("", 0) and got[7][0] == "Long text of the page" and got[8][0] == "plain <b>"


def texts_of(spark, pages):
    rows = [(i, f"http://{host}/{i}", x) for i, (host, x) in enumerate(pages)]
    return [r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_html_template_and_names(spark):
    page = lambda k: f"<body class='has-sidebar'><div><ul><li>Home</li><li>News of news of</li></ul></div><p>We like cookies, cookies, ok {k % 2 and 'yes' or ''}</p><main class='with-sidebar'><h2 id='related-work'>Work {k}</h2><section id='social-history'>Past {k}</section><p id='search-results'>Found {k} <span class='hidden-gem'>gem</span></p><div>Tell your friends</div></main><div class='site-footer'>Year {k}</div></body>"
    got = texts_of(spark, [("t.example", page(k)) for k in range(12)] + [("one.example", page(3))])
    for k in range(12):
        assert got[k].endswith(f"Work {k} Past {k} Found {k} gem") and "Home" not in got[k] and "News" not in got[k], got[k]
        assert k % 2 or "cookies" not in got[k], got[k]
    assert got[12] == "Work 3 Past 3 Found 3 gem Tell your friends"
    assert texts_of(spark, [("o.example", f"<body><div class=hidden><h1>T {k}</h1><p>x {k}</p></div></body>") for k in range(4)]) == [f"T {k} x {k}" for k in range(4)]


def test_html_keeps_all_slots(spark):
    long = "words of a long story " * 40
    a = lambda k: f"<body><nav>no</nav><main><h1>Title {k}</h1><article id=post-{k}><p>{long}{k}</p></article></main><footer>no</footer></body>"
    b = lambda k: f"<body><div>menu here</div><div id=content><h1>Title {k}</h1><div class=lead>Lead {k}</div><div class=story>{(long if k else 'short ') + str(k)}</div></div></body>"
    got = texts_of(spark, [("a.example", a(k)) for k in range(4)] + [("b.example", b(k)) for k in range(4)] + [("one.example", a(9))])
    assert got[:4] == [f"Title {k} {long}{k}" for k in range(4)] and got[8] == f"Title 9 {long}9"
    assert got[4:8] == [f"Title {k} Lead {k} {(long if k else 'short ') + str(k)}" for k in range(4)]


def test_html_chrome_without_telling_names(spark):
    """Menu, notice and foot are plain divs and words; the stories share common words in other orders."""
    rng = random.Random(11)
    story = lambda: " ".join(rng.sample(["the", "of", "and", "in", "we", "for"], 6) + words(12, rng))
    stories = [[story() for _ in range(3)] for _ in range(9)]
    page = lambda k: f"<body><div><span>Start</span> <i>Shop</i> Help</div><div>Sale ends soon</div>{''.join(f'<div class=z>{x}</div>' for x in stories[k])}<div>the of</div>{'<div>Log out now</div>' if k < 6 else ''}<div>All rights kept</div></body>"
    got = texts_of(spark, [("plain.example", page(k)) for k in range(9)])
    assert got == [" ".join(stories[k]) for k in range(9)]


@pytest.mark.parametrize("name", ["post-content legal-guide", "story social-studies", "article-form", "entry search-result", "hidden-gems"])
def test_html_names_of_articles_are_kept(name):
    for template in (None, ""):
        assert html_extract.main_text(f"<body><div class='{name}'><h1>T</h1><p>Text of it</p></div></body>", template) == "T Text of it"


def test_html_reads_hostile_pages_in_proportion():
    n = 60_000
    pages = ["<script " * n, "<script " * n + ">", "<div>x" * n, "<div>" * n + "</span>" * n, "<a" * n, '<a "' * n + ">", "<!--" * n, "<ul><li>" * n, "<p>" + "<span class=a>" * n + "<hr>" * n, "<table><tr><td>" * n, "&" * n, "<" * n]
    began = time.time()
    for x in pages:
        html_extract.main_text(x, None)
    assert time.time() - began < 60
    assert html_extract.main_text("<div>x" * 1000, None) == " ".join("x" * 1000)


def test_html_repeats_and_empty_table(spark):
    page = "<body><p>Same words</p><div class=menu>no</div></body>"
    rows = [(1, "http://h.example/1", page, "x")] * 4 + [(None, None, page, None), (2, "http://h.example/2", None, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _text string").selectExpr("*", "'t' as template", "0 as n_chars", "'h' as _host", "'h' as host")
    got = sorted((r.page_id or 0, r.text) for r in html_extract.extract(df).collect())
    assert got == [(0, "Same words"), *[(1, "Same words")] * 4, (2, "")]
    assert html_extract.extract(df.filter("false")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 12)).astype(np.float32).astype(float)
    x[100:180] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(600, None), (700, [0.0] * 12), (800, [float("nan")] * 12), (None, [1.0] * 12), (900, [1.0, None])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=150).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(600), d)).tolist() if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-12 for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(want))
        if q in (0, 100):
            assert [i for _, i, _ in found] == want
    assert hit >= 0.9 * 60
    odd = [*rows, *rows[:300], (5, [9.0] * 12), (100, [float(v) for v in x[100]]), (100, [1e6] * 12)]
    again = ann.search(spark.createDataFrame([(*r, 0, 0, 0) for r in odd], "vec_id long, embedding array<double>, shard int, _id int, rank int"), shard_rows=150)
    smaller = [9.0] * 12 if [9.0] * 12 < rows[5][1] else rows[5][1]
    y = x.copy()
    y[5], y[100] = smaller, min([1e6] * 12, rows[100][1])
    for q in range(0, 600, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        own = [(r.rank, r.vec_id) for r in sorted(again.filter(f"query_id = {q}").collect(), key=lambda r: r.rank)]
        assert [a for a, _ in own] == list(range(1, 11)) and len({b for _, b in own}) == 10
        assert len({b for _, b in own} & set([i for i in np.lexsort((np.arange(600), d)).tolist() if i != q][:10])) >= 9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.search(few).count() == 2 and ann.search(few.filter("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    clean = [" ".join(words(60, rng, 3000)) for _ in range(40)]
    toxic = [" ".join([*words(30, rng, 3000), "moron", "scum"]) for _ in range(40)]
    copies = [clean[0], clean[1] + " tail"]
    item = " ".join(words(15, rng, 3000))
    leaks = [clean[2] + " more words here " + item]
    passage = " ".join(words(60, rng, 3000))
    shared = [" ".join(words(100, rng, 3000)) + " " + passage for _ in range(2)]
    df = docs(spark, clean + toxic + copies + leaks + shared + ["", None]).drop("_text")
    spark.createDataFrame([(i, int(40 <= i < 80)) for i in range(80)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == {*range(40), 83, 84, 85, 86}
    assert all(r.decoded_ok for r in rows.values())
    text = lambda i: bytes.fromhex(rows[i].decoded_sha256).hex()
    assert text(83) == sha(shared[0].encode()) and text(84) == sha(shared[1].removesuffix(" " + passage).encode())
    empty = corpus_pipeline.remove_repeats(spark, corpus_pipeline.remove_near_duplicates(spark, df.filter("false"), ""), "")
    assert empty.count() == 0 and empty.columns == df.columns
