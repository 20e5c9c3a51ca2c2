"""The training-data operators against plain computations on small tables, and their odd cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.llm import ann, decontam, html, katz, langid, pieces, sharding, simhash, tokens, warc
from boxloom.llm.common import components
from boxloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, fp string, key long, size long, lang_pred string"
BASE = "the quick brown fox jumps over the lazy dog and then runs far away from every other animal in the wood"


def docs_table(spark, rows):
    """Rows of (doc_id, text, lang) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, lang, None, "x", 1, None, "zz") for d, t, lang in rows], DOCS)


def corpus():
    rng = random.Random(5)
    vocabulary = {"en": "the of and to in is that house water green small".split(), "de": "der die und zu ist nicht haus wasser grün über straße".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 80))) + ".\nEnd", lang))
    rows += [(60, BASE, "en"), (61, BASE, None), (62, BASE.upper() + "  ", "en"), (63, None, "en"), (64, "", "de"), (65, " \n\t", None),
             (66, "12345 !!", "en"), (67, "word " * 30_000, "en"), (None, "no id at all", "en"), (68, "Zażółć <|endoftext|> é́ 日本語 🙂 İ. ▁x", None), (60, BASE, "en")]
    return rows


# 1

def brute_nearest(rows, q, k=5):
    usable = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    if q not in usable:
        return []
    a = usable[q]
    score = {i: float(a @ b / np.sqrt((a @ a) * (b @ b))) for i, b in usable.items() if i != q}
    return sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]


def test_permutation_index(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)] + [(360, None), (361, [0.0] * 8), (362, [float("nan")] * 8), (363, [1.0] * 7 + [None]), (364, [float("inf")] * 8), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("pivot", F.lit(3)).withColumn("id", F.lit("a"))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), piece=64, block=4, pivots=32, depth=32, rerank=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    hits = total = 0
    for q in range(0, 360, 20):
        mine = [v for _, v in sorted(got[q])]
        assert [r for r, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        want = brute_nearest(rows32, q)
        hits, total = hits + len(set(mine) & set(want)), total + 5
        if q in (300, 320):  # copies: ties go to the smaller id
            assert mine == [i for i in (7, 300, 301, 302, 303, 304) if i != q][:5]
    assert hits / total >= 0.9 and 360 not in got


def test_permutation_index_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id = 0"), posted=1, opened=1).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    mixed = spark.createDataFrame([(i, [1.0, float(i), 2.0][:2 + (i % 5 == 0)]) for i in range(21)], "vec_id long, embedding array<double>")
    found = ann.nearest(mixed, mixed.where("vec_id IN (1, 5)")).collect()  # rows of three numbers are fewer
    assert {r["query_id"] for r in found} == {1} and not any(r["vec_id"] % 5 == 0 for r in found) and len(found) == 5


# 2

def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [r for r in corpus() if r[0] is not None] + [(100 + i, t, None) for i, t in enumerate(["a  b", "   x", " " * 40 + "y", "\t\tif (x):\r\n  return 1, 2.5", "don't can't", "_" * 30])]
    got = {(r["doc_id"]): r for r in pieces.round_trip(docs_table(spark, rows), path).collect()}
    for d, t, _ in rows:
        ids = model.encode(t or "")
        assert got[d]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and got[d]["n_tokens"] == len(ids)
        assert got[d]["round_trip"] == ("▁" not in (t or ""))
    encoded = pieces.encode(docs_table(spark, rows[:5]), path)
    assert {r["doc_id"]: r["decoded"] for r in pieces.decode(encoded, path).collect()} == {d: t for d, t, _ in rows[:5]}
    assert pieces.round_trip(docs_table(spark, []), path).count() == 0


def test_unigram_paths_are_the_best():
    rng = random.Random(2)
    names = {"".join(p) for n in (1, 2, 3) for p in itertools.product("ab▁", repeat=n) if "▁" not in "".join(p).lstrip("▁")}
    scores = {p: -rng.random() * 5 for p in names if p}
    v = pieces.Vocabulary({p: i + 1 for i, p in enumerate(sorted(scores))}, scores, "unigram")

    def best(word):
        found = []
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            parts.append(word[start:])
            if all(len(p) == 1 or p in scores for p in parts):
                found.append(sum(scores.get(p, v.floor) for p in parts))
        return max(found)

    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    for word, parts in v.segment(words).items():
        assert "".join(parts) == word
        assert sum(scores.get(p, v.floor) for p in parts) == pytest.approx(best(word))


# 3

def page(n, body="", article=True, extra=""):
    inner = f"<h1>Title {n}</h1><p>First   para &amp; {n}<br>line{n}<p>Second <b>bo</b>ld{n} {body}"
    box = f"<article>{inner}{extra}</article>" if article else f"<div class='c1'><div class='c2'>{inner}{extra}</div></div>"
    return ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header>"
            f"<nav><ul><li><a href='/{n}'>m{n}</a></ul></nav><!-- x --><div class=\"ad\">Buy {n}</div><div class='cookie-notice'>Cookies</div>{box}"
            f"<aside>Side {n}</aside><section id='comments'><p>Nice {n}</section><form><input>Send</form><footer>&copy; Host</footer></body></html>")


def want(n, body=""):
    return " ".join(f"Title {n} First para & {n} line{n} Second bold{n} {body}".split())


def test_main_text(spark):
    rows = [(i, f"http://a.example/{i}", page(i, "word " * i, extra="<p>Sign up for our letter</p>")) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", page(i, "other words " * (i + 1), article=False, extra="<p>Read more on our site</p>")) for i in range(12)]
    rows += [(200, None, None), (201, "", ""), (202, "x", "plain <b>te</b>xt"), (203, "http://c.example/", "<p>open <div>a<p>b"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("token", F.lit(1))
    got = html.main_texts(df).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {i: texts[i] for i in range(12)} == {i: want(i, "word " * i) for i in range(12)}
    # no article: the gap of the root with most words, without what is the same on every page
    assert {i: texts[100 + i] for i in range(12)} == {i: want(i, "other words " * (i + 1)) for i in range(12)}
    assert (texts[200], texts[201], texts[202], texts[203]) == ("", "", "plain text", "open a b")
    assert html.main_texts(df.limit(0)).count() == 0


def test_template_outlives_odd_pages(spark):
    """Empty, cut and error pages leave the template of a host, and constant blocks go though a word of them is said twice."""
    notice = "<p>the shop and the site and the offer</p>"
    rows = [(i, f"http://d.example/{i}", f"<html><body><div class='top'>Host of the host</div><div class='c1'><p>text {i} and the more{i}</p>{notice}<p>the end {i}</p></div></body></html>") for i in range(30)]
    rows += [(100, "http://d.example/e", "<html><body><p>Error 404 of the page"), (101, "http://d.example/n", None), (102, "http://d.example/m", ""), (103, "http://d.example/c", "<html><body><div class='top'>Host of")]
    got = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(30)} == {i: f"text {i} and the more{i} the end {i}" for i in range(30)}
    assert (got[100], got[101], got[102]) == ("Error 404 of the page", "", "")


def text_of(spark, rows):
    return {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_names_are_one_mark_among_others():
    inside = "<article><h1>Head</h1><p>The text of the article</p>{}</article>"
    assert html.main_text(inside.format('<section id="related-work"><p>Earlier work</p></section>')) == "Head The text of the article Earlier work"
    assert html.main_text(inside.format('<section id="related-work"><a href="x">Other page</a></section>')) == "Head The text of the article"
    assert html.main_text(inside.format('<p class="social-history">Lives alone</p>')) == "Head The text of the article Lives alone"
    assert html.main_text(inside.format('<div class="adbox">Buy</div><div class="cmt-list"><p>Nice</p></div><div class="shareButtons">Share</div>')) == "Head The text of the article"
    for name in ("layout-sidebar-right", "sidebar-right", "has-comments"):
        assert html.main_text(f'<div class="{name}">{inside.format("")}</div>') == "Head The text of the article"
    assert html.main_text(inside.format("") + '<div class="sidebar"><article>Teaser of another</article></div>') == "Head The text of the article"


def test_longest_slot_goes_before_a_teaser():
    body = "<p>" + "long body text " * 20 + "</p><p>more of it</p>"
    assert html.main_text(f"<body><article><p>See also this</p></article><div class='b'>{body}</div></body>") == "long body text " * 20 + "more of it"
    assert html.main_text(f"<body><article>{body}</article><div class='b'><p>See also this</p></div></body>") == "long body text " * 20 + "more of it"


def test_nested_template(spark):
    """A notice with a tag of its own on some pages goes, text that copies share stays, a gap apart from short articles is taken."""
    def one(i, notice, copy):
        text = "<h1>Same news</h1><p>the same words in all of the copies</p>" if copy else f"<h1>News {i}</h1><p>words of page {i}</p>"
        return f"<body><article>{text}{'<div class=x7><p>Join our club now</p></div>' if notice else ''}<p>end {i}</p></article></body>"

    rows = [(i, f"http://e.example/{i}", one(i, i % 3 < 2, i % 2)) for i in range(60)]
    rows += [(100 + i, f"http://f.example/{i}", f"<body><div class='q'><article>Topic {i} of the day</article></div><div class='z'><p>{f'body{i} ' * 9}</p></div></body>") for i in range(10)]
    rows += [(200 + i, f"http://g.example/{i}", "<body><article><p>One text of all pages</p></article></body>") for i in range(10)]
    got = text_of(spark, rows)
    assert {i: got[i] for i in range(60)} == {i: f"Same news the same words in all of the copies end {i}" if i % 2 else f"News {i} words of page {i} end {i}" for i in range(60)}
    assert all(got[100 + i] == " ".join([f"body{i}"] * 9) for i in range(10))
    assert all(got[200 + i] == "One text of all pages" for i in range(10))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_texts(df, template_bytes=0).collect()} == got  # joined by host, not sent


def test_template_against_plain_classes(spark):
    """Classes by sums of hashes are those of the occurrence vectors themselves."""
    rng = random.Random(3)
    rows = []
    for h in range(6):
        shared = [f"<p>shared {h} {j}</p>" for j in range(4)]
        boxes = [(rng.choice([0.3, 0.6, 0.8]), f"<div class='k{j}'><p>box {j}</p><p>part {j}</p></div>") for j in range(4)]
        for i in range(rng.choice([5, 8, 13, 40])):
            inner = "".join(x for x in shared if rng.random() < 0.95) + "".join(x for p, x in boxes if rng.random() < p)
            rows.append((len(rows), f"http://h{h}.example/{i}", f"<html><body><div class='m'>{inner}<p>own {i} {rng.random()}</p></div>{'<p>again</p>' * rng.randint(0, 2)}</body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)).withColumn("__url", F.col("url"))
    got = {r["host"]: (set(r["root"]), set(r["nested"])) for r in html.templates(html.token_sums(df, "host", "html")).collect()}
    hosts = collections.defaultdict(list)
    for _, url, text in rows:
        tags, blocks = html.read(text)
        hosts[url.split("/")[2]].append(collections.Counter([("tag", t, "") for t in tags] + [("block", b.path, " ".join(b.words())) for b in blocks if b.words()]))
    expected = {}
    for host, pages in hosts.items():
        if len(pages) < html.LEAST_PAGES:
            continue
        vectors = {t: tuple(p[t] for p in pages) for t in set().union(*pages)}
        share = {t: sum(map(bool, v)) / len(pages) for t, v in vectors.items()}
        code = {t: html.block_code(t[1], t[2].split()) for t in vectors if t[0] == "block"}
        root = {c for t, c in code.items() if share[t] >= html.ROOT_SHARE}
        nested = {c for t, c in code.items() if html.SHARE <= share[t] < html.ROOT_SHARE and any(
            u[0] == "tag" and vectors[u] == vectors[t] and f"{t[1]}/".startswith(f"{u[1]}/") for u in vectors)}
        expected[host] = (root, nested)
    assert got == expected and any(n for _, n in expected.values())


def test_long_page(spark):
    words = "word " * 300_000
    got = text_of(spark, [(0, "http://l.example/", f"<article><p>{words}</p>{'<p>x</p>' * 20000}</article>")])
    assert got[0] == words + " ".join(["x"] * 20000)


# 4

def test_shards(spark):
    rows = corpus() + [(1000 + i, f"copy {i % 7}", "en") for i in range(200)]
    got = sharding.byte_shards(docs_table(spark, rows), 8).collect()
    assert len(got) == len(rows)
    slots, by_text, sizes = collections.defaultdict(list), {}, collections.Counter()
    crc = {(d, t) for d, t, _ in rows}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert by_text.setdefault(r["text_crc32"], r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in got} == {(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in crc}
    assert sharding.byte_shards(docs_table(spark, [])).count() == 0


def test_capacity_is_the_smallest(spark):
    rng = random.Random(3)
    for n, shards in ((1, 3), (40, 8), (300, 5)):
        groups = [(rng.getrandbits(64) - (1 << 63), rng.randint(1, 50)) for _ in range(n)]
        capacity, cuts = sharding.capacity_cuts(spark.createDataFrame(groups, "place long, size long"), shards)
        order = [s for _, s in sorted((p & (1 << 64) - 1, s) for p, s in groups)]

        def need(c):
            used, left = 1, c
            for s in order:
                if s > left:
                    used, left = used + 1, c
                left -= s
            return used

        assert capacity == next(c for c in range(max(order), sum(order) + 1) if need(c) <= shards)
        loads = collections.Counter(sum((p & (1 << 64) - 1) >= c for c in cuts) for p, s in groups for _ in range(s))
        assert max(loads.values()) == capacity or max(loads.values()) <= capacity


# 5

def test_warc(spark):
    big = "<p>" + "same payload " * 20
    rows = [(3, "u3", big), (1, "u1", big), (2, "u2", "short"), (4, "u4", "short"), (5, None, None), (6, "u\n6", ""), (9, "u9", "é" * 60), (8, "u8", "é" * 60), (1, "u1", big), (None, "un", "no id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_digest(df).collect()), key=str)
    exp = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(p for p, _, x in rows if x == h and p is not None) if len(data) >= 100 else i
        exp.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(exp, key=str)
    assert warc.archive_digest(df.limit(0)).count() == 0


def test_bundle_reads_single_records():
    bundle = warc.Bundle()
    data = {f"r{i}": bytes([i % 251]) * (i * 97 % 5000) for i in range(400)}
    for k, v in data.items():
        bundle.add(k, v)
    reader = warc.Seekable(bundle.finish())
    assert len(reader.places) > 2
    for m in random.Random(1).sample(bundle.map, 100):
        assert reader.read(m["frame"], m["offset"], m["length"]) == data[m["record_id"]]


# 6

@pytest.mark.parametrize("most", [1 << 18, 12])
def test_katz(spark, most):
    rows = [r for r in corpus() if r[0] is not None]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    df = docs_table(spark, rows)
    got = collections.defaultdict(list)
    for r in katz.katz_scores(df, katz.held_out(F.col("doc_id")), most=most).collect():
        got[r["doc_id"]].append(r)
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    unigrams = collections.Counter(w for d, t, _ in rows if not held(d) for w in tok(t))
    n, v = sum(unigrams.values()), len(unigrams)
    base = lambda w: (unigrams[w] + 0.5) / (n + 0.5 * (v + 1))
    by_count = collections.Counter(unigrams.values())
    kept, least = 0, max(by_count) + 1
    for c in sorted(by_count, reverse=True):
        kept += by_count[c]
        if kept > most:
            break
        least = c
    cls = lambda w: w if unigrams[w] >= least else None
    known = [w for w in unigrams if unigrams[w] >= least]
    rest = 1 - sum(base(w) for w in known)
    class_base = lambda c: rest if c is None else base(c)
    pairs = collections.defaultdict(collections.Counter)
    for d, t, _ in rows:
        if not held(d):
            for h, w in zip(["start", *map(cls, tok(t))], map(cls, tok(t))):
                pairs[h][w] += 1
    counts = [sum(c == r for x in pairs.values() for c in x.values()) for r in range(1, 7)]
    d = katz.discounts(counts)

    def p(h, w):
        x = pairs.get(h, {})
        total = sum(x.values())
        kept = sum(c * (d[c] if c <= 5 else 1) for c in x.values())
        total += total - kept < 1e-9 * total
        if x and 1 - sum(class_base(y) for y in x) < 1e-12:
            total = kept
        if x.get(w):
            return (d[x[w]] if x[w] <= 5 else 1) * x[w] / total
        alpha = (1 - kept / total) / (1 - sum(class_base(y) for y in x)) if x else 1
        return alpha * class_base(w)

    for h in [*list(pairs)[:8], "unseen"]:
        assert sum(p(h, w) for w in [*known, None]) == pytest.approx(1)
    for doc, t, _ in rows:
        w = tok(t)
        score = sum(math.log10(p(h, cls(x))) + (math.log10(base(x) / rest) if cls(x) is None else 0) for h, x in zip(["start", *map(cls, w)], w))
        for r in got[doc]:
            assert r["score"] == pytest.approx(score, rel=1e-6) and r["base_score"] == pytest.approx(sum(math.log10(base(x)) for x in w), rel=1e-6)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(unigrams[x] > 0 for x in w), n)
    assert sum(map(len, got.values())) == len(rows)


def test_katz_keeps_every_word(spark):
    """Words that do not fit the table of the executors count like all others, alone or next to each other."""
    rng = random.Random(8)
    rows = [(d, t, lang) for d, t, lang in corpus() if d is not None and d != 67]
    rows += [(500 + i, " ".join(f"r{int(rng.paretovariate(0.6)) % 60}" for _ in range(30)), "en") for i in range(40)]
    df = docs_table(spark, rows)
    held = katz.held_out(F.col("doc_id"))
    read = lambda **kw: sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in katz.katz_scores(df, held, **kw).collect())
    whole = read()
    for limits in ({"frequent": 0}, {"frequent": 4}, {"frequent": 20}, {"most": 1 << 18}):
        for a, b in zip(read(**limits), whole, strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_katz_without_training(spark):
    df = docs_table(spark, [(1, "a b", "en"), (None, None, None)])
    got = katz.katz_scores(df, F.lit(True)).collect()
    assert len(got) == 2 and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert katz.katz_scores(df.limit(0), F.lit(False)).count() == 0


# 7

def test_language(spark):
    rows = corpus()
    df = docs_table(spark, rows)
    got = langid.identify(df, langid.train(df)).collect()
    assert len(got) == len(rows)
    truth = dict((d, (t, lang)) for d, t, lang in rows)
    right = [r["lang_pred"] == truth[r["doc_id"]][1] for r in got if r["doc_id"] is not None and r["doc_id"] < 60]
    assert sum(right) >= 58
    for r in got:
        assert 0 <= r["score"] <= 1
        text = truth[r["doc_id"]][0]
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text))
    none = langid.identify(df, langid.train(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    kept = langid.identify(df, langid.train(df), keep=True, names=("a", "b"))
    assert kept.columns == [*df.columns, "a", "b"] and kept.where("lang_pred = 'zz'").count() == len(rows)


def test_kernel_weights_are_linear():
    """Scores by one product equal kernel, Nystroem features and regression taken one after the other."""
    sets = [langid.ngrams(t) for _, t, _ in corpus()[:40]]
    langs = [lang for _, _, lang in corpus()[:40]]
    model = langid.fit(sets, langs, landmarks=40, ridge=1e-2)
    kernel = np.array([[len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    target = np.array([[1.0 if x == n else -1.0 for n in model.langs] for x in langs])
    plain = kernel @ np.linalg.solve(kernel + 1e-2 * len(sets) * np.eye(len(sets)), target)  # all texts are landmarks
    assert np.abs(plain - model.scores(sets)).max() < 1e-2


# 8

def brute_components(rows):
    prints = [simhash.fingerprint(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(smallest.get(find(i), d), d)
    return collections.Counter((d, f"{prints[i]:016x}", smallest.get(find(i))) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [8192, 3])
def test_simhash(spark, block):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    long = [rng.choice(words) for _ in range(1500)]
    rows = corpus()
    for i in range(40):  # near copies that differ in a few words
        copy = list(long)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((200 + i, " ".join(copy), "en"))
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_table(spark, rows), block=block).collect())
    assert got == brute_components(rows)
    assert simhash.near_duplicates(docs_table(spark, [])).count() == 0


def test_fingerprint_by_bits():
    import xxhash

    text = "A b\x0bc d e é\n" * 3
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().replace(b"A", b"a"))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(len(words) - 3)]
    assert simhash.fingerprint(text) == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0 and simhash.fingerprint("x y") == simhash.fingerprint("X  Y")


def test_every_link_meets(spark):
    """Random pairs at 0 to 4 differing bits always share a key, in either kind of bucket."""
    rng = random.Random(6)
    pairs = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 4)):
            y ^= 1 << b
        pairs.append(tuple(sorted((x - (1 << 63), y - (1 << 63)))))
    df = spark.createDataFrame([(f,) for p in pairs for f in p], "fp long").distinct()
    got = {(r["u"], r["v"]) for r in simhash.fingerprint_links(df).collect()}
    assert set(pairs) <= got and all(((u ^ v) & (1 << 64) - 1).bit_count() <= 4 for u, v in got)


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(400 + i, 900) for i in range(300)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200, **{400 + i: 400 for i in range(300)}, 900: 400}


# 9

def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [r for r in corpus() if r[0] is not None and r[0] != 60] + [(70, "H̱e ΟΔΟΣ. x|y ^ don't", None)]
    df = docs_table(spark, rows)
    where = str(tmp_path / "tokens")
    tokens.write_tokens(df, where, path, 2, segment_ids=500, partitions=3)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_tokens(spark, where).collect()}
    start, exp = 0, {}
    for d, t, _ in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        exp[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == exp
    assert tokens.token_table(df.limit(0), path).count() == 0
    assert tokens.token_table(docs_table(spark, [(None, None, None), (1, "a", None), (1, "a", None)]), path).count() == 3


def test_codes_at_any_place():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), rng.integers(0, 49_000, 5000), rng.integers(0, 2 ** 32, 700), np.array([0, 255, 256, 65_535, 65_536, 2 ** 32 - 1])):
        sizes = np.array([len(ids) // 2, len(ids) - len(ids) // 2])
        segment = tokens.Segment(tokens.pack(np.asarray(ids), sizes))
        places = rng.permutation(len(ids))
        assert (segment.at(places) == np.asarray(ids)[places]).all() and (segment.all() == ids).all()
        assert (segment.document(1) == np.asarray(ids)[sizes[0]:]).all()


# 10

def brute_contamination(docs, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a:a + n])].add(str(i))
    out = []
    for d, t, _ in docs:
        w = split(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return collections.Counter(out)


@pytest.mark.parametrize("phrase_bytes", [1 << 24, 40])
def test_contamination(spark, phrase_bytes):
    items = [(1, BASE), (2, "Water, green."), (3, None), (4, ""), (5, "the of and"), (6, "word " * 20), (7, BASE + " tail words here"), (None, "house water"), (8, "water green")]
    rows = [r for r in corpus() if phrase_bytes > 100 or r[0] != 60] + [(300, f"start {BASE} middle {BASE} end " + "filler " * 50, "en"), (301, "x " + BASE[:-9], "en")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("i", F.lit(0))
    found = decontam.verdicts(decontam.contamination(docs_table(spark, rows), bench, phrase_bytes=phrase_bytes)).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found)
    assert got == brute_contamination(rows, [x for x in items if x[0] is not None])
    empty = decontam.contamination(docs_table(spark, rows), bench.limit(0))
    assert empty.where("size(spans) > 0").count() == 0 and empty.count() == len(rows)


@pytest.mark.parametrize("phrase_bytes", [1 << 24, 40])
def test_contamination_of_repeated_rows(spark, phrase_bytes):
    """Equal rows give one result row each, however many parts the benchmark has."""
    items = [(1, BASE), (2, "Water, green."), (7, BASE + " tail words here"), (8, "water green")]
    rows = [(60, BASE, "en")] * 3 + [(60, "other text", "en"), (None, "no words of it", "en"), (None, "no words of it", "en"), (None, BASE, "en")]
    found = decontam.verdicts(decontam.contamination(docs_table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), phrase_bytes=phrase_bytes)).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found)
    assert got == brute_contamination(rows, items)


def test_fm_index_against_a_scan():
    rng = np.random.default_rng(7)
    for size, n in ((3, 400), (40, 3000), (2, 1)):
        text = rng.integers(1, size, n)
        index = decontam.FMIndex(text, size, sample=5)
        phrases = np.concatenate([np.stack([text[i:i + 3] for i in rng.integers(0, n - 3, 20)]) if n > 3 else np.zeros((0, 3), int), rng.integers(1, size, (20, 3))])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(n - 2) if (text[i:i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_names_about_the_page_mark_no_part():
    page = '<html class="cookie"><body class="has-sidebar"><div class="page with-menu"><p>a  b</p></div><div class="sidebar">x</div></body></html>'
    assert html.main_text(page) == "a b"
