"""The text operators against brute force, exact round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import common, htmltext, langid, nbsvm, ogg, simhash, toxicity, wumanber

SMALL = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over a lazy dog and runs away from it " * 4000
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b c d e"), (5, "A  b\tC d e"), (None, "null id here"), (6, LONG), (7, "İstanbul \U0001f600 naïve.")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in ODD], "doc_id long, text string, fp string, n_words int, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def brute_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, distance=4):
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(pairs))]


def test_simhash_brute_force(spark, docs, odd):
    for table in (docs, odd):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        fps = [(d, brute_fingerprint(t)) for d, t in rows]
        want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps))), key=str)
        assert sorted(map(tuple, simhash.simhash_groups(table).collect()), key=str) == want


def test_simhash_full_buckets(spark):
    """Overfull buckets are split until every close pair is compared."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(300):
        x = base
        for _ in range(rng.randrange(1, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=8).collect()
    root = {r.node: r.root for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    comp = brute_components(list(enumerate(fps)))
    got = {}
    for i, x in enumerate(signed):
        got.setdefault(root.get(x, x), set()).add(i)
    want = {}
    for i, c in enumerate(comp):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ogg_round_trip(odd):
    rows = {(r.doc_id, r.n_bytes): r for r in ogg.round_trip(odd).collect()}
    for d, t in ODD:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[(d, len(raw))]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(ogg.encode(padded)).hexdigest()


def test_ogg_checksum_known_value_and_damage():
    # CRC-32 with polynomial 0x04C11DB7, zero start, not reflected, bit by bit
    def slow(data):
        crc = 0
        for x in data:
            crc ^= x << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 1 << 31 else 0)) & 0xFFFFFFFF
        return crc

    assert all(ogg.checksum(x) == slow(x) for x in (b"", b"a", bytes(range(256)), b"OggS" * 9))
    for n in (64, 255 * 64, 4096 * 15, 65536, 65536 + 64, 200_000 // 64 * 64):
        payload = random.Random(n).randbytes(n)
        media = ogg.encode(payload)
        assert ogg.decode(media)[0] == payload
        s = ogg.demultiplex(media)
        assert s[ogg.DATA].granules[-1] == n and s[ogg.DATA].ended and s[ogg.MARKS].ended
        for at in (5, len(media) // 2, len(media) - 1):
            with pytest.raises(ValueError):
                ogg.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ValueError):
            ogg.decode(media[: len(media) // 2])


def test_wumanber_brute_force(spark, docs, odd):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(900, "One"), (901, None), (902, ""), (903, "dog and runs"), (904, "b c d e"), (904, "b c d e"), (905, LONG[:300])], "item_id long, text string")
    bench = bench.union(more)
    items = [(str(r.item_id), [x.decode() for x in wumanber.words(r.text)]) for r in bench.collect()]
    pats = {}
    for i, w in items:
        for k in range(max(1, len(w) - 9) if w else 0):
            pats.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for table in (docs.limit(60), odd.where("doc_id <> 6 or doc_id is null")):
        want = []
        for r in table.collect():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            hit, ids = set(), set()
            for p, who in pats.items():
                for s in range(len(w) - len(p) + 1):
                    if tuple(w[s : s + len(p)]) == p:
                        hit.update(range(s, s + len(p)))
                        ids |= who
            want.append((r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
        assert sorted(map(tuple, wumanber.contamination(table, bench).collect()), key=str) == sorted(want, key=str)
    assert wumanber.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_wumanber_parts(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, wumanber.contamination(docs, bench).collect()))
    monkeypatch.setattr(wumanber, "PART_WINDOWS", 300)
    assert sorted(map(tuple, wumanber.contamination(docs, bench).collect())) == whole


def test_trained_models_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    language = langid.identify(docs, langid.fit(docs, 200)).join(docs, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2")
    assert language.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    toxic = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0")
    assert toxic.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.96
    quality = nbsvm.score(docs, nbsvm.fit(docs, labels, 1000)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0")
    assert quality.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.94


def test_models_on_odd_rows(spark, odd):
    rows = [("you utter moron. fine", 1), ("a fine day. really", 0)] * 12
    model = toxicity.train(rows)
    got = {(r.doc_id, r.score): r for r in toxicity.score(odd, model).collect()}
    assert len(got) == len(set(ODD)) and all(0 <= r.score <= 1 for r in got.values())
    text = "Fine. You, MORON! Ok"
    spans = model.sentences(text)
    assert [text[a:b].strip() for a, b, p in spans if p >= 0.5] == ["You, MORON"]
    assert toxicity.keep(odd, model).count() == len(ODD) and toxicity.keep(odd, model).columns == odd.columns
    quality = nbsvm.train(rows)
    assert nbsvm.score(odd, quality).count() == len(ODD)
    language = langid.train([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 10)
    got = langid.identify(odd, language).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"}
    empty = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert nbsvm.score(odd, nbsvm.fit(odd, labels)).count() == len(ODD)
    assert langid.identify(odd, langid.fit(odd.withColumn("lang", F.lit(None).cast("string")))).where("lang_pred <> 'und'").count() == 0


def test_html(spark):
    page = (
        "<html><body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><div id=wrap><div class='post post-12'>"
        "<h2>T &amp; x</h2><p>One <b>bo</b>ld.<p>Two  lines\n here &lt;ok&gt;<ul><li>a<li>b</ul><div class=comments><p>nice</p></div></div>"
        "<div class=sidebar><p>zz</p></div></div><form>f<input></form><script>if (a < b) {'</p>'}</script></body></html>"
    )
    assert htmltext.extract(page, None) == "T & x One bold. Two lines here <ok> a b"
    assert htmltext.extract("just < text", None) == "just < text" and htmltext.extract(None, None) == ""
    other = page.replace("post-12", "post-7").replace("<p>One", "<p>Uno")
    rows = [(1, "http://a.example/x", page), (2, "https://www.A.example/y", other), (3, None, None), (3, None, None), (4, "bad url", ""), (5, "http://a.example/z", "<p>" + LONG)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in htmltext.main_text(table).collect()}
    assert got[2].text == "T & x Uno bold. Two lines here <ok> a b" and got[3].text == "" and got[5].text == " ".join(LONG.split()) and got[5].n_chars == len(got[5].text)
    assert htmltext.main_text(table).count() == 6 and htmltext.main_text(table.limit(0)).count() == 0
    top = {r.host: r.path for r in htmltext.votes(table).collect()}
    assert top["a.example"] == "html>body>div>div.post.post-#"


@pytest.mark.parametrize("tag", ["section id='related-work'", "div class='social-history'", "p class='share-price'", "h2 id='foot-care'", "p id='login-flow'", "div class='search-results'", "noscript"])
def test_html_keeps_article_text_under_marked_names(tag):
    page = f"<body><nav>menu</nav><article><p>Before it, some words.</p><{tag}>The text itself.</{tag.split()[0]}><p>After it, more words.</p></article><footer>f</footer></body>"
    assert htmltext.extract(page, None) == "Before it, some words. The text itself. After it, more words."


@pytest.mark.parametrize("tag", ["div class='comments'", "section id='comment-list'", "div class='related-posts'", "div class='share-buttons'", "ul id='social_links-2'", "div class='ad-slot wide'", "div class='newsletter-box'", "div role='search'"])
def test_html_drops_named_parts_within_articles(tag):
    page = f"<body><article><p>Before it, some words.</p><{tag}>Something else.</{tag.split()[0]}><p>After it, more words.</p></article><noscript>Turn scripts on.</noscript></body>"
    assert htmltext.extract(page, None) == "Before it, some words. After it, more words."


def test_html_drops_marked_parts_that_are_mostly_links():
    page = "<body><article><p>Some words of the article.</p><div class='related-work'><a href=x>Another title</a> <a href=y>And one more</a></div></article></body>"
    assert htmltext.extract(page, None) == "Some words of the article."
