"""All ten queries: their columns and rows, empty tables, and results against plain Python written from their definitions."""

import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import htmltext, langid, learning, nbsvm, packing, queries, toxicity

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": {"doc_id", "fingerprint", "component_id"},
    "op2_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op3_ogg": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op5_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op6_debruijn": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_wumanber": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_nbsvm": {"doc_id", "held_out", "score", "predicted"},
    "op10_htmltext": {"page_id", "url", "text", "n_chars"},
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    """The tables without rows, and extra columns whose names clash with results'."""
    top = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "benchmark", "labels"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).withColumns({"score": F.lit(1), "h": F.lit("x"), "ids": F.lit(2)})
        table.write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, empty, name):
    out = queries.QUERIES[name](spark, SMALL)
    assert COLUMNS[name] <= set(out.columns)
    key = "page_id" if name == "op10_htmltext" else "doc_id"
    rows = out.collect()
    ids = [r[0] for r in spark.read.parquet(f"{SMALL}/{'pages' if key == 'page_id' else 'documents'}.parquet").select(key).collect()]
    assert ({r[key] for r in rows} == set(ids)) if name == "op4_packing" else (sorted(r[key] for r in rows) == sorted(ids))
    for r in rows if "held_out" in out.columns else ():
        folds, left = (4, 2) if name == "op2_langid" else (5, 0)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == left) and 0 <= r.score <= 1
    nothing = queries.QUERIES[name](spark, empty)
    assert COLUMNS[name] <= set(nothing.columns) and nothing.count() == 0


def test_sample_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, t) for t in "bca"] + [(2, "z"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, label int")
    assert learning.sample(docs, labels, 10) == [("a", 1), ("z", 0)]


def mixed(v, n, bits):
    """The hash of an n-gram's bytes, as a number."""
    return (((v + n * 40503) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) >> (32 - bits)


def test_language_by_hand(spark):
    """Averaged n-gram embeddings and the softmax, letter by letter."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs, 40)
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(-1, None), (-2, ""), (-3, "½ ² 12"), (-4, "Ⅷ 8"), (-5, "é")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, text in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        letters = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode())
        flat = b" " + b" ".join(letters.split()) + b" "
        total, n = np.zeros(len(model.languages)), 0
        for size in (2, 3, 4):
            for i in range(len(flat) - size + 1):
                g = flat[i : i + size]
                if size == 2 or 32 not in g[1:-1]:
                    total, n = total + model.table[mixed(int.from_bytes(g, "big"), size, langid.BITS)], n + 1
        z = (total / n + model.offsets) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert model.languages[int(p.argmax())] == got[d].lang_pred and abs(p.max() - got[d].score) < 1e-5


def test_toxicity_by_hand(spark):
    """Noisy-or over sentences, word by word."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, 200)
    rows = docs.limit(300).collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs.limit(300), model).collect()}
    sure = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    assert model.weights
    for r in rows:
        clear = 1 - sure(model.offset)
        for sentence in re.split(r"[.!?\n]", (r.text or "").lower()):
            found = set()
            for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence):
                found |= {x for x in ["=" + w, *(w[:k] for k in toxicity.PREFIXES if len(w) > k)] if x in model.weights}
            if found:
                clear *= 1 - sure(model.offset + sum(model.weights[x] for x in found))
        assert abs(got[r.doc_id] - (1 - clear)) < 1e-9


def test_quality_by_hand(spark):
    """The margin over distinct n-grams, one by one; and the fit's log-count ratios, which a tiny model shows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = nbsvm.fit(docs, labels, 60)
    rows = docs.where("length(text) < 3000 or text is null").limit(25).collect()
    got = {r.doc_id: r for r in nbsvm.score(docs, model).collect()}
    for r in rows:
        raw = bytes(48 if 48 < c < 58 else c for c in (r.text or "").encode())
        seen = {mixed(int.from_bytes(raw[i : i + n], "big"), n, nbsvm.BITS) for n in nbsvm.SIZES for i in range(len(raw) - n + 1)}
        margin = sum(float(model.weights[k]) for k in seen) / math.sqrt(len(seen) or 1) + model.offset
        score = 1 / (1 + math.exp(-max(-30, min(30, model.slope * margin + model.shift))))
        assert abs(score - got[r.doc_id].score) < 1e-4 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
    assert nbsvm.train([("good text", 1)] * 3).score("") > 0.5


def test_articles_by_pattern(spark):
    """The driver's pages are plain enough for patterns: the article's blocks, tags gone, references decoded."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", inside[1]) if inside else []
        want = " ".join(" ".join(b.split()) for b in (html.unescape(re.sub(r"<!--.*?-->|<[^>]+>", "", x)) for x in blocks) if b.strip())
        assert got[r.page_id] == want


def test_articles_with_marks_inside():
    page = (
        '<body><div class="site-header">Site</div><article><div class="entry-header"><h1>Title</h1></div><p>One.<img src=x>Two.</p><div class="search-results-summary">Found it. Well.</div>'
        '<div class="ad">Buy</div><div class="notice">Closed</div><div class="widget-links"><a>a</a> <a>b</a></div><section class="comment-list"><p>Nice</p></section></article><div class="articles-list"><header>Other</header></div></body>'
    )
    assert htmltext.extract(page, None) == "Title One.Two. Found it. Well."
    deep = "<div>" * 3000 + "<p>x y</p>" * 2000
    assert htmltext.extract(deep, None) == " ".join(["x y"] * 2000)
    long = "<article><h1>Head</h1><div class=body>" + "<p>Some text here.</p>" * 2000 + "</div></article>"
    assert htmltext.extract(long, None).startswith("Head Some")


def test_pages_by_key_where_hosts_are_many(spark, monkeypatch):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    whole = sorted(map(tuple, htmltext.main_text(pages).collect()))
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, htmltext.main_text(pages).collect())) == whole


def test_bm25_by_definition():
    """Neighbours come in the order of BM25 over all terms of the seed."""
    rng = np.random.default_rng(2)
    docs = [rng.zipf(1.4, rng.integers(5, 120)).clip(max=199).astype("<u2") for _ in range(150)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = np.array([math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in range(200)])
    mean = sum(map(len, docs)) / len(docs)
    shard = packing.Shard(docs, idf, mean)
    for seed in range(0, 150, 20):
        score = defaultdict(float)
        for k, d in enumerate(docs):
            tf = Counter(d.tolist())
            for t in set(docs[seed].tolist()) & tf.keys():
                score[k] += idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        found = []
        for k in shard.neighbours(seed):
            if len(found) == len(score):
                break
            found.append(k)
        assert sorted(found) == sorted(score)
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(found, found[1:]))


def test_long_texts_in_small_batches(spark):
    """Batches end at 64 MB, whatever the rows: texts of some megabytes don't pile up."""
    from helixframe.llm.common import map_rows

    texts = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('word and ', 1000000) as text")
    sizes = map_rows(texts, lambda: lambda i, t: [(i, len(t))], "id long, n long")
    assert sizes.agg(F.sum("n")).first()[0] == 40 * 9_000_000
