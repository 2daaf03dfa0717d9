"""Packing: the tokenizer's own ids, an exact cover of every document, full windows, and lexical neighbours."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing
from helixframe.llm.queries import tokenizer_path

ODD = ["", "Naïve CAFÉ Σίσυφος ΟΔΟΣ İx", "á ́b  x y z　w", "don't I'LL '' ''s 1234 \U0001f600!!", "x\x1cy \x1f z", "a <|endoftext|> b<|startoftext|>", "Å가 ﬁ", "tab\tnew\nline\r\n", "w" * 3000]


def own_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_is_the_tokenizer():
    e, t = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ODD:
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == own_ids(t, text)[:-1], text


def check(rows, out, window):
    t = Tokenizer.from_file(tokenizer_path())
    ids = {d: own_ids(t, text) for d, text in rows}
    copies = defaultdict(int)
    for d, _ in rows:
        copies[d] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, n in copies.items():
        cover = np.zeros(len(ids[d]), int)
        for a, k in by_doc[d]:
            cover[a : a + k] += 1
        assert (cover == n).all()
    partial = 0
    for pieces in by_sequence.values():
        at = 0
        for o, k in sorted(pieces):
            assert o == at
            at += k
        assert at <= window
        partial += at < window
    return partial


@pytest.mark.parametrize("shard", [4_000_000, 3000])
def test_exact_cover(spark, shard, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(rows, packing.pack(docs, tokenizer_path(), 512).collect(), 512) <= 1
    rows = [(k, t) for k, t in enumerate([None, *ODD])] + [(3, ODD[2])] + [(50, "the quick brown fox " * 3000)]
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, width int").coalesce(1)
    assert check([(d, t) for d, t in rows], packing.pack(table, tokenizer_path(), 256).collect(), 256) <= 1
    assert packing.pack(table.limit(0), tokenizer_path()).count() == 0


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k + 10, 100 * k + 110, (20, 60)) for k in range(5)]
    docs = [topics[i % 5][i // 5].astype("<u2") for i in range(100)]
    shard = packing.Shard(docs, np.ones(700, np.float32), 60)
    together = [{p[0] % 5 for p in w} for w in packing.windows(shard, 240)]
    assert np.mean([len(t) == 1 for t in together]) > 0.8


def test_statistics(spark):
    table = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, None)], "doc_id long, text string").repartition(3)
    df, n, mean = packing.statistics(packing.tokenize(table, tokenizer_path()))
    t = Tokenizer.from_file(tokenizer_path())
    cat, dog = t.encode("cat").ids[0], t.encode("dog").ids[0]
    assert (df[cat], df[dog], df[1], n) == (1, 2, 3, 3) and abs(mean - 7 / 3) < 1e-9
