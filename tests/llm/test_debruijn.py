"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

from helixframe.llm import debruijn


def brute(rows, window):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for s in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[s : s + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and first[tuple(w[s : s + window])] < d:
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(table, *sizes):
    return sorted(map(tuple, debruijn.remove_repeats(table, *sizes).drop("kept_text").collect()), key=str)


def test_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_branching_text(spark):
    """Few distinct words, short windows: many anchors, loops and branches."""
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice("pqrst") + rng.choice("xyz") for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 7))]
        rows.append((d, " \n".join(parts)))
    rows += [(200, "same word " * 500), (201, "word same " * 300), (None, passages[0] * 2), (5, passages[1]), (7, rows[7][1]), (300, None), (301, ""), (302, " \t ")]
    table = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, h int, runs string, sha string")
    for window, k in ((12, 4), (20, 8)):
        assert got(table, window, k) == brute(rows, window)
    assert got(table.limit(0)) == []
