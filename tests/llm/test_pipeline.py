"""The pipeline's stages, each on its own input, against brute force."""

import random
import zlib
from itertools import combinations

import corpus_pipeline
from helixframe.llm import simhash, toxicity, wumanber

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.near_duplicates_stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = {r.doc_id: shingles(r.text) for r in docs.collect()}
    kept = {r.doc_id for r in out.collect()}
    near = {}
    owners = {}
    for d, s in rows.items():
        for x in s:
            owners.setdefault(x, []).append(d)
    pairs = {p for who in owners.values() if len(who) < 200 for p in combinations(sorted(who), 2)}
    for a, b in pairs:
        near[a, b] = len(rows[a] & rows[b]) / len(rows[a] | rows[b])
    alike = [p for p, j in near.items() if j >= 0.85]
    assert alike and sum(a in kept and b in kept for a, b in alike) <= 0.03 * len(alike)
    assert not any(a in kept and b in kept for (a, b), j in near.items() if j == 1)
    clean = set(rows) - {d for p, j in near.items() if j >= 0.65 for d in p}
    assert clean <= kept


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"w{i % 97}x{i}" for i in range(300))
    rows = [(5, text), (9, text.replace("w3x3 ", "")), (None, text), (7, None), (8, ""), (7, None), (11, "short"), (12, "short"), (3, "another one")]
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, id int, fp string")
    out = simhash.keep_one(table)
    assert sorted((str(r.doc_id) for r in out.collect())) == sorted(["5", "None", "7", "7", "11", "3"]) and out.columns == table.columns
    assert simhash.keep_one(table.limit(0)).count() == 0
    few = simhash.representatives(table, bucket=1)
    assert sorted(r.doc_id for r in few.collect()) == [3, 5, 7, 11]


def test_other_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, SF).collect()}
    assert sum((d in kept) != (t == 1) for d, t in labels.items()) >= 0.95 * len(labels)
    clean = corpus_pipeline.decontamination_stage(spark, docs, SF)
    hits = {r.doc_id: r.contaminated for r in wumanber.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, hit in hits.items() if not hit} and clean.columns == docs.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def alike_pairs(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    return [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def kept_ids(spark, texts, **more):
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in simhash.representatives(table, **more).collect()}


def expected(texts):
    root = {d: d for d in texts}
    for _ in texts:
        before = dict(root)
        for a, b in alike_pairs(texts):
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return {d for d in texts if root[d] == d}


def test_near_duplicates_of_appended_and_cut_passages(spark):
    texts = {}
    for k in range(60):
        words = [f"d{k}w{i}" for i in range(201)]
        more = [f"d{k}x{i}" for i in range(49)]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(words + more if k % 2 else (more + words)[:250])
    assert len(alike_pairs(texts)) == 60
    assert kept_ids(spark, texts) == {2 * k for k in range(60)}


def test_near_duplicates_at_the_threshold(spark):
    texts = {}
    for k in range(60):
        words = [f"d{k}w{i}" for i in range(204)]
        more = [f"d{k}x{i}" for i in range(50 + k % 2)]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(words + more)
    again = [f"r{i}" for i in range(300)]
    texts[1000], texts[1001] = " ".join(again), " ".join(again + again[100:130] * 20)
    assert len(alike_pairs(texts)) == 31
    assert kept_ids(spark, texts) == expected(texts) == {2 * k for k in range(60)} | {2 * k + 1 for k in range(1, 60, 2)} | {1000}


def test_near_duplicates_in_overfull_buckets(spark):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    texts = {}
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(150)]
        for copy in range(20):
            edited = list(words)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = f"e{rng.random()}"
            texts[100 * family + copy] = " ".join(edited[: 150 - rng.randrange(30)] + common)
    pairs = alike_pairs(texts)
    assert len(pairs) < 12 * 190
    for bucket in (1, 4, 128):
        assert kept_ids(spark, texts, bucket=bucket) == expected(texts)
