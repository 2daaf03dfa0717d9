"""The pipeline's near-duplicate stage goes by SimHash fingerprints first; the exact check adds what they leave."""

import corpus_pipeline
from helixframe.llm import simhash


def test_near_duplicates_stage_uses_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join(words[:399]), 3: " ".join(words + [f"x{i}" for i in range(60)]), 4: "something else altogether", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = []

    def seen(fps, distance, *more):
        asked.append((fps.count(), distance))
        return found(fps, distance, *more)

    found = simhash.links
    monkeypatch.setattr(simhash, "links", seen)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()} == {1, 4, 5}
    assert len(asked) == 1 and asked[0][0] > 1 and asked[0][1] == 4
    nodes = spark.createDataFrame([(1, 9, 0), (2, 9, 0b1111), (3, 9, 0b11111 << 20), (4, 9, 0), (5, 0, 0)], "id long, n long, fp long")
    assert {tuple(r) for r in simhash._printed(nodes, 4).collect()} == {(1, 4), (1, 2)}
