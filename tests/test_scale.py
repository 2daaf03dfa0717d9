"""What keeps large tables affordable: how often rows move, and how work is dealt out."""

from helixframe.plans import bridge


def test_seeds_of_families_move_once(spark):
    plan = bridge.QUERIES["repeat_families"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    # two halves (anchors with and without a sequence), each: its seeds, the index's, and the places; the second half deals by family as well
    assert len(moves) <= 9
    assert sum("molecule" in line for line in moves) <= 1


def test_matching_is_dealt_out_by_components(spark):
    from helixframe.operators import differential

    rows = [(k, 10 * k + i, 10 * k + j, abs(i - j), abs(i - j) + 1) for k in range(40) for i in range(3) for j in range(3) if (i + j + k) % 4]
    table = spark.createDataFrame([(None if k == 7 else k % 8, a, b, x, y) for k, a, b, x, y in rows], "k long, edited_id long, starter_id long, max_delta long, sum_delta long").repartition(3)
    out = differential.one_to_one(table, ["k"])
    want = set()
    for key in [None, *range(8)]:
        edges = [(a, b, x, y) for k, a, b, x, y in rows if (None if k == 7 else k % 8) == key]
        want |= {(key, a, b) for a, b in differential.cheapest_matching(edges)}
    assert {tuple(r) for r in out.collect()} == want and out.columns == ["k", "edited_id", "starter_id"]
    assert len(differential._apart([(1, 2, 0, 0), (3, 4, 0, 0), (1, 4, 0, 0), (5, 6, 0, 0)])) == 2
    # a task for many blocks, not a call of pandas for each, and as many tasks as the cluster has use for
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and out.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert differential.one_to_one(table.limit(0), ["k"]).count() == 0


def test_scans_read_contigs_once(spark):
    from helixframe.operators import sites

    contigs = spark.createDataFrame([("a", "ACGTUGGACCTTAGGRA" * 9), ("b", "ACG"), ("c", None), ("d", "atgcccgta")], "seq_id string, seq string")
    rows = {}
    for r in sites.windows(contigs, 5).collect():
        n, fits = rows.get(r.seq_id, (0, 0))
        rows[r.seq_id] = (n + 1, fits + (r.window[0] in "AG" and r.window[1] in "CTU" and r.window[2] in "ACG"))
    for piece in (20, sites.PIECE):
        assert {r.seq_id: (r.windows, r.fits) for r in sites.fitting(contigs, 5, "RYV", piece).collect()} == rows
    plan = sites.scan_bulges(contigs, "ACGTTGG", sites.CAS9, 3, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
