"""Bridge queries over whole tables, against plain Python."""

from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from helixframe.plans import bridge

SF = "/root/testdata/sf0.01"


def rows_of(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]


def test_recurrence_reads_all_events(spark):
    kinds = defaultdict(set)
    for user, kind in rows_of(spark, "events", "user_id", "event_type"):
        kinds[user].add(kind)
    scope = {1: "clone_specific", 5: "shared_all"}
    got = {(r.user_id, r.n_clones, r.scope) for r in bridge.QUERIES["recurrence"](spark, SF).collect()}
    assert got == {(u, len(k), scope.get(len(k), "shared_subset")) for u, k in kinds.items()}
    for r in bridge.QUERIES["recurrence_matrix"](spark, SF).collect():
        assert {c.removeprefix("clone_") for c, v in r.asDict().items() if c != "user_id" and v} == kinds.pop(r.user_id)
    assert not kinds


def test_merged_metrics_reads_all_parts(spark):
    sizes = defaultdict(set)
    for brand, size in rows_of(spark, "part", "p_brand", "p_size"):
        sizes[brand].add(size)
    got = {tuple(r) for r in bridge.QUERIES["merged_metrics"](spark, SF).collect()}
    assert got == {(b, str(min(s)) if len(s) == 1 else "NOT_EVALUABLE") for b, s in sizes.items()}


def test_read_piece_pairs_has_all_orders(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/lineitem.parquet")
    few = table.where("l_orderkey <= 3000").withColumn("l_orderkey", F.expr("if(l_orderkey <= 50, -1, l_orderkey)"))
    few.write.parquet(f"{tmp_path}/lineitem.parquet")
    pieces = defaultdict(list)
    for order, k, q in few.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long")).collect():
        pieces[order].append((q, q + k * 7))
    assert max(map(len, pieces.values())) > 20
    want = {(o, len(p) * (len(p) - 1) // 2, sum(max(x[1], y[1]) - min(x[0], y[0]) <= 40 for x, y in combinations(p, 2))) for o, p in pieces.items() if len(p) > 1}
    assert {tuple(r) for r in bridge.QUERIES["read_piece_pairs"](spark, str(tmp_path)).collect()} == want
