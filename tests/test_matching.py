"""The matching against all matchings of small graphs."""

import random

from helixframe.operators import differential
from helixframe.operators.differential import cheapest_matching


def all_best(edges):
    best = (0, (0, 0))

    def grow(i, left, right, cost, n):
        nonlocal best
        best = min(best, (-n, cost))
        for j in range(i, len(edges)):
            a, b, x, y = edges[j]
            if a not in left and b not in right:
                grow(j + 1, left | {a}, right | {b}, (cost[0] + x, cost[1] + y), n + 1)

    grow(0, frozenset(), frozenset(), (0, 0), 0)
    return best


def test_matching_is_maximum_and_cheapest():
    rng = random.Random(0)
    for _ in range(800):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        edges = [(a, 10 + b, rng.randrange(6), rng.randrange(10)) for a in range(n) for b in range(m) if rng.random() < 0.6]
        cost = {(a, b): (x, y) for a, b, x, y in edges}
        got = cheapest_matching(edges)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        assert (-len(got), (sum(cost[p][0] for p in got), sum(cost[p][1] for p in got))) == all_best(edges)


def test_running_sums_and_minima(spark):
    import random

    from helixframe.functions import statistics
    from helixframe.operators import cohort, ranks

    rng = random.Random(6)
    rows = [(i, rng.randrange(50), rng.random()) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, n int, v double").repartition(7)
    got = {r.id: r.s for r in ranks.running_sum(table, ["id"], "n", "s").collect()}
    assert got == {i: sum(n for _, n, _ in rows[: i + 1]) for i in range(400)}
    got = {r.id: r.m for r in ranks.least_from(table, ["id"], "v", "m").collect()}
    assert got == {i: min(v for _, _, v in rows[i:]) for i in range(400)}
    assert ranks.running_sum(table.limit(0), ["id"], "n", "s").count() == 0
    names = [r.name for r in cohort.numbered(table, ["v"], "X", 4, "name").orderBy("v").collect()]
    assert names == [f"X_{k:04d}" for k in range(1, 401)]
    p = sorted(v for _, _, v in rows)
    q = {v: min(min(1.0, p[j] * 400 / (j + 1)) for j in range(i, 400)) for i, v in enumerate(p)}
    got = {r.v: r.q for r in statistics.benjamini_hochberg(table, "v", "q").collect()}
    assert all(abs(got[v] - q[v]) < 1e-12 for v in q)


def test_alignment_beyond_the_reach(spark):
    from pyspark.sql import functions as F

    from helixframe.functions import sequence

    row = spark.createDataFrame([("G" + "AC" * 1500 + "T",)], "seq string")
    got = row.select(sequence.right_aligned_deletion("seq", F.lit(2), F.lit(2)).alias("d"), sequence.right_aligned_insertion("seq", F.lit(1), F.lit("AC")).alias("i")).first()
    assert got.d == 3000 and (got.i.position, got.i.bases) == (3001, "AC")


def graph_search(n, m, edges):
    """Pairs of a maximum matching by shortest paths over an explicit graph, whose edges keep their cost when turned around."""
    scale = sum(e[3] for e in edges) + 1
    arcs = {}  # (from, to): cost; nodes are ("s",), ("e", i), ("t", j), ("z",)
    for i in range(n):
        arcs[("s",), ("e", i)] = 0
    for i, j, most, total in sorted(edges):
        arcs[("e", i), ("t", j)] = most * scale + total
    for j in range(m):
        arcs[("t", j), ("z",)] = 0
    while True:
        dist, back = {("s",): 0}, {}
        for _ in range(n + m + 2):
            for (a, b), c in sorted(arcs.items()):
                if a in dist and (b not in dist or dist[a] + c < dist[b]):
                    dist[b], back[b] = dist[a] + c, a
        if ("z",) not in dist:
            return {(b[1], a[1]) for a, b in arcs if a[0] == "t" and b[0] == "e"}
        at = ("z",)
        while at != ("s",):
            arcs[at, back[at]] = arcs.pop((back[at], at))
            at = back[at]


def test_undoing_at_full_cost():
    """Both searches match as many; where they differ, the one that pays for undoing is the graph's own."""
    rng = random.Random(31)
    differ = 0
    for _ in range(300):
        n, m = rng.randint(2, 5), rng.randint(1, 4)
        edges = [(i, j, rng.randint(0, 5), rng.randint(5, 9)) for i in range(n) for j in range(m) if rng.random() < 0.6]
        cheapest, paid = differential.cheapest_matching(edges), differential.cheapest_matching(edges, 1)
        want = graph_search(n, m, edges)
        assert len(cheapest) == len(paid) == len(want)
        cost = lambda pairs: sorted((most, total) for i, j, most, total in edges if (i, j) in set(pairs))
        assert cost(paid) == cost(want)
        differ += {a for a, _ in cheapest} != {a for a, _ in paid}
    assert differ


def test_subtract_records(spark):
    jc = lambda a, b: ["c", str(a), "1", "c", str(b), "-1", "0"]
    edited = [(1, "SNP", ["c", "5", "A"]), (2, "SNP", ["c", "5", "A"]), (3, "JC", jc(100, 200)), (4, "JC", jc(103, 203)), (5, "JC", ["c", "300", "-1", "c", "250", "1", "0"]), (6, "DEL", ["c", "40", "9"]), (7, "DEL", ["c", "60", "2"]), (8, "UN", ["c", "1", "2"]), (9, "MOB", ["c", "70", "IS1", "1", "4"])]
    starter = [(1, "SNP", ["c", "5", "A"]), (2, "JC", jc(105, 205)), (3, "JC", ["c", "250", "1", "c", "300", "-1", "0"]), (4, "DEL", ["c", "42", "8"]), (5, "DEL", ["c", "61", "2"]), (6, "UN", ["c", "1", "2"]), (7, "MOB", ["c", "76", "IS1", "1", "4"])]
    table = lambda rows: spark.createDataFrame(rows, "id long, kind string, fields array<string>")
    got = differential.subtract_records(table(edited), table(starter)).collect()
    assert sorted(r.id for r in got) == [2, 3, 7, 8, 9] and next(r for r in got if r.id == 3).fields == jc(100, 200)
    assert differential.subtract_records(table(edited), table([])).count() == 9 and differential.subtract_records(table([]), table(starter)).count() == 0
