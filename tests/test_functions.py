"""Scalar functions against known values and plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import identity, sequence, statistics
from helixframe.functions.geometry import event_intervals, interval_distance
from helixframe.operators import classify, differential


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sequences(spark):
    r = one(spark, sequence.reverse_complement(F.lit("ACGTU")), sequence.hamming(F.lit("acgu"), "ACCT"), sequence.iupac_match(F.lit("AGG"), "NGG"), sequence.iupac_match(F.lit("NGG"), "NGG"), sequence.gc_fraction(F.lit("GGCA")))
    assert tuple(r) == ("AACGT", 1, True, False, 0.75)
    assert sequence.reverse_complement_iupac("NGG") == "CCN" and sequence.iupac_regex("TTTV") == "TTT[ACG]"


def test_right_alignment(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(150):
        seq = "".join(rng.choice("AC") for _ in range(24))
        start, size = rng.randrange(1, 20), rng.randrange(1, 4)
        bases = "".join(rng.choice("AC") for _ in range(size))
        rows.append((seq, start, size, bases))
    df = spark.createDataFrame(rows, "seq string, start long, size long, bases string")
    got = df.select("seq", "start", "size", "bases", sequence.right_aligned_deletion("seq", F.col("start"), F.col("size")).alias("d"), sequence.right_aligned_insertion("seq", F.col("start"), F.col("bases")).alias("i")).collect()
    for r in got:
        s = r.seq
        gone = s[: r.start - 1] + s[r.start - 1 + r.size :]
        if r.start - 1 + r.size <= len(s):
            assert r.d == max(p for p in range(1, len(s) - r.size + 2) if s[: p - 1] + s[p - 1 + r.size :] == gone)
        put = s[: r.start] + r.bases + s[r.start :]
        last = max(p for p in range(len(s) + 1) if s[:p] == put[:p] and put[p + r.size :] == s[p:])
        assert (r.i.position, r.i.bases) == (last, put[last : last + r.size])


@pytest.mark.parametrize(
    "alt, depth, low, high",
    [(0, 200, 0, 0.023490044), (10, 200, 0.025607917, 0.092691077), (20, 200, 0.063662945, 0.152296662), (50, 200, 0.192823884, 0.316986392), (100, 200, 0.428908815, 0.571091185), (0, 100, 0, 0.046101341)],
)
def test_wilson(spark, alt, depth, low, high):
    ci = one(spark, statistics.wilson(F.lit(alt), F.lit(depth)).alias("c")).c
    assert ci.low == pytest.approx(low, abs=1e-9) and ci.high == pytest.approx(high, abs=1e-9)


def test_exact_tests():
    for a, p in ((10, 1.740518e-3), (20, 1.157374e-6), (50, 5.328258e-17), (0, 1)):
        assert statistics.fisher_p(a, 200 - a, 0, 200) == pytest.approx(p, rel=1e-5)
    assert statistics.fisher_p(44, 44, 12, 0) == pytest.approx(9.60526e-4, rel=1e-5)
    assert statistics.binomial_upper_tail(10, 200, 0.005) == pytest.approx(9.255902e-8, rel=1e-5)
    assert statistics.binomial_upper_tail(0, 200, 0.005) == 1
    for k, n, e in ((1, 5, 0.3), (3, 9, 0.6), (9, 9, 0.2)):
        assert statistics.binomial_upper_tail(k, n, e) == pytest.approx(sum(math.comb(n, x) * e**x * (1 - e) ** (n - x) for x in range(k, n + 1)))


def test_difference_and_q_values(spark):
    ci = lambda a, n: statistics.wilson(F.lit(a), F.lit(n))
    d = one(spark, statistics.newcombe(F.lit(0.05), ci(10, 200), F.lit(0.0), ci(0, 200)).alias("d")).d
    assert (d.delta, d.low, d.high) == pytest.approx((0.05, 0.016136216, 0.092691077), abs=1e-9)
    p = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.04,), (0.5,), (None,)], "p double")
    got = {r.p: r.q for r in statistics.benjamini_hochberg(p, "p", "q").collect()}
    assert got.pop(None) is None and [got[x] for x in sorted(got)] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.5])


REFS = [("chr1", "GCTGGTAAACCATAACTGTCGCAGCGTTAACCGGTT"), ("chr2", "ATCGATCGATCGATCGATCG")]


def test_event_ids(spark):
    records = [(1, "SNP", ["chr1", "5", "C"]), (2, "DEL", ["chr1", "7", "1"]), (3, "DEL", ["chr1", "9", "1"]), (4, "JC", ["chr1", "10", "+", "chr2", "5", "-", "0"]), (5, "JC", ["chr2", "5", "-", "chr1", "10", "1", "0"]), (6, "MOB", ["chr1", "8", "IS1", "-1", "-4"]), (7, "INS", ["chr1", "6", "A"])]
    rows = spark.createDataFrame(records, "id int, kind string, fields array<string>")
    got = {r.id: r for r in differential.canonical(rows, spark.createDataFrame(REFS, "seq_id string, seq string")).collect()}
    where = lambda name, pos: len(name).to_bytes(4, "big") + name.encode() + hashlib.sha256(dict(REFS)[name].encode()).digest() + pos.to_bytes(8, "big")
    assert bytes(got[1].preimage) == identity.DOMAIN + b"\x01" + where("chr1", 5) + b"C"
    assert got[1].event_id == "DV1_" + hashlib.sha256(bytes(got[1].preimage)).hexdigest()[:32]
    assert got[2].event_id == got[3].event_id and got[2].fields == ["chr1", "9", "1"]  # one of AAA, wherever it is lost
    assert got[4].event_id == got[5].event_id
    assert bytes(got[6].preimage) == identity.DOMAIN + b"\x05" + where("chr1", 8) + (3).to_bytes(4, "big") + b"IS1" + b"\x02" + (-4).to_bytes(8, "big", signed=True)
    assert got[7].fields == ["chr1", "9", "A"]
    with pytest.raises(Exception, match="unknown sequence"):
        differential.canonical(rows, spark.createDataFrame(REFS[:1], "seq_id string, seq string")).collect()


def test_difference_of_samples(spark):
    refs = spark.createDataFrame([("c", "ACGT" * 500)], "seq_id string, seq string")
    df = lambda rows: spark.createDataFrame(rows, "id int, kind string, fields array<string>")
    starter = df([(1, "SNP", ["c", "10", "G"]), (2, "MOB", ["c", "100", "IS1", "1", "4"]), (3, "JC", ["c", "300", "1", "c", "600", "-1", "0"]), (4, "DEL", ["c", "900", "50"])])
    edited = df([(1, "SNP", ["c", "10", "G"]), (2, "SNP", ["c", "11", "G"]), (3, "MOB", ["c", "105", "IS1", "1", "4"]), (4, "MOB", ["c", "106", "IS1", "1", "4"]), (5, "JC", ["c", "304", "1", "c", "597", "-1", "0"]), (6, "JC", ["c", "306", "1", "c", "600", "-1", "0"]), (7, "DEL", ["c", "901", "50"])])
    assert {r.ids[0] for r in differential.difference(edited, starter, refs).collect()} == {2, 4, 6}


def test_geometry_and_families(spark):
    rows = spark.createDataFrame([("DEL", ["c", "5", "3"]), ("JC", ["a", "7", "1", "b", "9", "-1", "0"]), ("RA", ["c", "1", "0", "A", "C"])], "kind string, fields array<string>")
    got = [r[0] for r in rows.select(event_intervals(F.col("kind"), F.col("fields"))).collect()]
    assert [(x.side, x.seq_id, x.start, x.end) for x in got[0]] == [(0, "c", 5, 7)] and [(x.side, x.seq_id, x.start) for x in got[1]] == [(1, "a", 7), (2, "b", 9)] and got[2] is None
    assert one(spark, interval_distance(F.lit(1), F.lit(5), F.lit(6), F.lit(9)))[0] == 1
    names = {"IS1": "IS1 family", "is150_x": "IS3 family", "IS186B": "IS4 family", "Tn7": "Tn7 family", "IS9999": "IS9999 family", "foo": "Mobile Element", "IS110": "IS110 family"}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.f for r in df.select("n", classify.element_family(F.col("n")).alias("f")).collect()} == names


def test_site_score(spark):
    guide = "GACTGACTGACTGACTGACT"
    turned = lambda *at: "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i in at else c for i, c in enumerate(guide))
    cases = [(), (0,), (19,), (5, 13), (2, 6, 19), tuple(range(20))]
    rows = spark.createDataFrame([(k, guide.lower(), turned(*c)) for k, c in enumerate(cases)] + [(99, guide, "ACGT"), (98, None, guide)], "k int, g string, t string")
    got = {r.k: r.s for r in rows.select("k", sequence.site_score(F.col("g"), F.col("t")).alias("s")).collect()}
    for k, c in enumerate(cases):
        want = 100.0
        for i in c:
            want *= 1 - sequence.POSITION_COST[i]
        if c:
            gaps = [b - a for a, b in zip(c, c[1:])]
            want /= ((19 - (sum(gaps) / len(gaps) if gaps else 19)) / 19 * 4 + 1) * len(c) ** 2
        assert got[k] == pytest.approx(want, abs=1e-9)
    assert got[99] is None and got[98] is None
