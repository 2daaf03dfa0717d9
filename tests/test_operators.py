"""Operators against brute force on small random inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators import classify, cohort, elements, intervals, junctions, pileup, segments, sites, subclonal


def test_interval_joins(spark):
    rng = random.Random(2)
    spans = lambda n, w: [(i, rng.choice("xy"), s := rng.randrange(300), s + rng.randrange(w)) for i in range(n)]
    a, b = spans(60, 40), spans(60, 90)
    left, right = spark.createDataFrame(a, "i long, k string, a long, b long"), spark.createDataFrame(b, "j long, k string, c long, d long")
    for within in (0, 7):
        got = sorted((r.i, r.j, r.distance) for r in intervals.window_join(left, right, ["k"], ("a", "b"), ("c", "d"), within, 16).collect())
        want = sorted((i, j, max(0, a0 - b1, b0 - a1)) for i, k, a0, a1 in a for j, m, b0, b1 in b if k == m and max(0, a0 - b1, b0 - a1) <= within)
        assert got == want
    got = sorted((r.i, r.j) for r in intervals.band_join(left, right, ["k"], "a", "c", 5).collect())
    assert got == sorted((i, j) for i, k, a0, _ in a for j, m, b0, _ in b if k == m and abs(a0 - b0) <= 5)


def missing(depth, cutoff, least):
    out, i = [], 0
    while i < len(depth):
        j = i + 1
        if depth[i] == 0:
            while j < len(depth) and depth[j] < cutoff:
                j += 1
            if j - i >= least:
                out.append((i, j))
        i = j
    return out


def test_missing_coverage(spark):
    rng = random.Random(4)
    depth = [rng.choice([0, 0, 1, 2, 3, 12, 13]) for _ in range(400)]
    df = spark.createDataFrame([("s", i, d, d) for i, d in enumerate(depth)], "k string, pos long, unique_depth long, total_depth long")
    cut = intervals.coverage_cutoff(df, ["k"])
    nonzero = sorted(d for d in depth if d)
    want = max(2, nonzero[len(nonzero) // 2] // 4)
    assert cut.collect()[0].cutoff == want
    got = sorted((r.start_0, r.end_0) for r in intervals.missing_coverage(df, ["k"], "pos", cut, 2).collect())
    assert got == missing(depth, want, 2)


def test_promotion(spark):
    def depth(holes, n=400, total=None):
        return [("s", i, 0 if any(a <= i < b for a, b in holes) else 30, (total or {}).get(i, 0 if any(a <= i < b for a, b in holes) else 30)) for i in range(n)]

    schema = "k string, pos long, unique_depth long, total_depth long"

    def run(rows, junctions=None):
        d = spark.createDataFrame(rows, schema)
        cut = intervals.coverage_cutoff(d, ["k"])
        spans = intervals.missing_coverage(d, ["k"], "pos", cut)
        return sorted((r.start_0, r.end_0) for r in intervals.promoted_deletions(spans, d, ["k"], "pos", cut, junctions=junctions).collect())

    assert run(depth([(0, 60), (100, 160), (200, 230), (340, 400)])) == [(100, 160)]
    assert run(depth([(100, 160)], total={130: 30})) == []
    j = spark.createDataFrame([("s", 200), ("s", 231)], "k string, endpoint long")
    assert run(depth([(200, 230)]), j) == [(200, 230)]


def test_nearest_and_genes(spark):
    rng = random.Random(5)
    points = [(i, rng.choice("xy"), rng.randrange(200)) for i in range(40)]
    features = [(i, rng.choice("xy"), s := rng.randrange(200), s + rng.randrange(12), rng.choice(["CDS", "gene", "tRNA"]), f"g{i}") for i in range(12)]
    p = spark.createDataFrame(points, "point_id long, seq_id string, pos long")
    f = spark.createDataFrame(features, "ord long, seq_id string, start long, end long, feature_type string, label string")
    got = {r.point_id: r for r in classify.gene_context(p, f).collect()}
    order = ["CDS", "tRNA", "rRNA", "gene"]
    for i, s, x in points:
        mine = [g for g in features if g[1] == s]
        inside = sorted((order.index(g[4]), g[0]) for g in mine if g[2] <= x <= g[3])
        if inside:
            assert got[i].label == f"g{inside[0][1]}" and got[i].consequence == f"within {got[i].feature_type}"
            continue
        up, down = max((g[3] for g in mine if g[3] < x), default=None), min((g[2] for g in mine if g[2] > x), default=None)
        text = got[i].consequence
        assert (up is None and down is None) == (text is None)
        if up is not None:
            assert f"+{x - up} bp" in text
        if down is not None:
            assert f"{down - x} bp" in text


REF = "ACGTACGTAC" * 6


def reads(rows):
    return [("s", "chr1", start, minus, seq, cigar, mapq, i) for i, (start, minus, seq, cigar, mapq) in enumerate(rows)]


READ = "sample string, contig string, start_0 long, minus boolean, seq string, cigar string, mapq int, read_id long"


def test_snp_is_called(spark):
    contigs = spark.createDataFrame([("chr1", "ACGTACGTAC")], "contig string, seq string")
    df = spark.createDataFrame(reads([(0, m, "ACTTACGTAC", "10M", 10) for m in [False] * 3 + [True] * 3]), READ)
    got = pileup.call_variants(df, contigs).collect()
    assert [(r.start_1, r.size, r.kind, r.alt, r.depth, r.support) for r in got] == [(3, 1, "SNP", "T", 6, 6)]
    assert pileup.call_variants(df.withColumn("mapq", F.lit(9)), contigs).count() == 0
    d = {r.pos: (r.unique_depth, r.total_depth) for r in pileup.depths(pileup.observations(df, contigs), contigs).collect()}
    assert d[0] == (0, 6) and d[1] == (6, 6) and d[9] == (0, 6)


def test_runs_indels_and_strands(spark):
    contigs = spark.createDataFrame([("chr1", REF)], "contig string, seq string")
    both = [False, True] * 4
    two = REF[:20] + "GG" + REF[22:40]
    got = pileup.call_variants(spark.createDataFrame(reads([(0, m, two, "40M", 60) for m in both]), READ), contigs).collect()
    assert [(r.start_1, r.size, r.kind, r.alt) for r in got] == [(21, 2, "SUB", "GG")]
    gone = REF[:20] + REF[22:42]
    got = pileup.call_variants(spark.createDataFrame(reads([(0, m, gone, "20M2D20M", 60) for m in both]), READ), contigs).collect()
    assert [(r.start_1, r.size, r.kind) for r in got] == [(21, 2, "DEL")]
    more = REF[:20] + "TT" + REF[20:40]
    inserted = lambda strands: spark.createDataFrame(reads([(0, m, more, "20M2I20M", 60) for m in strands]), READ)
    assert [(r.start_1, r.size, r.kind, r.alt) for r in pileup.call_variants(inserted(both), contigs).collect()] == [(20, 2, "INS", "TT")]
    assert pileup.call_variants(inserted([False] * 8), contigs).count() == 0
    one_sided = [(0, m, two if not m else REF[:40], "40M", 60) for m in [False] * 12 + [True] * 2]
    assert pileup.call_variants(spark.createDataFrame(reads(one_sided), READ), contigs).count() == 0


def test_deletions_slide_right():
    w = pileup.Walk(0, "4M1D6M", "GCAAATTTTT"[:4] + "AATTTT", "GCAAAAATTTTTT")
    w.slide_deletions("GCAAAAATTTTTT")
    assert w.deletions() == [(6, 1)]
    assert pileup.slid_insertion("GCAAAT", 1, "A") == (4, "A") and pileup.slid_insertion("GCTATAG", 1, "TA") == (5, "TA")
    w = pileup.Walk(2, "7S10M8S", "T" * 7 + REF[2:12] + "G" * 8, REF)
    assert {(c[0], c[1], c[2]) for c in w.clips} == {("clip_left", 2, "T" * 7), ("clip_right", 11, "G" * 8)}
    w = pileup.Walk(0, "10M5D10M", REF[:10] + REF[15:25], REF)
    assert w.splits == [(9, 15, -5)] and not w.deletions()


def test_homopolymer_ends_say_nothing():
    ref = "GCAAAATCG"
    columns = [[r, r, ref[r]] for r in range(4, 9)]
    assert [c[0] for c in pileup.Walk.telling(columns, ref)] == [6, 7, 8]
    assert pileup.Walk.telling(columns[:2], ref) == columns[:2]


def brute_sites(seq, guide, pam, side, most):
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    fits = lambda s: all(x in {"N": "ACGT", "V": "ACG", "T": "T", "G": "G"}[p] for x, p in zip(s, pam))
    n, k, out = len(guide), len(pam), set()
    for i in range(len(seq) - n - k + 1):
        w = seq[i : i + n + k]
        for strand, s in (("+", w), ("-", "".join(comp[c] for c in reversed(w)))):
            target, found = (s[:n], s[n:]) if side == 3 else (s[k:], s[:k])
            mm = sum(x != y for x, y in zip(target, guide))
            if fits(found) and mm <= most:
                out.add((i + 1, i + n + k, strand, target, found, mm))
    return out


@pytest.mark.parametrize("nuclease", [sites.CAS9, sites.CAS12A])
def test_site_scan(spark, nuclease):
    rng = random.Random(7)
    seq = "".join(rng.choice("ACGT") for _ in range(900))
    guide = "GTACGTTGAC"
    contigs = spark.createDataFrame([("c", seq)], "seq_id string, seq string")
    pieces = sites.windows(contigs, 13, 64)
    assert sorted((r.start, r.window) for r in pieces.collect()) == [(i + 1, seq[i : i + 13]) for i in range(len(seq) - 12)]
    for piece in (64, sites.PIECE):
        found = [(r.start, r.end, r.strand, r.target, r.pam, r.mismatches) for r in sites.scan(contigs, guide, nuclease, 5, piece).collect()]
        assert set(found) == brute_sites(seq, guide, nuclease.pam, nuclease.side, 5) and found and len(found) == len(set(found))
    odd = spark.createDataFrame([("u", "acguugAGG" + "é" * 3), ("n", "ACGTNGAGG"), ("short", "AG"), ("empty", ""), ("null", None)], "seq_id string, seq string")
    got = {(r.seq_id, r.target, r.mismatches) for r in sites.scan(odd, "ACGUTG", sites.CAS9, 1).collect()}
    assert got == {("u", "ACGUUG", 0), ("n", "ACGTNG", 1)}


def test_bulges(spark):
    rng = random.Random(8)
    for bulge in (1, 2, -1, -2):
        guide = "".join(rng.choice("ACGT") for _ in range(9))
        seq = "".join(rng.choice("ACGT") for _ in range(300))
        wrong = sites._bulged(sites._BIT[np.frombuffer(seq.encode(), np.uint8)], np.arange(280), sites._bits(guide), bulge)
        n, skip, drop = len(guide), max(bulge, 0), max(-bulge, 0)
        for i in range(280):
            w = seq[i : i + n + bulge]
            assert wrong[i] == min(sum(a != b for a, b in zip(w[:c] + w[c + skip :], guide[:c] + guide[c + drop :])) for c in range(1, n - drop))


def test_bulge_scan(spark):
    """Every window of a bulge's length next to a PAM, on both strands, against all places of the bulge."""
    rng = random.Random(12)
    seq, guide, comp = "".join(rng.choice("ACGT") for _ in range(700)), "GTACGTTGAC", str.maketrans("ACGT", "TGCA")
    want = set()
    for bulge in (0, 1, -1):
        n, skip, drop = len(guide), max(bulge, 0), max(-bulge, 0)
        for i in range(len(seq) - n - bulge - 2):
            for strand, w in (("+", seq[i : i + n + bulge + 3]), ("-", seq[i : i + n + bulge + 3].translate(comp)[::-1])):
                t, pam = w[:-3], w[-3:]
                least = min(sum(a != b for a, b in zip(t[:c] + t[c + skip :], guide[:c] + guide[c + drop :])) for c in range(1, n - drop)) if bulge else sum(a != b for a, b in zip(t, guide))
                if pam[1:] == "GG" and least <= 3:
                    want.add((i + 1, i + n + bulge + 3, strand, t, pam, least, {0: "none", 1: "DNA", -1: "RNA"}[bulge], abs(bulge)))
    contigs = spark.createDataFrame([("c", seq)], "seq_id string, seq string")
    for piece in (50, sites.PIECE):
        assert {tuple(r)[1:] for r in sites.scan_bulges(contigs, guide, sites.CAS9, 3, 1, 1, piece).collect()} == want


def test_kmer_placements(spark, monkeypatch):
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGT") for _ in range(500)) + "N" + "ACGTT" * 20
    queries = [seq[10:30], seq[100:112], "ACGTTACGTTACGTT", "A" * 11]
    comp = str.maketrans("ACGT", "TGCA")
    queries.append(seq[200:220].translate(comp)[::-1])
    table, contigs = spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([("c", seq), ("n", None)], "seq_id string, seq string")
    got = {(r.query, r.start, r.minus) for r in sites.kmer_placements(table, contigs, 12, 50).collect()}
    want = {(q, i + 1, minus) for q in queries if len(q) >= 12 for minus, s in ((False, q), (True, q.translate(comp)[::-1])) for i in range(len(seq)) if seq.startswith(s, i)}
    assert got == want
    monkeypatch.setattr(sites, "SENT_SEEDS", 0)
    assert {(r.query, r.start, r.minus) for r in sites.kmer_placements(table, contigs, 12, 50).collect()} == want
    assert sites.kmer_placements(table.limit(0), contigs, 12).count() == 0


def test_clusters(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice("ab"), rng.randrange(60), rng.randrange(20)) for i in range(80)]
    got = {r.id: r.cluster for r in junctions.clusters(spark.createDataFrame(rows, "id long, k string, s1 long, s2 long"), ["k"], "s1", "s2", "id").collect()}
    firsts, want = defaultdict(list), {}
    for i, k, a, b in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        hit = next((f for f in firsts[k] if abs(f[1] - a) <= 5 and abs(f[2] - b) <= 5), None)
        if hit is None:
            firsts[k].append(hit := (i, a, b))
        want[i] = hit[0]
    assert got == want


def test_junction_rules(spark):
    rows = spark.createDataFrame([(36, 0, 20, 18, 36), (36, 0, 36, 18, 36), (36, 2, 20, 18, 36), (60, 0, 20, 45, 60), (36, 0, 34, 4, 36)], "n int, a int, b int, c int, d int")
    assert [r[0] for r in rows.select(junctions.is_mosaic(*(F.col(c) for c in "nabcd"))).collect()] == [True, False, False, False, False]
    reads = spark.createDataFrame([("r/1", 0x45, "10M"), ("r/2", 0x81, "7S10M"), ("x/2", 0, "10M5S"), ("y", 8, "*")], "qname string, flag int, cigar string")
    assert [(r.name, r.mate, r.second_pass) for r in junctions.flagged_reads(reads).collect()] == [("r", 1, True), ("r", 2, True), ("x", 2, False), ("y", 0, True)]
    seeds = spark.createDataFrame([(1, "m1", "g", "p", ["q", "r"]), (2, "m2", "g", "q", ["p"]), (3, "m3", "g", "r", []), (4, "m1", "g", "q", ["p"])], "id long, molecule string, geometry string, anchor string, copies array<string>")
    assert [(r.id, r.other) for r in junctions.reciprocal(seeds).collect()] == [(1, 2)]


def test_subclonal_classes(spark):
    def row(name, s, e, other=0):
        return (name, s[0] - s[1], 0, s[1], 0, 0, 0, (e[0] - e[1]) // 2, e[0] - e[1] - (e[0] - e[1]) // 2, e[1] // 2, e[1] - e[1] // 2, other, 0)

    names = [f"{k}_{d}_{s}" for s in "se" for k in ("ref", "alt", "other") for d in ("fwd", "rev")]
    rows = [row("specific", (200, 0), (200, 50)), row("enriched", (200, 20), (200, 100)), row("same", (200, 20), (200, 20)), row("none", (200, 0), (200, 0)), row("shallow", (15, 0), (100, 20)), row("depleted", (200, 100), (200, 20)), row("trace", (200, 9), (200, 14))]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{n} long" for n in names))
    got = {r.name: r["class"] for r in subclonal.evaluate(df).collect()}
    assert got == {"specific": "EDITED_SPECIFIC", "enriched": "EDITED_ENRICHED", "same": "PRE_EXISTING_IN_STARTER", "none": "NOT_SUBCLONAL", "shallow": "INDETERMINATE_STARTER_DEPTH", "depleted": "DEPLETED_IN_EDITED", "trace": "AMBIGUOUS_STARTER_TRACE"}
    biased = spark.createDataFrame([("b", 200, 0, 0, 0, 0, 0, 44, 44, 12, 0, 0, 0)], "name string, " + ", ".join(f"{n} long" for n in names))
    assert subclonal.evaluate(biased).first().flags == ["SINGLE_STRAND_ALT", "STRAND_BIAS"]


def test_cohort(spark):
    seen = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e1", "a"), ("e2", "a"), ("e3", "a"), ("e3", "b"), ("e3", "c")], "event string, clone string")
    assert {r.event: (r.n_clones, r.scope) for r in cohort.recurrence(seen, "event", "clone", 3).collect()} == {"e1": (2, "shared_subset"), "e2": (1, "clone_specific"), "e3": (3, "shared_all")}
    m = {r.event: (r.clone_a, r.clone_b, r.clone_c) for r in cohort.presence_matrix(seen, "event", "clone", ["a", "b", "c"]).collect()}
    assert m == {"e1": (1, 1, 0), "e2": (1, 0, 0), "e3": (1, 1, 1)}
    none = cohort.confusion(spark.createDataFrame([("g", False, False)], "g string, t boolean, c boolean"), ["g"], F.col("t"), F.col("c")).first()
    assert none.precision is None and none.f1 is None and none.tn == 1


def test_allele_counts(spark):
    rows = [("p", 1, "A", False), ("p", 1, "C", False), ("p", 2, "C", True), ("p", 3, "A", True), ("p", 4, "G", False)]
    df = spark.createDataFrame(rows, "pos string, read long, base string, minus boolean")
    r = subclonal.allele_counts(df, ["pos"], "read", F.col("base") == "C", F.col("base") == "A", F.col("minus")).first()
    assert (r.alt_fwd, r.alt_rev, r.ref_fwd, r.ref_rev, r.other_fwd, r.other_rev) == (1, 1, 0, 1, 1, 0)
    assert Counter(b for *_, b, _ in rows)["C"] == 2


def test_segments_agree_with_windows(spark):
    """Scans over segments of 8 positions against windows over whole groups: sums, extremes, both directions, ties, gaps and neighbours."""
    rng = random.Random(21)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-40, 200), i, rng.choice([None, *range(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, p long, i long, v long")
    whole = W.partitionBy("k").orderBy("p", "i")
    upto, back = whole.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("k").orderBy(F.col("p").desc(), F.col("i").desc()).rowsBetween(W.unboundedPreceding, 0)
    tied = W.partitionBy("k").orderBy("p").rangeBetween(W.unboundedPreceding, 0)
    want = df.select("i", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(upto).alias("m"), F.min("v").over(back).alias("n"), F.coalesce(F.sum("v").over(tied), F.lit(0)).alias("t"), F.lag("i").over(whole).alias("l"), F.sum("v").over(W.partitionBy("k").orderBy("p").rangeBetween(-11, 11)).alias("r"))
    got = segments.running(df, ["k"], "p", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, ["i"], 8)
    got = segments.running(got, ["k"], "p", {"n": ("min", F.col("v"))}, ["i"], 8, backward=True)
    got = segments.running(got, ["k"], "p", {"t": ("sum", F.col("v"))}, width=8, ties=True)
    got = segments.around(segments.previous(got, ["k"], "p", {"l": F.col("i")}, ["i"], 8), ["k"], "p", 11, {"r": F.col("v")}, 8).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    stretch = {r.i: (r.k, r.stretch) for r in segments.stretches(df, ["k"], "p", 3, width=8).collect()}
    for k in ("a", "b", None):
        at, begin = None, None
        for p, i in sorted((p, i) for key, p, i, _ in rows if key == k):
            begin = p if at is None or p - at > 3 else begin
            at = p
            assert stretch[i] == (k, begin)


def test_insertions_by_their_rule(spark):
    rng = random.Random(22)
    rows = [(i, i + 1000, rng.choice("xy"), rng.randrange(400), rng.randrange(4), rng.randrange(4, 9), rng.random() < 0.5, rng.randrange(3, 6)) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, j long, seq_id string, plus long, least int, total int, exact boolean, dup long")
    want = []
    for r in sorted(rows, key=lambda r: (-r[4], -r[5], r[7] if r[6] else 0, r[3], r[0])):
        if all(r[2] != w[2] or abs(r[3] - w[3]) > elements.PAIR_DISTANCE for w in want):
            want.append(r)
    assert sorted(map(tuple, elements.insertions(df).collect())) == sorted(want)


def test_rank_of_a_whole_table(spark):
    rng = random.Random(23)
    for most, budget, top in ((5000, 700, 4), (12, 10**6, 4), (5000, 300, 2)):
        df = spark.createDataFrame([(i, rng.randrange(top), rng.randrange(1, 40)) for i in range(120)], "k long, seeds int, len int")
        want = junctions.rank_and_cap(df.withColumn("g", F.lit(1)), ["g"], "seeds", "len", ["k"], F.lit(budget), most).select("k", "rank", "total")
        got = junctions.rank_and_cap_all(df, "seeds", "len", ["k"], budget, most).select("k", "rank", "total")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_annotations_and_point_links(spark):
    """Genes by event, within and between features; links by where a record begins."""
    features = spark.createDataFrame([(0, "c", 100, 200, "gene", "b1", "thrA"), (1, "c", 100, 200, "CDS", "b1", "thrA"), (2, "c", 300, 400, "CDS", "b2", None)], "ord int, seq_id string, start long, end long, feature_type string, locus_tag string, gene_name string")
    events = spark.createDataFrame([("in", "k1\x1fc", 150), ("locus", "c", 300), ("between", "c", 250), ("before", "c", 50), ("after", "c", 500), ("none", "d", 5)], "event_id string, seq_id string, position long")
    got = {r.event_id: tuple(r)[1:4] for r in classify.annotations(events, features).collect()}
    assert got == {"in": ("thrA", "b1", "CDS"), "locus": (None, "b2", "CDS"), "between": ("thrA/b2", None, "intergenic"), "before": ("thrA", None, "intergenic"), "after": ("b2", None, "intergenic"), "none": (None, None, None)}
    sites = spark.createDataFrame([("S1", "c", 160, 182, 1, "AGG"), ("S2", "d", 10, 32, 0, "TGG")], "site_id string, seq_id string, start long, end long, mismatches int, pam string")
    records = spark.createDataFrame([("a", "DEL", ["c", "100", "200"]), ("b", "DEL", ["c", "150", "9"]), ("j", "JC", ["c", "190", "1", "d", "40", "-1", "0"]), ("s", "SNP", ["c", "170", "A"])], "event_id string, kind string, fields array<string>")
    links = {(r.event_id, r.side, r.site_id, r.distance) for r in classify.links_by_point(records, sites, 10).collect()}
    assert links == {("b", 1, "S1", 10), ("j", 1, "S1", 8), ("j", 2, "S2", 8), ("s", 1, "S1", 0)}
