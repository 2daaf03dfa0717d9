"""Emission, constructs, element insertions, review, product tables and whole runs, against hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import checks
from helixframe.operators import constructs, elements, emission, review, subclonal
from helixframe.plans import run
from helixframe.sources import products, readers, writers

REPEAT = "ord int, seq_id string, start long, end long, strand int, name string"


def test_repeat_gate(spark):
    copies = spark.createDataFrame([(0, "c", 100, 900, 1, "IS1"), (1, "c", 5000, 5800, 1, "IS1"), (2, "c", 880, 1200, -1, "IS2")], REPEAT)
    rows = [
        (1, "c", 300, "c", 500, False, False),  # two inner points of one copy
        (2, "c", 101, "c", 500, False, False),  # at an end of it
        (3, "c", 300, "c", 5300, False, False),  # inner points of distant copies
        (4, "c", 300, "c", 5300, True, False),  # balanced
        (5, "c", 300, "c", 5300, False, True),  # part of an insertion
        (6, "c", 300, "c", 2000, False, False),  # one side unique
        (7, "c", 500, "c", 1000, False, False),  # copies that overlap
    ]
    table = spark.createDataFrame(rows, "id int, seq_id1 string, pos1 long, seq_id2 string, pos2 long, balanced boolean, constituent boolean")
    got = {r.id: r.repeat_junction for r in emission.gated(table, copies).collect()}
    assert got == {2: True, 4: True, 5: True, 6: False, 7: True}
    assert emission.gated(table.limit(0), copies).count() == 0 and emission.gated(table, copies.limit(0)).count() == 7


def test_constituents_and_parents(spark):
    rows = [("s", "1", "JC", []), ("s", "2", "JC", []), ("s", "3", "MOB", ["1"]), ("t", "1", "JC", [])]
    table = spark.createDataFrame(rows, "sample string, id string, kind string, parent_ids array<string>")
    assert sorted((r.sample, r.id) for r in emission.without_constituents(table, ["sample"]).collect()) == [("s", "2"), ("s", "3"), ("t", "1")]
    events = table.withColumnRenamed("id", "event_id")
    told = emission.resolved_parents(events.where("kind = 'MOB'"), table, ["sample"]).first()
    assert [tuple(x) for x in told.found] == [("1", "JC")] and told.unresolved == []


def test_flanks_and_constructs(spark):
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(200))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contigs = spark.createDataFrame([("c", seq)], "seq_id string, seq string")
    rows = [("c", p, a, "c", q, b, o, 1) for p, a, q, b, o in ((50, True, 120, False, 0), (50, False, 120, True, 3), (5, True, 198, False, 1), (1, False, 200, True, 0))]
    table = spark.createDataFrame(rows, "seq_id1 string, pos1 long, minus1 boolean, seq_id2 string, pos2 long, minus2 boolean, overlap int, seed_reads int")
    got = {(r.pos1, r.minus1, r.pos2): r for r in constructs.constructs(table, contigs, 20).collect()}
    for _, p, a, _, q, b, o, _ in rows:
        left = seq[max(0, p - 20) : p] if a else rc(seq[p - 1 : p + 19])
        right = rc(seq[max(0, q - 20) : q]) if b else seq[q - 1 : q + 19]
        r = got[p, a, q]
        assert (r.left, r.right, r.breakpoint, r.sequence) == (left, right[o:], len(left), left + right[o:])


def test_slide_and_snap(spark):
    copies = spark.createDataFrame([(0, "c", 1000, 2000, 1, "IS1")], REPEAT)
    rows = [(1, 500, True, 1003, False, 0), (2, 500, True, 1000, False, 2), (3, 500, True, 700, False, 3), (4, 500, False, 700, False, 3), (5, 500, False, 700, True, 3), (6, 500, True, 990, False, 10), (7, 500, True, 700, False, 9)]
    table = spark.createDataFrame([(i, "c", p, a, "c", q, b, o) for i, p, a, q, b, o in rows], "id int, seq_id1 string, pos1 long, minus1 boolean, seq_id2 string, pos2 long, minus2 boolean, overlap int")
    got = {r.id: (r.pos1, r.pos2, r.overlap) for r in constructs.slid(table, copies).collect()}
    assert got == {1: (500, 1000, 0), 2: (498, 1000, 0), 3: (497, 700, 0), 4: (500, 703, 0), 5: (503, 700, 0), 6: (500, 1000, 0), 7: (500, 700, 9)}


def test_second_pass(spark):
    sam = [
        ("r1/1", 0, "jc0", 1, "36M"), ("r1/1", 0, "jc1", 1, "34M2D"), ("r2", 0, "jc0", 1, "10M"), ("r3", 0, "jc0", 20, "30M"), ("r4", 0, "jc0", 1, "36M"), ("r5", 0, "jc2", 1, "36M"), ("r6", 4, "jc0", 1, "36M"), ("r7", 0, "c", 1, "36M"),
    ]
    rows = spark.createDataFrame(sam, "qname string, flag int, rname string, pos long, cigar string")
    built = spark.createDataFrame([(0, 20, False), (1, 20, False), (2, 20, True)], "number long, breakpoint int, both_repeats boolean")
    primary = spark.createDataFrame([("r4", 0, 36), ("r5", 0, 36), ("r1", 1, 20)], "name string, mate int, primary int")
    got = {(r.name, r.rname): r.reject for r in constructs.judged_alignments(rows, built, primary).collect()}
    assert got == {("r1", "jc0"): None, ("r1", "jc1"): "worse_than_competing", ("r2", "jc0"): "short_cover", ("r3", "jc0"): "not_spanning", ("r4", "jc0"): "worse_than_primary", ("r5", "jc2"): None}
    pieces = constructs.split_pieces(spark.createDataFrame([("q", 16, "c", 10, "5S20M3S"), ("q", 0, "c", 10, "3M9S")], "qname string, flag int, rname string, pos long, cigar string")).collect()
    assert [(p.read_start, p.read_end, p.span) for p in pieces] == [(3, 23, 20)]


def test_element_insertion(spark):
    """A 3 bp duplication at 500..502: one junction leaves to each end of an element."""
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    contigs = spark.createDataFrame([("c", seq)], "seq_id string, seq string")
    copies = spark.createDataFrame([(0, "c", 2000, 2500, 1, "IS1")], REPEAT)
    depth = spark.createDataFrame([("c", p, 9) for p in range(400, 600)], "seq_id string, pos long, unique_depth int")
    rows = [(1, "c", 500, False, "c", 2000, False, 12), (2, "c", 502, True, "c", 2500, True, 8), (3, "c", 503, True, "c", 2001, False, 30), (4, "c", 2100, True, "c", 2500, True, 30), (5, "c", 501, False, "c", 2001, False, 3)]
    table = spark.createDataFrame(rows, "id int, seq_id1 string, pos1 long, minus1 boolean, seq_id2 string, pos2 long, minus2 boolean, support int")
    found = elements.insertion_hypotheses(table, copies, depth, contigs)
    got = elements.element_records(elements.insertions(found)).collect()
    assert [(r.kind, r.fields, r.parent_ids) for r in got] == [("MOB", ["c", "500", "IS1", "-1", "3"], ["1", "2"])]
    assert elements.insertion_hypotheses(table, copies, depth.limit(0), contigs).count() == 0
    ends = spark.createDataFrame([(10, False, 1), (90, True, 1), (90, True, -1), (10, False, -1), (50, False, 1)], "p long, m boolean, s int").withColumn("copy", F.expr("struct(10L as start, 90L as end, s as strand)"))
    assert [r[0] for r in ends.select(elements.element_end(F.col("copy"), F.col("p"), F.col("m"))).collect()] == [5, 3, 5, 3, None]


def test_matchings(spark):
    a = spark.createDataFrame([("k", 1, 10), ("k", 2, 12), ("k", 3, 40)], "g string, id int, at long")
    b = spark.createDataFrame([("k", 7, 11), ("k", 8, 17), ("l", 9, 10)], "g string, id int, at long")
    assert sorted(map(tuple, review.greedy_pairs(a, b, ["g"], "at", 5).collect())) == [(1, 7, 1), (2, 8, 5)]
    rng = random.Random(2)
    for _ in range(4):
        edges = {(rng.randrange(6), rng.randrange(6)) for _ in range(9)}

        def most(left, edges=edges):
            if not left:
                return 0
            a, rest = left[0], left[1:]
            return max([most(rest, edges)] + [1 + most(rest, {(x, y) for x, y in edges if y != b}) for x, b in edges if x == a])

        got = review.most_pairs(spark.createDataFrame([("g", x, y) for x, y in edges], "g string, a_id int, b_id int"), ["g"]).collect()
        assert len(got) == most(sorted({x for x, _ in edges})) and {tuple(r) for r in got} <= edges
        assert len({r.a_id for r in got}) == len(got) == len({r.b_id for r in got})


def test_subclonal_candidates(spark):
    seen = []
    for sample, alt in (("s", 1), ("e", 4)):
        for r in range(20):
            minus, base = r % 2 == 0, "T" if r < alt else "A"
            seen.append((sample, "c", 7, "base", base, None, minus, r, None, "A"))
            if sample == "e" and r >= 15:
                seen.append((sample, "c", 7, "ins", "GG", None, minus, r, None, None))
    from helixframe.operators.pileup import OBSERVATION

    got = {(r.kind, r.allele): r for r in subclonal.candidates(spark.createDataFrame([(*x, None, None) for x in seen], OBSERVATION), "s", "e").collect()}
    assert set(got) == {("SNP", "T"), ("INS", "GG")}
    r = got["SNP", "T"]
    assert (r.alt_fwd_s + r.alt_rev_s, r.alt_fwd_e + r.alt_rev_e, r.ref_fwd_e + r.ref_rev_e, r.other_fwd_e + r.other_rev_e) == (1, 4, 16, 0)
    r = got["INS", "GG"]
    assert (r.alt_fwd_e + r.alt_rev_e, r.ref_fwd_e + r.ref_rev_e, r.other_fwd_e + r.other_rev_e, r.alt_fwd_s) == (5, 11, 4, 0)


def test_checks(tmp_path, spark):
    assert checks.spacer(" acgtn ") == "ACGTN" and checks.pam("nrg") == "NRG" and checks.search_status(True, 0) == "NO_CANDIDATES"
    for wrong in (lambda: checks.spacer("ACGU"), lambda: checks.pam("NXG"), lambda: checks.editor("x"), lambda: checks.clone_id("-a"), lambda: checks.within("n", 5, 0, 4), lambda: checks.read_files("/nowhere", None), lambda: products.columns("edit_outcomes", 3)):
        with pytest.raises(ValueError):
            wrong()
    (tmp_path / "x").write_bytes(b"abc")
    assert checks.file_sha256(str(tmp_path / "x")) == checks.sha256_of(spark, str(tmp_path / "x")).first().sha256
    rows = spark.createDataFrame([("a", "SNP", 5, None, 10, "T", None), ("b", "DEL", 9, 3, 10, None, None), ("c", "JC", 3, None, 10, None, None), ("d", "SNP", 0, None, 10, "T", None), ("e", "SNP", 1, None, None, "T", None)], "event_id string, kind string, pos long, size long, length long, bases string, strand string")
    problem = checks.event_problem(*(F.col(c) for c in ("kind", "pos", "size", "length", "bases", "strand")))
    assert [r[0] for r in rows.select(problem).collect()] == [None, "span beyond the sequence", "no strand", "position below 1", "unknown sequence"]
    with pytest.raises(Exception, match="span beyond"):
        checks.checked(rows.where("event_id = 'b'"), problem).count()


GD = "#=GENOME_DIFF\t1.0\n"


def test_run(spark, tmp_path):
    """Files in, tables out: one edit made, one event besides, one shared with the starter; then as a cohort."""
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    alt = lambda p: "ACGT"["ACGT".index(seq[p - 1]) - 1]
    (tmp_path / "ref.fa").write_text(f">c\n{seq}\n")
    (tmp_path / "starter.gd").write_text(GD + f"SNP\t1\t.\tc\t50\t{alt(50)}\n")
    (tmp_path / "edited.gd").write_text(GD + f"SNP\t1\t.\tc\t50\t{alt(50)}\nSNP\t2\t5,6\tc\t100\t{alt(100)}\nDEL\t3\t.\tc\t200\t10\nRA\t5\t.\tc\t100\t0\tA\tC\nMC\t6\t.\tc\t7\t9\t0\t0\n")
    gene = lambda n, a, b: f"     CDS             {a}..{b}\n                     /locus_tag=\"{n}\"\n"
    (tmp_path / "ref.gb").write_text("LOCUS       c 400 bp\nFEATURES             Location\n" + gene("b1", 90, 150) + gene("b2", 300, 390) + "ORIGIN\n//\n")
    (tmp_path / "intended.tsv").write_text(f"edit_id\tseq_id\tstart\tend\tref\talt\tkind\nE1\tc\t100\t100\t{seq[99]}\t{alt(100)}\tsnp\n")
    path = lambda n: str(tmp_path / n)
    run.run_audit(spark, path("edited.gd"), path("starter.gd"), [path("ref.fa")], path("out"), path("intended.tsv"))
    lines = {f.name: f.read_text().splitlines() for f in (tmp_path / "out").iterdir()}
    assert set(lines) == {"edit_outcomes.tsv", "post_edit_variants.tsv", "mutation_offtarget_links.tsv", "offtarget_sites.tsv", "unintended.tsv", "summary.txt", "report.md", "provenance.tsv"}
    outcome = dict(zip(*(x.split("\t") for x in lines["edit_outcomes.tsv"])))
    assert outcome["status"] == "COMPLETE" and outcome["matched_event_ids"] == "2" and outcome["unexpected_events"] == "NONE"
    variants = {r["position"]: r for r in (dict(zip(lines["post_edit_variants.tsv"][0].split("\t"), x.split("\t"))) for x in lines["post_edit_variants.tsv"][1:])}
    assert {p: (v["gd_type"], v["intended_relation"], v["size_class"], v["review_priority"]) for p, v in variants.items()} == {"100": ("SNP", "EXPECTED", "SMALL", "LOW"), "200": ("DEL", "UNRELATED", "STRUCTURAL", "HIGH")}
    assert {p: (v["evidence"], v["gene"], v["locus_tag"], v["feature_type"]) for p, v in variants.items()} == {"100": ("RA=1;MC=1;JC=NA", "NA", "b1", "CDS"), "200": ("RA=NA;MC=NA;JC=NA", "b1/b2", "NA", "intergenic")}
    assert "offtarget_search_status\tNOT_PERFORMED" in lines["provenance.tsv"] and len(lines["unintended.tsv"]) == 2
    (tmp_path / "m.tsv").write_text("clone_id\tr1\tintended_tsv\nk1\tedited.gd\tintended.tsv\nk2\tstarter.gd\t.\nk3\tnone.gd\t.\n")
    (tmp_path / "bad.gd").write_text(GD + "SNP\t1\t.\tc\t50\n")
    (tmp_path / "far.gd").write_text(GD + "SNP\t1\t.\tq\t50\tA\n")
    (tmp_path / "m.tsv").open("a").write("k4\tbad.gd\t.\nk5\tfar.gd\t.\nk6\tedited.gd\t.\n")
    matrix = run.run_batch(spark, path("m.tsv"), path("starter.gd"), [path("ref.fa")], path("batch")).collect()
    batch = lambda table, clone: "".join(f.read_text() for f in sorted((tmp_path / "batch" / table / f"clone_id={clone}").glob("part-*"))).splitlines()
    for name in ("edit_outcomes.tsv", "post_edit_variants.tsv", "unintended.tsv", "offtarget_sites.tsv", "mutation_offtarget_links.tsv"):
        assert batch(name, "k1") == lines[name], name  # a clone's part is what the audit of its files alone gives
        assert batch(name, "k2") == lines[name][:1], name
        assert not (tmp_path / "batch" / name / "clone_id=k4").exists()
    assert len(batch("unintended.tsv", "k6")) == 3 and len(batch("edit_outcomes.tsv", "k6")) == 1
    why = dict(line.split("\t") for f in (tmp_path / "batch" / "failures").glob("part-*") for line in f.read_text().splitlines()[1:])
    assert set(why) == {"k3", "k4", "k5"} and "no file" in why["k3"] and "malformed" in why["k4"] and "unknown sequence q" in why["k5"]
    assert sorted((r.position, r.n_clones, r.clone_k1, r.clone_k2, r.clone_k6, r.scope) for r in matrix) == [(100, 2, 1, 0, 1, "shared_subset"), (200, 2, 1, 0, 1, "shared_subset")]
    assert "k3" in (tmp_path / "batch" / "cohort" / "batch_report.md").read_text()
    with pytest.raises(ValueError):
        readers.read_sites(spark, path("m.tsv"), "other")
    names, rows = products.repeat_ambiguous(spark.createDataFrame([("RESOLVED", ["c", "d"], 3)], "state string, reference_contigs array<string>, overlap int"), "s1")
    assert rows.first().value.split("\t")[:3] == ["s1", "c,d", "RESOLVED"] and len(names) == 31
    assert writers.rendered((names, rows)).startswith("sample_id")


def test_folding(spark):
    from helixframe.operators import folding

    key = "seq_id1 string, pos1 long, minus1 boolean, seq_id2 string, pos2 long, minus2 boolean, overlap int"
    support = "reads long, plus long, minus long, best_min long, best_min_plus long, best_min_minus long, min_side1 long, min_side2 long, seed_reads long"
    rows = [
        (1, "c", 100, True, "c", 900, False, 0, 5, 3, 2, 12, 12, 9, 0, 4, 2),
        (2, "c", 903, False, "c", 98, True, 0, 7, 4, 3, 15, 11, 15, 6, 5, 1),
        (3, "c", 100, True, "c", 930, False, 0, 1, 1, 0, 3, 3, 0, 3, 3, 1),
        (4, "c", 100, False, "c", 900, False, 0, 1, 1, 0, 3, 3, 0, 3, 3, 1),
    ]
    table = spark.createDataFrame(rows, f"id int, {key}, {support}")
    got = {tuple(r.ids): r for r in folding.fold_directions(table).collect()}
    assert set(got) == {(1, 2), (3,), (4,)}
    r = got[1, 2]
    assert (r.id, r.pos1, r.reads, r.plus, r.minus, r.best_min, r.best_min_minus, r.min_side1, r.min_side2, r.seed_reads) == (2, 903, 12, 7, 5, 15, 15, 6, 4, 2)
    assert folding.fold_directions(table.limit(0)).count() == 0
    clustered = table.select("id", *(c.split()[0] for c in key.split(", "))).withColumn("cluster", F.when(F.col("id") < 3, 1).otherwise(F.col("id")))
    assert sorted((r.pos1, r.seed_reads) for r in folding.seed_candidates(clustered).collect()) == [(100, 1), (100, 1), (100, 2)]
    copies = spark.createDataFrame([("j", 1, 10, 1, False, 4), ("j", 2, 9, 1, True, 9), ("j", 3, 8, 1, True, 2), ("j", 4, 5, 1, True, 0), ("k", 5, 3, 1, False, None)], "j string, id int, reads long, seed_reads long, outside boolean, distance long")
    assert sorted((r.j, r.id) for r in folding.displayed_copies(copies, ["j"]).collect()) == [("j", 3), ("k", 5)]


def test_gates(spark):
    from helixframe.plans import gates

    rows = "id int, k string, at long, m boolean"
    a = spark.createDataFrame([(1, "c", 10, True), (2, "c", 50, True), (3, "c", 90, True), (4, "c", 200, True), (5, "c", 10, True)], rows)
    b = spark.createDataFrame([(1, "c", 10, True), (2, "c", 52, True), (3, "c", 91, False)], rows)
    found = gates.discrepancies(a, b, ["k"], "at", "m", 5)
    assert {(r.side, r.id): r.bucket for r in found.collect()} == {("a", 1): "exact", ("a", 2): "jitter", ("a", 3): "strand", ("a", 4): "only", ("a", 5): "duplicate", ("b", 1): "exact", ("b", 2): "jitter", ("b", 3): "strand"}
    assert not gates.comparison_gate(found, {"a_only": 1}).passed
    good = gates.comparison_gate(found, {"a_only": 1, "a_jitter": 1, "b_jitter": 1, "a_strand": 1, "b_strand": 1, "a_duplicate": 1})
    assert good.passed and '"a_only": 1' in good.to_json()
    tables = {"a": a, "b": b}
    verdict = gates.release_gate(tables, [("a", "id", "b", "id")], {"b": ["id"], "a": ["at"]}, {"a": (F.col("k"), "^x")})
    assert verdict.counts == {"a.id not in b": 2, "b repeats id": 0, "a repeats at": 1, "a holds ^x": 0} and not verdict.passed


def test_clip_candidates(spark):
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGT") for _ in range(600))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seq = seq + seq[100:115] + "T" + seq[100:115]
    contigs = spark.createDataFrame([("c", seq)], "seq_id string, seq string")
    rows = [
        (1, "c", 50, False, seq[399:415]),  # read ends at 50 and goes on at 400
        (2, "c", 50, False, rc(seq[399:415])),  # on the other strand
        (3, "c", 300, True, seq[399:415]),  # comes from 400..415 and is aligned from 300
        (4, "c", 300, True, rc(seq[399:415])),
        (5, "c", 50, False, seq[50:66]),  # only goes on
        (6, "c", 50, False, seq[99:104]),  # too short
        (7, "c", 50, False, seq[100:115]),  # three places
    ]
    clips = spark.createDataFrame(rows, "id int, seq_id string, pos long, left boolean, bases string")
    found, repeats = constructs.clip_candidates(clips, contigs, concrete=2)
    got = {r.id: (r.pos1, r.minus1, r.pos2, r.minus2) for r in found.collect()}
    assert got == {1: (50, True, 400, False), 2: (50, True, 415, True), 3: (415, True, 300, False), 4: (400, False, 300, False)}
    assert [tuple(r) for r in repeats.collect()] == [(7, 3)]
